"""Downloads, listings, stores, logs, tensors and the refusals of the readers, on files made here."""

from __future__ import annotations

import gzip
import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from gristmill.sources import passage_files, records, remote, run_logs, tensors

BODY = bytes(range(256)) * 40
GOOD = hashlib.sha256(BODY).hexdigest()


class Server:
    """Serves ``files``; may cut the first replies short, lie about ranges, or give pages of JSON."""

    def __init__(self, files, cuts=0, says_size=True, wrong_start=False):
        self.files, self.cuts, self.asked = files, cuts, []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def do_GET(self):
                wanted = self.headers.get("Range")
                outer.asked.append((self.path, wanted))
                found = outer.files.get(self.path.lstrip("/"))
                if found is None:
                    return self.send_error(404)
                if isinstance(found, tuple):
                    body, after = found
                    self.send_response(200)
                    if after:
                        self.send_header("Link", f'<http://{self.headers["Host"]}/{after}>; rel="next"')
                    self.end_headers()
                    return self.wfile.write(json.dumps(body).encode())
                start = int(wanted[6:-1]) if wanted else 0
                if start >= len(found):
                    self.send_response(416)
                    if says_size:
                        self.send_header("Content-Range", f"bytes */{len(found)}")
                    self.send_header("Content-Length", "0")
                    return self.end_headers()
                body = found[start:]
                self.send_response(206 if wanted else 200)
                if wanted:
                    self.send_header("Content-Range", f"bytes {start + wrong_start}-{len(found) - 1}/{len(found)}")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                outer.cuts -= 1
                self.wfile.write(body[: len(body) // 2] if outer.cuts >= 0 else body)

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/"


@pytest.fixture
def serve():
    running = []

    def start(*args, **named):
        running.append(Server(*args, **named))
        return running[-1]

    yield start
    for s in running:
        s.http.shutdown()
        s.http.server_close()


def test_download_goes_on_where_it_was_cut(serve, tmp_path):
    server, waits = serve({"f": BODY}, cuts=2), []
    got = remote.retried(lambda: remote.download(server.url + "f", tmp_path / "f", GOOD), 3, 1, waits.append)
    assert got.read_bytes() == BODY and waits == [1, 2] and [r is not None for _, r in server.asked] == [False, True, True]
    assert remote.download(server.url + "f", tmp_path / "f").read_bytes() == BODY and len(server.asked) == 3


def test_retries_end(serve, tmp_path):
    server = serve({"f": BODY}, cuts=9)
    with pytest.raises(OSError):
        remote.retried(lambda: remote.download(server.url + "f", tmp_path / "f"), 2, 0)
    assert len(server.asked) == 3
    with pytest.raises(OSError):
        remote.retried(lambda: remote.download(server.url + "none", tmp_path / "none"), 2, 0)
    assert len(server.asked) == 4


@pytest.mark.parametrize(("part", "sha", "says_size", "whole"), [(BODY, None, True, True), (BODY, GOOD, False, True), (BODY, None, False, False), (b"y" * len(BODY), GOOD, False, False), (BODY + b"z", None, True, False)])
def test_a_part_needs_to_be_confirmed(serve, tmp_path, part, sha, says_size, whole):
    server = serve({"f": BODY}, says_size=says_size)
    (tmp_path / "f.part").write_bytes(part)
    if not whole:
        with pytest.raises(OSError):
            remote.download(server.url + "f", tmp_path / "f", sha)
        assert not (tmp_path / "f.part").exists()
    assert remote.download(server.url + "f", tmp_path / "f", sha).read_bytes() == BODY


def test_wrong_bytes_are_never_named(serve, tmp_path):
    server = serve({"f": BODY}, wrong_start=True)
    (tmp_path / "f.part").write_bytes(BODY[:10])
    with pytest.raises(OSError, match="bytes from"):
        remote.download(server.url + "f", tmp_path / "f")
    with pytest.raises(OSError, match="sha256"):
        remote.download(server.url + "f", tmp_path / "f", "0" * 64)
    assert not list(tmp_path.iterdir())


def test_listing_and_fetch(serve, tmp_path):
    entry = lambda path, **more: {"type": "file", "path": path, "size": 3, "lfs": {"oid": hashlib.sha256(path[-9:].encode()).hexdigest()}} | more
    files = {"api/datasets/o/r": ({"sha": "a" * 40}, None)}
    files["api/datasets/o/r/tree/" + "a" * 40 + "/d?recursive=true"] = ([entry("d/b.parquet"), {"type": "directory", "path": "d"}, entry("d/x.txt")], "next")
    files["next"] = ([entry("d/a.parquet")], None)
    for name in ("d/a.parquet", "d/b.parquet"):
        files[f"datasets/o/r/resolve/{'a' * 40}/{name}"] = name[-9:].encode()
    server = serve(files)
    base = server.url.rstrip("/")
    said = remote.fetch("o/r", "d", tmp_path / "out", base)
    assert said["revision"] == "a" * 40 and [f["path"] for f in said["files"]] == ["d/a.parquet", "d/b.parquet"]
    assert [p.read_bytes() for p in remote.selected(tmp_path / "out")] == [b"a.parquet", b"b.parquet"]
    (tmp_path / "out/d/a.parquet").unlink()
    with pytest.raises(FileNotFoundError, match="1 chosen"):
        remote.selected(tmp_path / "out")
    for bad in (entry("../a.parquet"), entry("/a.parquet"), entry("a.parquet", lfs=None), entry("a.parquet", lfs={"oid": "x"})):
        files["next"] = ([bad], None)
        with pytest.raises(ValueError):
            remote.hub_files("o/r", "a" * 40, "d", ".parquet", base)
    files["api/datasets/o/r"] = ({"sha": "main"}, None)
    with pytest.raises(ValueError, match="revision"):
        remote.hub_revision("o/r", base)


def test_stores_keep_the_newest(tmp_path):
    store, scratch = remote.FolderStore(tmp_path / "store"), tmp_path / "scratch"
    for step in (1, 2, 3):
        (tmp_path / "c.bin").write_bytes(bytes([step]) * 5)
        kept = remote.push(store, tmp_path / "c.bin", step, scratch, keep=2)
    assert [e["step"] for e in kept] == [2, 3] and not (tmp_path / "store/step-000000001.bin").exists()
    assert remote.pull_newest(store, tmp_path / "got", scratch)["step"] == 3 and (tmp_path / "got").read_bytes() == b"\x03" * 5
    (tmp_path / "store/step-000000003.bin").write_bytes(b"damaged")
    assert remote.pull_newest(store, tmp_path / "got", scratch)["step"] == 2


def test_logs(spark, tmp_path):
    log = run_logs.Log(tmp_path / "log", clock=lambda: 2.0)
    for step in range(4):
        log.write("train", step, {"loss": float("nan") if step == 1 else 0.5})
    with pytest.raises(ValueError, match="reserved"):
        log.write("train", 9, {"step": 1})
    with (tmp_path / "log").open("a") as out:
        out.write('{"kind": "tr')
    rows = run_logs.read(spark, str(tmp_path / "log")).collect()
    assert [(r.kind, r.step, r.time) for r in rows] == [("train", k, 2.0) for k in range(4)]
    run_logs.Log(tmp_path / "log", resume=1).write("eval", 2)
    assert [(r.kind, r.step) for r in run_logs.read(spark, str(tmp_path / "log")).collect()] == [("train", 0), ("train", 1), ("eval", 2)]


def tensor_file(arrays):
    header, body = {}, b""
    for name, a in arrays.items():
        header[name] = {"dtype": {"float32": "F32", "int64": "I64"}[a.dtype.name], "shape": list(a.shape), "data_offsets": [len(body), len(body) + a.nbytes]}
        body += a.tobytes()
    said = json.dumps(header).encode()
    return len(said).to_bytes(8, "little") + said + body


def test_tensors(spark, tmp_path):
    arrays = {"a": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.array([7], np.int64)}
    data = tensor_file(arrays)
    (tmp_path / "t.bin").write_bytes(data)
    got = {r.name: (r.shape, r["values"]) for r in tensors.read(spark, str(tmp_path / "t.bin")).collect()}
    assert got == {"a": ([2, 3], [0, 1, 2, 3, 4, 5]), "b": ([1], [7])}
    for bad in (b"", data[:20], data + b"x", data[:-1]):
        with pytest.raises(ValueError):
            tensors.parse(bad)


def test_json_lines_of_several_frames(spark, tmp_path):
    lines = [json.dumps({"text": f"t{i}\u2028x", "url": "u", "warc_record_id": f"<{i}>"}, ensure_ascii=False) + "\n" for i in range(4)] + ["\n"]
    (tmp_path / "a.json.gz").write_bytes(gzip.compress("".join(lines[:2]).encode()) + gzip.compress("".join(lines[2:]).encode()))
    got = sorted(map(tuple, records.crawl_texts(spark, str(tmp_path / "a.json.gz")).collect()))
    assert got == [(f"t{i}\u2028x", "u", f"<{i}>") for i in range(4)]
    for k, bad in enumerate(('{"url": "u"}', '{"text": null}', '{"text": 3}', '["text"]', '"text"', "{")):
        (tmp_path / f"bad{k}.json.gz").write_bytes(gzip.compress(bad.encode()))
        with pytest.raises(Exception, match="without text"):
            records.json_lines(spark, str(tmp_path / f"bad{k}.json.gz")).collect()


def test_strict_readers(spark, tmp_path):
    spark.createDataFrame([("a", 1), (None, 2)], "text string, k int").coalesce(1).write.parquet(str(tmp_path / "p"))
    with pytest.raises(Exception, match="no text in .* row 1"):
        records.parquet(spark, str(tmp_path / "p"), ("text",)).collect()
    with pytest.raises(ValueError, match="no column id"):
        records.parquet(spark, str(tmp_path / "p"), ("text", "id"))
    good = {c: "x" for c in passage_files.FIELDS}
    for k, bad in enumerate((good | {"date": 3}, good | {"more": "x"}, {"id": "x"}, [1])):
        (tmp_path / f"b{k}").write_text(json.dumps(good) + "\n" + json.dumps(bad) + "\n")
        with pytest.raises(Exception, match="not a passage"):
            passage_files.read(spark, str(tmp_path / f"b{k}")).collect()
    spark.createDataFrame([(0, "a"), (2, "b")], "doc long, text string").write.parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError, match="damaged"):
        passage_files.verify_store(spark, str(tmp_path / "s"))


def test_described_files(spark, tmp_path):
    (tmp_path / "f").write_bytes(BODY)
    assert [tuple(r) for r in remote.described(spark, str(tmp_path / "f")).collect()] == [("f", len(BODY), GOOD)] and remote.sha256_of(tmp_path / "f") == GOOD
