"""Operators whose result is fixed, against brute force over odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, feistel, packing, sharding, simhash, suffix_dedup, tokens, toxicity

from .helpers import DOCS, odd_rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_feistel_column_is_the_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        got = [r.p for r in spark.range(n).select(feistel.permute_column(F.col("id"), n, "k").alias("p")).collect()]
        assert got == [feistel.permute(i, n, "k") for i in range(n)]
        assert sorted(got) == list(range(n))


def test_sharding(docs, empty):
    rows = sharding.assign(docs, 5).collect()
    assert len(rows) == len(odd_rows()) and {r.law for r in rows} == {"rows"}
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n)) and len(sharding.order_of(s, 5, len(rows))) == n
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert Counter(map(tuple, sharding.assign(docs.repartition(7), 5).collect())) == Counter(map(tuple, rows))
    assert sharding.assign(empty).count() == 0


def brute_removed(spark, rows, length):
    """(doc_id, text) to (bytes, removed mask); rows of equal doc_id and text are one document, those of equal doc_id go by hashes of the text."""
    key = F.coalesce("d", F.lit(-(1 << 63))), F.xxhash64("t"), F.xxhash64(F.lit(1), "t")
    distinct = spark.createDataFrame([(d, t or "") for d, t, *_ in rows], "d long, t string").distinct().orderBy(*key).collect()
    seen, out = set(), {}
    for d, t in distinct:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            gone[k : k + length] |= w in seen
            seen.add(w)
        out[d, t] = (b, gone)
    return out


def held_to_brute_force(spark, rows, got, length):
    want, texts = brute_removed(spark, rows, length), {r[5]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        b, gone = want[r.doc_id, texts[r.tie]]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        edges = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest())
        if not gone.any():
            assert r.text == texts[r.tie]
        assert "\ufffd" not in r.text


@pytest.mark.parametrize(("length", "gram", "hot"), [(100, 40, 1000), (100, 40, 1), (32, 12, 2)])
def test_suffix_dedup(docs, spark, length, gram, hot):
    got = suffix_dedup.dedup(docs, length, gram, hot).collect()
    held_to_brute_force(spark, odd_rows(), got, length)
    assert sum(r.n_removed for r in got) > 3000


def test_suffix_dedup_of_unlike_texts_under_one_id(spark):
    """Two of the texts agree in the low 24 bits of their checksums; each doc_id has several texts, some repeated."""
    met, pair = {}, None
    for i in range(100_000):
        t = hashlib.sha256(str(i).encode()).hexdigest() * 5
        if (low := zlib.crc32(t.encode()) & 0xFFFFFF) in met:
            pair = (met[low], t)
            break
        met[low] = t
    texts = [pair[0][:300], *pair, *(hashlib.sha256(str(i).encode()).hexdigest() * 2 + pair[i % 2][:150] for i in range(20))]
    rows = [(d, t, "", "", 0, n, 0, 0.0) for n, (d, t) in enumerate([(None, t) for t in texts] + [(7, t) for t in texts[::2]] + [(None, texts[1])])]
    held_to_brute_force(spark, rows, suffix_dedup.dedup(spark.createDataFrame(rows, DOCS).repartition(5)).collect(), 100)


def test_suffix_dedup_of_nothing(empty, spark):
    assert suffix_dedup.digest(empty).count() == 0
    assert [tuple(r) for r in suffix_dedup.digest(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).sort("doc_id").collect()] == [(d, 0, 0, 0, hashlib.sha256(b"").hexdigest()) for d in (1, 2)]
    with pytest.raises(ValueError, match="bytes"):
        suffix_dedup.digest(empty, 10)


def test_contents_are_sent_in_bounded_batches():
    """One document that many others ask for, and many windows of hot anchors: no batch holds them all."""
    text = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(200))
    run = pa.struct([("m", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_()), *((c, pa.int64()) for c in ("d", "t", "u", "start"))])
    asks = [{"m": None, "at": 0, "n": len(text) - 99, "hot": False, "d": i, "t": 0, "u": 0, "start": 0} for i in range(2000)]
    warm = [{"m": 5, "at": at, "n": 64, "hot": True, "d": 0, "t": 0, "u": 0, "start": 0} for at in range(0, len(text) - 163, 64)]
    docs = [(7, text, asks)] + [(100 + i, str(i) + text[i:][::-1], warm[:-1]) for i in range(30)] + [(200 + i, str(i) + text[i:][::-1], warm[:-2]) for i in range(20)] + [(8, "x", [])]
    columns = [pa.array([d for d, _, _ in docs]), *(pa.array([0] * len(docs), pa.int64()),) * 2, pa.array([t for _, t, _ in docs]), pa.array([r for _, _, r in docs], pa.list_(run))]
    got = list(suffix_dedup._content(100)([pa.RecordBatch.from_arrays(columns, ["d", "t", "u", "text", "runs"])]))
    assert max(b.num_rows for b in got) < suffix_dedup.SENT_ROWS + 1000 and max(b.nbytes for b in got) < 4 * suffix_dedup.SENT_BYTES
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["d"], r["bytes"]) for r in rows if r["g"] is None] == [(i, text.encode()) for i in range(2000)]
    # Each hot window is there once: by itself, or in a range that another window with its bytes stands for.
    held = Counter((r["d"], p) for r in rows if r["g"] is not None for p in range(r["loc"] >> 7, (r["loc"] >> 7) + (r["loc"] & 127)))
    assert held == Counter((d, p) for d, _, runs in docs[1:] for r in runs for p in range(r["at"], r["at"] + r["n"]))
    whole = {d: t.encode() for d, t, _ in docs}
    assert all(whole[r["d"]][r["loc"] >> 7 :][:100] == r["bytes"] for r in rows if r["g"] is not None and r["bytes"])


def test_longest_previous_factor():
    for data in (b"", b"a", b"banana", b"abababab", b"mississippi" * 3, bytes(range(50)) * 2):
        want = [max((next((k for k in range(len(data) - i) if data[i + k] != data[j + k]), len(data) - i) for j in range(i)), default=0) for i in range(len(data))]
        assert suffix_dedup.longest_previous_factor(data).tolist() == want
        assert [data[i:] for i in suffix_dedup.suffix_array(data)] == sorted(data[i:] for i in range(len(data)))


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("segments", "most"), [(3, 100_000), (2, 100_000), (5, 100_000), (3, 2)])
def test_simhash_components(docs, spark, segments, most):
    rows = odd_rows()
    # A dense crowd around one text, so that entries are full.
    crowd = [(1000 + i, " ".join(f"t{k}" if k != 3 * i else f"new{i}" for k in range(400)), None, None, 0, i, i, 0.0) for i in range(120)]
    got = simhash.groups(spark.createDataFrame(rows + crowd, DOCS).repartition(3), segments=segments, most=most).collect()
    fps = [brute_fingerprint(r[1]) for r in rows + crowd]
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for x, r in zip(label, rows + crowd, strict=True):
        least[x] = min((d for d in (least.get(x), r[0]) if d is not None), default=None)
    want = Counter((r[0], f"{f:016x}", least[x]) for r, f, x in zip(rows + crowd, fps, label, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len({r.component_id for r in got}) < len(got) - 90


def test_simhash_dedup_keeps_one(docs, empty, spark):
    kept = simhash.dedup(docs).collect()
    classes = {(r.doc_id, r.component_id) for r in simhash.groups(docs).collect()}
    known = {c for _, c in classes if c is not None}
    assert {r.doc_id for r in kept} - {None} == known
    assert simhash.dedup(empty).count() == 0 and simhash.groups(empty).count() == 0
    assert kept and set(kept[0].asDict()) == {c.split()[0] for c in DOCS.split(", ")}


def test_segment_shares_cover_the_radius():
    for radius in (0, 1, 2, 3, 4, 6):
        for segments in (1, 2, 3, 4, 5, 8):
            shares = [s for _, _, s in simhash.plan(radius, segments)]
            assert sum(s + 1 for s in shares) > radius  # else a difference of s + 1 bits in each would fit


def brute_contamination(docs, items, window):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    table = {}
    for number, (name, text) in enumerate(items):
        w = split(text)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            table.setdefault(tuple(w[p : p + n]), set()).add((number, "" if name is None else str(name)))
    out = []
    for d, t, *_ in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in table}:
            for p in range(len(w) - n + 1):
                if k := table.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= k
        names = ",".join(sorted(x for _, x in found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("bits", [1 << 16, decontaminate.FILTER])
def test_contamination(docs, spark, bits):
    rows = odd_rows()
    long = rows[16][1].split()
    items = [(1, " ".join(long[5:30])), (2, " ".join(long[5:30])), (3, "word"), (4, None), (5, "..."), (6, " ".join(long[2:9])), (None, " ".join(long[20:34])), (8, "a" * 900), (9, "ab " * 15), (9, "ab " * 15), (9, " ".join(long[40:55])), (None, " ".join(long[60:75])), (None, " ".join(long[60:75])), (11, " ".join(long[100:400]))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, lang string")
    got = Counter(tuple(r) for r in decontaminate.contamination(docs, benchmark, bits=bits).collect())
    assert got == brute_contamination(rows, items, 10)
    clean = decontaminate.clean(docs, benchmark, bits=bits)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, *_, bad in got.elements() if not bad) and clean.columns == docs.columns


def test_contamination_without_items(docs, empty, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.contamination(docs, nothing).collect())
    assert decontaminate.contamination(empty, nothing).count() == 0


def test_packing_round_trip(docs, empty):
    encode = tokens.encoder()
    pieces = packing.pack(docs).collect()
    want = Counter()
    for d, t, *_ in odd_rows():
        ids = np.array([*encode(t or ""), 0], "<u4")
        want.update((d, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(packing.cut(len(ids), 2048)))
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p.offset, p.length) for p in pieces if p.sequence_id == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
    assert packing.pack(empty).count() == 0


def test_bin_completion_is_optimal_where_it_can_be_known():
    rng = np.random.default_rng(3)
    for n in (1, 5, 8):
        for _ in range(30):
            lengths = rng.integers(1, 21, n)
            assert used(packing.complete(np.bincount(lengths, minlength=21), 20)) == brute_bins(sorted(lengths.tolist(), reverse=True), 20)
    for n in (3000, 60_000):
        counts = np.bincount(rng.integers(1, 1800, n), minlength=2049)
        patterns = packing.complete(counts, 2048)
        assert unpacked(patterns, 2048) == counts.tolist() and used(patterns) <= packing.lower_bound(counts, 2048) + 2
        assert unpacked(packing.best_fit(counts, 2048), 2048) == counts.tolist()
        assert used(patterns) <= used(packing.best_fit(counts, 2048))
    assert packing.complete(np.zeros(21, np.int64), 20) == []


def used(patterns):
    return sum(n for _, n in patterns)


def unpacked(patterns, capacity):
    counts = [0] * (capacity + 1)
    for p, n in patterns:
        assert sum(p) <= capacity
        for x in p:
            counts[x] += n
    return counts


def test_bin_completion_of_small_random_cases():
    rng = np.random.default_rng(11)
    for k in range(300):
        lengths = rng.integers(1, 21, int(rng.integers(1, 13))) if k % 2 else rng.integers(3, 11, int(rng.integers(1, 15)))
        assert used(packing.complete(np.bincount(lengths, minlength=21), 20)) == brute_bins(sorted(lengths.tolist(), reverse=True), 20)


def test_dominated_fillings():
    spare = np.array([5, 9])
    assert packing.dominated((4,), 1, spare) and not packing.dominated((4,), 0, spare)
    assert packing.dominated((4, 5), 0, spare) and not packing.dominated((9,), 0, spare)
    assert packing.completions(np.bincount([7, 5, 2, 2], minlength=10), 9) == [(7, 2)]


def test_packing_over_many_tasks(spark):
    """Pieces of a hot source fill up with those of other tasks."""
    long, short = "word " * 1100, "word " * 900
    docs = spark.createDataFrame([(i, long if i < 60 else short) for i in range(120)], "doc_id long, text string").coalesce(2)
    got = packing.pack(docs).collect()
    assert len({p.sequence_id for p in got}) == 60


def brute_bins(lengths, room):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= room and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_token_ids_are_those_of_tokenizers():
    import pandas as pd
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[1] or "" for r in odd_rows() if len(r[1] or "") < 20_000] + ["<|endoftext|> x", "x <|endoftext|> y", "<|endoftext|><|endoftext|>", "a" * 70_000 + "<|endoftext|>", "it's  \n\n two x   ½ 😀", "a b" * 40_000]
    texts += pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.tolist()
    fast = tokens.encoder()
    assert [fast(t) for t in texts] == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def test_columns_of_any_name_are_kept(spark):
    """Names that stages use inside are free for callers, in any case."""
    names = ["doc_id", "text", "_TEXT", "_text_", "_kept_d", "_Kept_x", "d", "tie", "row", "spans", "fp", "k", "n_bytes"]
    rows = [(i, f"one two three four five six seven {i} " * 8, *range(len(names) - 2)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names[2:]))
    items = spark.createDataFrame([(1, "nothing of the kind is said in any of these few texts")], "item_id long, text string")
    for kept in (decontaminate.clean(docs, items), simhash.dedup(docs), toxicity.score(docs, toxicity.Model(-3.0, {}), rejected=False)):
        assert kept.columns == names
        assert {tuple(r) for r in kept.collect()} <= set(rows) and not kept.isEmpty()
    assert suffix_dedup.dedup(docs).where("_TEXT = 0 and _kept_d = 2 and tie = 5").count() == 4
