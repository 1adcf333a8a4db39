"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized with integral images, NPY tiles, difference hashes.

``decode`` reads P1 to P6 and uncompressed 1, 8, 24 and 32 bit BMP; ``encode`` writes P5, P6 and 8 bit BMP. All work is
row by row on the executors, without a shuffle. Equal payloads give equal values.

A NULL text is empty; an empty text is 64 zero bytes; NULL or repeated doc_ids are kept; an empty table gives an empty result; other columns
are ignored. A very long text is a taller image: memory is a few times the largest text, as text, payload, file and samples; the
integral image is made in bands. Samples of more than 8 bits are scaled by their largest value; an image without samples is an error in its row.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

WIDTH = 64
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode(pixels: np.ndarray, kind: str = "pgm") -> bytes:
    """An array of 8 bit samples, (height, width) or (height, width, 3), as PGM, PPM or BMP."""
    height, width = pixels.shape[:2]
    if kind == "bmp":
        if pixels.ndim != 2:
            raise ValueError("only grey images are written as BMP")
        rows = np.zeros((height, -(-width // 4) * 4), np.uint8)
        rows[:, :width] = pixels
        grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
        grey[:, 3] = 0
        at = 54 + grey.size
        head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + rows.size, 0, 0, at, 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
        return head + grey.tobytes() + rows[::-1].tobytes()
    if kind not in ("pgm", "ppm") or (kind == "ppm") != (pixels.ndim == 3):
        raise ValueError(f"a {pixels.ndim}-dimensional array isn't written as {kind}")
    return b"P%d\n%d %d\n255\n" % (5 if kind == "pgm" else 6, width, height) + pixels.astype(np.uint8).tobytes()


def decode(data: bytes) -> np.ndarray:
    """Netpbm (P1 to P6) or BMP to an array of its samples: (height, width), or (height, width, 3) in RGB."""
    return read(data)[0]


def read(data: bytes) -> tuple[np.ndarray, int]:
    """The samples of ``decode``, and the value that stands for full brightness. An image without samples is an error."""
    pixels, most = (_bmp(data), 255) if data[:2] == b"BM" else _netpbm(data)
    if not pixels.size:
        raise ValueError("an image without samples")
    return pixels, most


def _netpbm(data: bytes) -> tuple[np.ndarray, int]:
    if not re.match(rb"P[1-6]\s", data):
        raise ValueError("neither Netpbm nor BMP")
    kind, at, fields = data[1] - 48, 2, []
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("the header is cut short")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = *fields[:2], fields[2] if len(fields) > 2 else 1
    if not 0 < most < 65536:
        raise ValueError("the largest sample is 1 to 65535")
    depth = 3 if kind in (3, 6) else 1
    shape, kept = (height, width, 3) if depth == 3 else (height, width), np.uint8 if most < 256 else np.uint16
    if kind == 1:
        flat = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", data[at:]), np.uint8)[: height * width] - 48
        return (1 - flat).reshape(shape), most
    if kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*\n", b" ", data[at:]).split()[: height * width * depth], dtype=np.int64)
        return flat.astype(kept).reshape(shape), most
    at += 1
    if kind == 4:
        stride = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, height * stride, at).reshape(height, stride), axis=1)[:, :width]
        return 1 - bits, most
    flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", height * width * depth, at)
    return flat.astype(kept).reshape(shape), most


def _bmp(data: bytes) -> np.ndarray:
    at, head, width, height, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if packed not in (0, 3) or bits not in (1, 8, 24, 32):
        raise ValueError(f"a BMP of {bits} bits with compression {packed} isn't read")
    stride, down = (width * bits + 31) // 32 * 4, height < 0
    rows = np.frombuffer(data, np.uint8, abs(height) * stride, at).reshape(abs(height), stride)
    rows = rows if down else rows[::-1]
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1])
    index = np.unpackbits(rows, axis=1)[:, :width] if bits == 1 else rows[:, :width]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    table = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
    if (table == table[:, :1]).all():
        return table[:, 0][index]
    return table[index]


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else (pixels * np.array([0.299, 0.587, 0.114])).sum(axis=2)


def area_resize(pixels: np.ndarray, height: int, width: int, band: int = 4096) -> np.ndarray:
    """Mean over each cell of a ``height`` by ``width`` grid, from the integral image; edges inside a pixel take their share of it.

    The integral image is made ``band`` rows at a time, each going on from the last row of the one before, and only the rows at edges are kept: memory doesn't grow with the image.
    """
    h, w = pixels.shape[:2]
    kind = np.int64 if pixels.ndim == 2 and pixels.dtype.kind in "ui" else np.float64  # whole numbers stay so to the last division

    def edges(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """The pixel each edge falls into, and how many of the ``cells`` parts of it stand before the edge."""
        low, part = np.divmod(np.arange(cells + 1) * size, cells)
        return np.minimum(low, size - 1), np.where(low == size, cells, part)

    low, part = edges(h, height)
    needed = np.unique(np.concatenate([low, low + 1]))
    kept, last = np.zeros((len(needed), w + 1), kind), np.zeros(w + 1, kind)
    for at in range(0, h, band):
        table = np.zeros((min(band, h - at) + 1, w + 1), kind)
        np.cumsum(np.cumsum(grey(pixels[at : at + band]), axis=0, dtype=kind), axis=1, out=table[1:, 1:])
        table += last
        inside = (needed >= at) & (needed < at + len(table))
        kept[inside] = table[needed[inside] - at]
        last = table[-1]
    rows = kept[np.searchsorted(needed, low)] * (height - part)[:, None] + kept[np.searchsorted(needed, low + 1)] * part[:, None]
    low, part = edges(w, width)
    cells = rows[:, low] * (width - part) + rows[:, low + 1] * part
    return np.diff(np.diff(cells, axis=0), axis=1) / (h * w)


def tile_of(pixels: np.ndarray, most: int, height: int, width: int) -> np.ndarray:
    """The grey image at that size, samples of any depth scaled to 8 bits."""
    return np.rint(area_resize(pixels, height, width) * (255 / most)).clip(0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray, most: int = 255, side: int = 8) -> tuple[str, np.ndarray]:
    """Hash of ``side`` squared bits, in hex: whether a cell is brighter than the one to its left; and the tile it is read from."""
    tile = tile_of(pixels, most, side, side + 1)
    bits = tile[:, 1:] > tile[:, :-1]
    return np.packbits(bits).tobytes().hex(), tile


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def stored(text: bytes | None, kind: str = "pgm") -> tuple[int, bytes]:
    """The text's length, and the image file that holds it: 64 bytes a row, zeros at the end."""
    text = text or b""
    payload = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
    return len(text), encode(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH), kind)


def media_features(docs: DataFrame, kind: str = "pgm") -> DataFrame:
    """Each text stored as an image, read back and described."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary())])
        for batch in slices(batches, 1):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                n, media = stored(text, kind)
                pixels = decode(media)
                payload = pixels.tobytes()
                feature, tile = difference_hash(pixels)
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature, npy(tile)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, SCHEMA)


def write_tiles(media: DataFrame, path: str, content: str = "content", height: int = 64, width: int = 64) -> DataFrame:
    """Image files of the column ``content`` (NULL or unreadable ones become NULL tiles with the reason) resized and written as a table of NPY tiles.

    Spark's committer makes the write whole or absent; the returned table has the other columns, ``tile``, ``difference_hash``, ``error``.
    """
    others = [c for c in media.columns if c != content and c not in ("tile", "difference_hash", "error")]
    kinds = media.select(*others).schema.fields

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles: list[bytes | None] = []
            hashes: list[str | None] = []
            errors: list[str | None] = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    if data is None:
                        raise ValueError("no content")
                    pixels, most = read(data)
                    tile, found = npy(tile_of(pixels, most, height, width)), difference_hash(pixels, most)[0]
                    tiles.append(tile), hashes.append(found), errors.append(None)
                except (ValueError, IndexError, struct.error) as e:
                    tiles.append(None), hashes.append(None), errors.append(str(e))
            arrays = [*batch.columns[:-1], pa.array(tiles, pa.binary()), pa.array(hashes, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*others, "tile", "difference_hash", "error"])

    from pyspark.sql import types as T

    schema = T.StructType([*kinds, T.StructField("tile", T.BinaryType()), T.StructField("difference_hash", T.StringType()), T.StructField("error", T.StringType())])
    media.select(*others, F.col(content).cast("binary")).mapInArrow(rows, schema).write.parquet(path)
    return media.sparkSession.read.parquet(path)
