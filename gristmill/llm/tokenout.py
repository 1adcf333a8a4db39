"""Training-order materialisation of token ids.

Documents are tokenised once, each cut into sequences of LENGTH ids at most. A sequence's row number is its place in an order of contents: sequences are
dealt to BUCKETS by a hash of doc_id, piece and ids, sorted inside a bucket, and written to the shared folder; the table of bucket sizes is bounded and
broadcast. So the same rows get the same numbers however the input is split. A keyed Feistel permutation with cycle walking turns the row number
into a global slot. Ranges of slots, ``per_shard`` to a shard, go to one task each and are written as one file a shard, records of one fixed
stride in slot order: slot s is in shard s div per_shard at byte (s mod per_shard) * stride, so reads are sequential and go on from any slot.

A record is the number of ids (4 bytes), whether doc_id is NULL (1), doc_id (8), piece (4), LENGTH ids of 2 bytes (the vocabulary has
fewer than 65,536), little-endian, zeros at the end, and the line end that Spark's text writer adds. That writer reaches every store that Spark does, and its committer
makes a shard whole or absent; one that a lost executor was writing is written again, with the same bytes. Shards are written in WAVES ranges one after the other, so that only
a part of the sequences is in shuffle files at a time; the file ``_COMPLETE`` comes last.

A NULL or empty text is the end id alone. NULL and repeated doc_ids are kept; rows alike in doc_id and text are counted before the shuffle and get
neighbouring numbers. An empty table gives no sequences and no shards. Other columns are ignored. A very long text is many sequences, spread over shards like any others.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import feistel, tokens
from .common import cleaned_up, discard, durable, shared_folder, slices

LENGTH, PER_SHARD, BUCKETS, WAVES, KEY = 512, 4096, 4096, 3, "training order"
HEAD, COMPLETE = "<I?qI", "_COMPLETE"
SEQUENCES = "doc_id long, piece int, n int, slot long, shard long, byte_offset long, ids_crc32 long"


def stride(length: int = LENGTH) -> int:
    return struct.calcsize(HEAD) + 2 * length + 1


def record(doc_id: int | None, piece: int, ids: bytes, length: int) -> bytes:
    return struct.pack(HEAD, len(ids) // 2, doc_id is None, doc_id or 0, piece) + ids + bytes(2 * length - len(ids))


def unpack(data: bytes) -> tuple[int | None, int, np.ndarray]:
    """doc_id, piece and ids of a record."""
    n, null, doc_id, piece = struct.unpack_from(HEAD, data)
    return None if null else doc_id, piece, np.frombuffer(data, "<u2", n, struct.calcsize(HEAD))


def tokenised(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """doc_id, piece, ids (unsigned 16 bit numbers) and how many such rows are alike here."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary()), ("alike", pa.int64())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for batch in slices(batches, 1):
            docs_here = Counter(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            rows = []
            for (doc, text), alike in docs_here.items():
                ids = np.array([*encode(text or ""), tokens.END], "<u2")
                rows += [(doc, k, ids[at : at + length].tobytes(), alike) for k, at in enumerate(range(0, len(ids), length))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, piece int, ids binary, alike long")


def _ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows the number of rows before them in their bucket."""
    open_, before = -1, 0
    for batch in batches:
        bucket, alike = batch.column(0).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
        if not len(bucket):
            continue
        ends = np.cumsum(alike)
        fresh = np.flatnonzero(np.concatenate([[bucket[0] != open_], bucket[1:] != bucket[:-1]]))
        base = np.full(len(bucket), before)
        for at in fresh.tolist():
            base[at:] = -(ends[at] - alike[at])
        rank = base + ends - alike
        open_, before = int(bucket[-1]), int(rank[-1] + alike[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "rank"])


def slotted(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY, path: str | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame, int]:
    """The sequences with slot and shard, the written table they are read from, and how many they are."""
    rows = tokenised(docs, length, path)
    place = F.xxhash64("doc_id", "piece", "ids")
    dealt = rows.select(F.pmod(place, F.lit(buckets)).alias("bucket"), place.alias("place"), "doc_id", "piece", "ids", "alike").repartition("bucket")
    numbered = dealt.sortWithinPartitions("bucket", "place", "doc_id", "piece", "ids").mapInArrow(_ranked, "bucket long, place long, doc_id long, piece int, ids binary, alike long, rank long")
    kept = durable(numbered.drop("place"))
    sizes = kept.groupBy("bucket").agg(F.sum("alike").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    starts = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    number = F.col("start") + F.col("rank") + F.col("i")
    each = kept.join(F.broadcast(starts), "bucket").withColumn("i", F.explode(F.expr("sequence(0L, alike - 1)")))

    # Only the numbers go to Python. Said to be nondeterministic so that it is worked out once a row, not again in each filter on the shard.
    @F.arrow_udf("long")
    def slots(numbers: pa.Array) -> pa.Array:
        return pa.array(feistel.permute_array(numbers.to_numpy(zero_copy_only=False), total, key))

    placed = each.withColumn("slot", slots.asNondeterministic()(number)).withColumn("shard", F.expr(f"slot div {per_shard}L"))
    return placed.select("doc_id", "piece", "ids", "slot", "shard"), kept, total


def write_shards(docs: DataFrame, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY, path: str | None = None) -> int:
    """Writes the shards below ``folder``, which must not exist, a file in each ``shard=N``; how many sequences."""
    if _path(docs.sparkSession, folder).getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).exists(_path(docs.sparkSession, folder)):
        raise FileExistsError(folder)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            made = [record(d, p, i, length) for d, p, i in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(4)], ["record", "shard"])

    spark = docs.sparkSession
    rows, kept, total = slotted(docs, length, per_shard, key, path)
    shards = -(-total // per_shard)
    # Neighbouring shards go to one task, as many to each; their numbers are known, so nothing is sampled for the ranges.
    tasks = max(1, min(-(-shards // WAVES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for wave in range(WAVES):
        first, last = shards * wave // WAVES, shards * (wave + 1) // WAVES
        if first == last:
            continue
        own = rows.where((F.col("shard") >= first) & (F.col("shard") < last))
        ranged = own.repartitionById(tasks, F.expr(f"cast((shard - {first}) * {tasks} div {last - first} as int)")).sortWithinPartitions("shard", "slot")
        with cleaned_up(spark):
            ranged.mapInArrow(packed, "record binary, shard long").select(F.col("record").cast("string"), "shard").write.mode("append").partitionBy("shard").text(folder)
    discard(kept)
    _path(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration()).create(_path(spark, f"{folder}/{COMPLETE}")).close()
    return total


def _path(spark: SparkSession, name: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def read_shards(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """doc_id, piece, n, slot, shard, byte_offset, ids_crc32 (of the ids as unsigned 32 bit numbers) of each record of the files in ``folder``."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n", pa.int32()), ("slot", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("ids_crc32", pa.int64())])
    step = stride(length)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(data) % step:
                    raise ValueError(f"shard {shard} is cut short")
                out = []
                for at in range(0, len(data), step):
                    doc, piece, ids = unpack(data[at : at + step])
                    out.append((doc, piece, len(ids), shard * per_shard + at // step, shard, at, zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0")
    return files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"), "content").mapInArrow(scan, SEQUENCES)


def sequences(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY, path: str | None = None) -> DataFrame:
    """Writes the shards to the shared folder and reads every record back."""
    folder = shared_folder(docs.sparkSession)
    if not write_shards(docs, folder, length, per_shard, key, path):
        return docs.sparkSession.createDataFrame([], SEQUENCES)
    return read_shards(docs.sparkSession, folder, length, per_shard)


def read_from(spark: SparkSession, folder: str, slot: int, length: int = LENGTH, per_shard: int = PER_SHARD, records: int = 256) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, piece and ids of the sequences from ``slot`` on: each shard's file is opened at the record's byte and read on, ``records`` at a time, without a Spark job."""
    path = lambda name: _path(spark, name)
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(f"{folder}/{COMPLETE}")):
        raise FileNotFoundError(f"{folder} is not complete")
    shard, step = slot // per_shard, stride(length)
    at = slot % per_shard * step
    while files.exists(path(f"{folder}/shard={shard}")):
        for status in files.listStatus(path(f"{folder}/shard={shard}")):
            data = files.open(status.getPath())
            try:
                data.seek(min(at, status.getLen()))
                while block := bytes(data.readNBytes(records * step)):
                    for k in range(0, len(block), step):
                        yield unpack(block[k : k + step])
            finally:
                data.close()
        shard, at = shard + 1, 0
