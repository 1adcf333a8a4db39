"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets Spark delete the shuffle files of a statement when it ends; read for each statement.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; a file of few row groups, which few tasks could read, is dealt out to all cores."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = row_groups(found)
    return found.repartition(spark.sparkContext.defaultParallelism) if groups is not None and groups < spark.sparkContext.defaultParallelism else found


def row_groups(table: DataFrame) -> int | None:
    """The row groups of a table of one file, read from its footer; None for several files, which are splits enough or cheap to read."""
    files = table.inputFiles()
    if len(files) != 1:
        return None
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(files[0]), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return reader.getRowGroups().size()
    finally:
        reader.close()


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, deleted when the driver ends.

    Where the setting is missing, the context's checkpoint folder is taken; on a single machine (tests, a notebook) one is made.
    On a cluster its absence is an error: a folder of one machine is lost with it.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        known = context._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-"))
            known = context._jsc.sc().getCheckpointDir()
        top = known.get()
    path = f"{top.rstrip('/')}/gristmill-{uuid.uuid4().hex}"
    _filesystem(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _filesystem(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Statements inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, a lost executor costs nothing, its shuffle files go at once.

    ``discard`` deletes the table when nothing reads it any more; else it goes with the driver.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._durable_path = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes what ``durable`` has written for these tables."""
    for table in tables:
        path = table.__dict__.pop("_durable_path", None)
        if path:
            _filesystem(table.sparkSession, path).delete(table.sparkSession._jvm.org.apache.hadoop.fs.Path(path), True)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the column as text, modulo ``divisor``; NULL counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_column(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def text_hash(text: Column) -> Column:
    """128 bits of a text; equal hashes are taken for equal texts."""
    return F.unhex(F.md5(text_column(text).cast("binary")))


def slices(batches: Iterable[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``most`` bytes of the text column, or one row: bounds a worker's memory."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * most / max(batch.column(text).nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else pa.large_binary()).to_pylist()
