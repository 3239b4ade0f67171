"""Shared helpers: table access, written intermediates, text to words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]"

#: Setting by which Spark removes a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of one Arrow batch: bounds a Python worker's memory also when every text is very long.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to BATCH_ROWS rows if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def merged(batches, column: int, least: int = 6 << 20):
    """Record batches put together until the given column holds at least so many bytes: short texts come in larger batches, long ones don't."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= least:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(batches):
    import pyarrow as pa

    return batches[0] if len(batches) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)], batches[0].schema.names)


def trim() -> None:
    """Give back what a Python worker no longer uses but still holds: workers are kept between stages, and an executor's memory is shared."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: the memory is just kept
        pass


def settle(spark: SparkSession) -> None:
    """Have the driver give back its garbage. A chain of many small queries leaves plans and tables of small joins behind, for which the heap grows before they are collected."""
    trim()
    spark._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session that names none (tests) gets a temporary one; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go as soon as it has ended."""
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if held is None else spark.conf.set(_CLEANUP, held)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return a frame that reads it.

    This cuts the lineage: what is lost with an executor is read again, not computed again.
    The shuffle files behind df are removed when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Remove the files of a frame from stash() that nothing reads any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_offsets(spark: SparkSession, counts: list, keys: list[str], value: str, schema: str) -> DataFrame:
    """counts: rows of (keys..., n), one a partition. A frame with the sum of n in the rows before, per leading key.

    The list has a row for each partition (times a small number of leading keys), so it does not grow with the data.
    """
    out, before = [], {}
    for row in sorted(counts, key=lambda r: tuple(r[k] for k in keys)):
        lead = tuple(row[k] for k in keys[:-1])
        out.append((*(row[k] for k in keys), before.get(lead, 0)))
        before[lead] = before.get(lead, 0) + row[value]
    return spark.createDataFrame(out, schema)


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
