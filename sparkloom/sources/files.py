"""Scans and sinks: JSON lines, JSON arrays, Parquet, slices, registries and traces."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import written


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file with a column _corrupt_record that is null for good lines; blank lines are skipped."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def good_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: .parquet or .jsonl, with a slice ``@[a:b]`` at the end if wished; any other suffix is an error."""
    path, rows = split_slice(path)
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return df if rows is None else row_slice(_split_rows(df), *rows)
    if path.endswith(".jsonl") and schema:
        df = read_jsonl(spark, path, schema)
        # Written, as lines that can't be read are only known when all columns are.
        return good_rows(df) if rows is None else row_slice(written(good_rows(_split_rows(df)), "lines"), *rows)
    raise ValueError(f"unsupported file: {path}")


def _split_rows(df: DataFrame) -> DataFrame:
    """A scan with the file and the start of the split that each row comes from, and a number that ascends inside it."""
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_from": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})


def row_slice(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The rows of _split_rows() from place ``first`` up to ``last``, in order: files by their paths, rows as they stand in them.

    A scan deals the largest files out first and cuts files into splits, so a plain limit takes rows from anywhere. Splits
    are counted, and only those that hold rows of the slice are numbered, each by itself.
    """
    ends = rows.groupBy("_file", "_from").agg(F.count("*").alias("_n"))
    # A row for each split.
    held = ends.withColumn("_before", F.sum("_n").over(Window.orderBy("_file", "_from")) - F.col("_n")).where((F.col("_before") < last) & (F.col("_before") + F.col("_n") > first)).drop("_n")
    place = F.row_number().over(Window.partitionBy("_file", "_from").orderBy("_at")) - 1 + F.col("_before")
    placed = rows.join(F.broadcast(held), ["_file", "_from"]).withColumn("_place", place)
    return placed.where(F.col("_place").between(first, last - 1)).orderBy("_place").drop("_file", "_from", "_at", "_before", "_place")


def split_slice(path: str) -> tuple[str, tuple[int, int] | None]:
    """``file@[a:b]`` as file and (a, b)."""
    m = re.fullmatch(r"(.+)@\[(\d*):(\d+)\]", path)
    if not m:
        return path, None
    first, last = int(m[2] or 0), int(m[3])
    return m[1], (first, max(first, last))


def read_json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of JSON array files below a path, with source_file and the element's index; unreadable files give nothing."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
    parsed = files.select(F.input_file_name().alias("source_file"), F.from_json("value", f"array<struct<{schema}>>").alias("rows"))
    return parsed.select("source_file", F.posexplode("rows").alias("task_index", "task")).select("source_file", "task_index", "task.*")


def read_companions(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """Pairs of files with the given names in one folder: folder, first, second (text, null if missing)."""

    def named(name: str, column: str) -> DataFrame:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("wholetext", True).text(path)
        return files.select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("folder"), F.col("value").alias(column))

    return named(first, "first").join(named(second, "second"), "folder", "left")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of (compressed) profiler traces: name, cat, ph, ts, dur, tid."""
    event = "array<struct<name:string,cat:string,ph:string,ts:double,dur:double,tid:bigint>>"
    return spark.read.option("multiLine", True).schema(f"traceEvents {event}").json(path).select(F.explode("traceEvents").alias("e")).select("e.*")


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def merge(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_jsonl(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.json(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.partitionBy(*by).parquet(path)


def epoch_key(ordinal: Column, seed: int) -> Column:
    """What an epoch's rows are sorted by: a digest of its seed and the row's ordinal, so every epoch starts from the original order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ordinal.cast("string")))


def cursor(df: DataFrame, ordinal: str, offset: int, n: int, seed: int) -> tuple[DataFrame, int, int]:
    """n rows from an offset on in the order of an epoch, wrapping into the next epoch's order: rows (with epoch, from 0, and place in it), new offset, epochs passed.

    df has a gapless ordinal from 0; the order of an epoch is that of epoch_key() with seed + epoch.
    """
    from sparkloom.operators.scans import numbered

    size = df.count()
    if not size:
        return df, 0, 0
    parts, epoch, at, left = [], 0, offset, n
    while left > 0:
        take = min(left, size - at)
        ordered = numbered(df.withColumn("_key", epoch_key(F.col(ordinal), seed + epoch)), [], ["_key", ordinal], "place").drop("_key")
        parts.append(ordered.where(F.col("place").between(at, at + take - 1)).withColumn("epoch", F.lit(epoch)))
        left -= take
        at += take
        if at == size:
            at, epoch = 0, epoch + 1
    return merge(parts), at, epoch


def buffer_first(buffer: DataFrame, source: DataFrame, order: str, n: int) -> DataFrame:
    """n rows, those of the buffer (in its order) before those of the source."""
    both = buffer.withColumn("_from", F.lit(0)).unionByName(source.withColumn("_from", F.lit(1)))
    return both.orderBy("_from", order).limit(n).drop("_from")


def evict(buffer: DataFrame, order: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows in order, and the rest."""
    taken = buffer.orderBy(order).limit(n)
    return taken, buffer.join(taken.select(order), order, "left_anti")


def write_index(df: DataFrame, file: list[str], order: list[str]) -> DataFrame:
    """df with place: a row's number in its file (the columns ``file``), from 0, written once so that places stay.

    Rows are numbered inside ranges and raised by the counts of the ranges before, so a file of any size needs no task of its own.
    """
    keys = [*file, *order]
    ranged = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "index")
    ends = ranged.groupBy(*file, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_own"))
    before = F.coalesce(F.sum("_own").over(Window.partitionBy(*file).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ends.select(*file, "_part", (before - F.col("_first")).alias("_shift"))
    return ranged.join(shifts, [*file, "_part"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("place"))


def look_up(index: DataFrame, asked: DataFrame, file: list[str], place: str) -> DataFrame:
    """The row of each asked (file, place); places that no file has give none."""
    return asked.join(index, [*file, place])


def save_state(spark: SparkSession, path: str, rollout: int, **places: int) -> None:
    """Keeps where a source stands (offset, epoch, indices) after a rollout; saving a rollout again replaces what it kept."""
    spark.createDataFrame([tuple(places.values())], ", ".join(f"{k} long" for k in places)).coalesce(1).write.mode("overwrite").parquet(f"{path}/rollout={rollout}")


def load_state(spark: SparkSession, path: str, rollout: int | None = None) -> dict[str, int]:
    """What was kept after a rollout, or after the last one. Nothing kept: an error."""
    held = spark.read.parquet(path)
    row = held.where(F.col("rollout") == rollout).first() if rollout is not None else held.orderBy(F.desc("rollout")).first()
    if row is None:
        raise ValueError(f"nothing was kept after rollout {rollout}")
    return row.asDict()
