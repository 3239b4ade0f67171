"""Structured Streaming: group completion, idle sessions, failure quarantine, late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def complete_groups(rows: DataFrame, key: str, columns: list[str], size: int, timeout_ms: int | None = None) -> DataFrame:
    """Rows of a stream held by key until ``size`` of them have come; then all are emitted and forgotten.

    timeout_ms: processing time after which an incomplete group is dropped (None: never).
    State is one list for each open group, never more than ``size`` rows long.
    """
    kinds = dict(rows.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in (key, *columns))
    state = ", ".join(f"{c} array<{kinds[c]}>" for c in columns)

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        parts = [pd.DataFrame(dict(zip(columns, held.get, strict=True)))] if held.exists else []
        rows = pd.concat([*parts, *(b[columns] for b in batches)], ignore_index=True)
        while len(rows) >= size:
            done, rows = rows.iloc[:size], rows.iloc[size:]
            yield done.assign(**{key: k[0]})[[key, *columns]]
        if len(rows):
            held.update(tuple(rows[c].tolist() for c in columns))
            if timeout_ms:
                held.setTimeoutDuration(timeout_ms)
        elif held.exists:
            held.remove()

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, out, state, "append", timeout)


def idle_sessions(rows: DataFrame, key: str, ts: str, idle: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after an idle time; on streams the watermark closes them."""
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    w = F.session_window(ts, idle)
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def quarantined(rows: DataFrame, key: str, order: str, failed: str, limit: int) -> DataFrame:
    """Keys with ``limit`` failures in a row at some time; a success in between resets the count, nothing lifts a quarantine."""
    from sparkloom.operators.groups import run_lengths

    return run_lengths(rows, [key], [order], failed).where(F.col(failed) & (F.col("run_length") >= limit)).select(key).distinct()


def tumbling(rows: DataFrame, ts: str, by: list[str], width: str, late: str) -> DataFrame:
    """An extension: counts in time windows, with a bound on lateness."""
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sink(rows: DataFrame, path: str, checkpoint: str):
    """Metrics of each micro-batch to (step, key, value) rows in Parquet."""

    def write(batch: DataFrame, step: int) -> None:
        keys = [c for c, t in batch.dtypes if t in ("bigint", "int", "double", "float")]
        wide = batch.select(*[F.col(c).cast("double").alias(c) for c in keys])
        wide.unpivot([], keys, "key", "value").withColumn("step", F.lit(step)).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
