"""A buffer of groups on a stream: full groups go out, groups that wait too long are carried over.

State is the rows of each open group and one timer. A group that is full leaves at once;
one that gets no row for ``timeout_ms`` leaves as it is, with the number of the rollout in which it
began, so that a later rollout can take it up again. Each row leaves exactly once: state and
input places are in the checkpoint, and every micro-batch writes a folder of its own, which a
repeated batch replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Setting that the timers need; to be set before the stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: How a group left: full, or timed out.
COMPLETE, CARRIED = "complete", "carried"


class _Group(StatefulProcessor):
    """Holds a key's rows until ``size`` of them count, or until the timer ends."""

    def __init__(self, key: str, schema: StructType, size: int, timeout_ms: int, counts: str | None, rollout: str):
        self.key, self.schema, self.size, self.timeout_ms, self.counts, self.rollout = key, schema, size, timeout_ms, counts, rollout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.start = handle.getValueState("start", StructType([StructField("start", LongType()), StructField("n", IntegerType())]))

    def _leave(self, key: tuple, kind: str) -> pd.DataFrame:
        names = self.schema.names
        rows = [dict(zip(names, r, strict=True)) for r in self.rows.get()]
        start, _ = self.start.get()
        self.rows.clear()
        self.start.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return pd.DataFrame([{self.key: key[0], **r, "start_rollout": start, "how": kind} for r in rows], columns=[self.key, *names, "start_rollout", "how"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.start.get() if self.start.exists() else (None, 0)
        for batch in rows:
            for r in batch[self.schema.names].itertuples(index=False, name=None):
                values = tuple(None if v is None or v is pd.NA or isinstance(v, float) and v != v else v for v in r)
                row = dict(zip(self.schema.names, values, strict=True))
                self.rows.appendValue(values)
                began = row.get(self.rollout)
                start = began if start is None else start if began is None else min(start, began)
                n += bool(self.counts is None or str(row.get(self.counts) or "").strip())
                self.start.update((None if start is None else int(start), n))
                # Rows behind a full group open the next one.
                if n >= self.size:
                    yield self._leave(key, COMPLETE)
                    start, n = None, 0
        if self.start.exists():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.start.exists():
            yield self._leave(key, CARRIED)

    def close(self) -> None:
        pass


def hold_groups(rows: DataFrame, key: str, columns: list[str], size: int, timeout_ms: int, rollout: str, counts: str | None = None) -> DataFrame:
    """A stream of the rows of groups that have left: key, columns, start_rollout, how ("complete" or "carried").

    size: rows that make a group full; with counts only those whose text in that column is not blank.
    rollout: a column (one of columns) with the rollout in which a row was made; the least one is the group's start. Null keys are a group.
    """
    if rollout not in columns:
        raise ValueError(f"{rollout} is not one of the columns that are held")
    schema = StructType([rows.schema[c] for c in columns])
    out = StructType([rows.schema[key], *schema.fields, StructField("start_rollout", LongType()), StructField("how", StringType())])
    return rows.groupBy(key).transformWithStateInPandas(_Group(key, schema, size, timeout_ms, counts, rollout), outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


def keep(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts the stream: rows go to path/how=.../batch=... A batch that is done again after a failure replaces its own folder.

    trigger: as Spark takes it; without one, a single batch over what is there. (Timers of processing time keep an availableNow run going for ever.)
    """

    def write(batch: DataFrame, number: int) -> None:
        # Every partition folder of this batch, and no other, is replaced.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("how", "batch").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"once": True})).start()


def groups(spark: SparkSession, path: str, how: str) -> DataFrame:
    """The rows that left in this way."""
    return spark.read.parquet(path).where(F.col("how") == how).drop("how", "batch")


def newest(spark: SparkSession, path: str, key: str, time: str, n: int) -> DataFrame | None:
    """The rows of the n newest full groups, by their latest row (ties: the smaller key); None while there are fewer."""
    done = groups(spark, path, COMPLETE)
    latest = done.groupBy(key).agg(F.max(time).alias("_latest")).orderBy(F.desc("_latest"), key).limit(n)
    if latest.count() < n:
        return None
    return done.join(latest.select(key), key, "left_semi")
