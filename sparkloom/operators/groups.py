"""Group normalisation and ordered-window operators over flat rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_zscore(df: DataFrame, group: list[str], reward: str, epsilon: float = 1e-6, sample: bool = False, single: str = "keep", out: str = "reward_norm") -> DataFrame:
    """(reward - mean) / (deviation + epsilon) inside each group; null rewards count as 0.

    sample: the sample instead of the population deviation. single: what a group of one
    gives, "keep" its reward or "nan".
    """
    w = Window.partitionBy(*group)
    r = F.coalesce(F.col(reward), F.lit(0.0))
    deviation = F.stddev_samp(r).over(w) if sample else F.stddev_pop(r).over(w)
    alone = r if single == "keep" else F.lit(float("nan"))
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) <= 1, alone).otherwise((r - F.avg(r).over(w)) / (deviation + epsilon)))


def centre(df: DataFrame, group: list[str], reward: str, out: str = "reward_norm") -> DataFrame:
    return df.withColumn(out, F.col(reward) - F.avg(reward).over(Window.partitionBy(*group)))


def bounded_zscore(df: DataFrame, group: list[str], reward: str, epsilon: float = 1e-8, out: str = "reward_norm") -> DataFrame:
    """Only rewards in [0, 1] set mean and deviation and are changed; all zero: unchanged; no spread: 0."""
    w = Window.partitionBy(*group)
    r = F.col(reward)
    valid = F.when(r.between(0, 1), r)
    deviation = F.stddev_pop(valid).over(w)
    scaled = F.when(F.max(F.abs(valid)).over(w) == 0, r).when(deviation < epsilon, F.lit(0.0)).otherwise((r - F.avg(valid).over(w)) / deviation)
    return df.withColumn(out, F.when(valid.isNull(), r).otherwise(scaled))


def step_zscore(df: DataFrame, episode: str, step: str, reward: str, won: str, epsilon: float = 1e-8, out: str = "reward_norm") -> DataFrame:
    """Normalise across episodes at each step. A step that one episode alone reached: -1 if lost; else the value of the episode's step before, or 1.

    Every episode has a first step, so steps are summed up (in parts) and joined back; only an episode's own steps are put in order.
    """
    stats = df.groupBy(step).agg(F.count(F.lit(1)).alias("_n"), F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_dev"))
    same = F.col(f"l.`{step}`").eqNullSafe(F.col(f"r.`{step}`"))
    met = df.alias("l").join(stats.alias("r"), same).select(*[F.col(f"l.`{c}`") for c in df.columns], "_n", "_mean", "_dev")
    base = F.when(F.col("_n") > 1, (F.col(reward) - F.col("_mean")) / (F.col("_dev") + epsilon)).when(~F.col(won), F.lit(-1.0))
    of_episode = Window.partitionBy(episode).orderBy(step)
    based = met.withColumn("_base", base).withColumn("_island", F.col(step) - F.row_number().over(of_episode))
    run = Window.partitionBy(episode, "_island").orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return based.withColumn(out, F.coalesce(F.last("_base", ignorenulls=True).over(run), F.lit(1.0))).drop("_base", "_island", "_n", "_mean", "_dev")


def strategy(df: DataFrame, step: str, won: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(step))
    return df.withColumn("strategy", F.when(n > 1, "group").when(F.col(won), "single_success").otherwise("single_failure"))


def whiten(df: DataFrame, values: str, mask: str, epsilon: float = 1e-8, shift_mean: bool = True, out: str = "white") -> DataFrame:
    """Whiten arrays by mean and unbiased variance of all masked tokens; sums reach one row, rows never one task."""
    tokens = df.select(F.explode(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))).alias("t")).where("t.m > 0")
    stats = tokens.agg(F.avg("t.v").alias("_mean"), F.coalesce(F.var_samp("t.v"), F.lit(0.0)).alias("_var"), F.assert_true(F.count("*") > 0).alias("_ok"))
    joined = df.join(F.broadcast(stats), how="cross")  # one row
    shifted = lambda x: (x - F.col("_mean")) / F.sqrt(F.col("_var") + epsilon) + (F.lit(0.0) if shift_mean else F.col("_mean"))
    return joined.withColumn(out, F.transform(values, shifted)).drop("_mean", "_var", "_ok")


def ordinal(df: DataFrame, by: list[str], order: list, out: str) -> DataFrame:
    """Place among the rows of ``by`` in order, from 0."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def spread_ordinal(df: DataFrame, by: list[str], order: str, out: str, bins: int = 200) -> DataFrame:
    """ordinal() for a few large groups: rows are numbered inside ranges of a numeric ``order``, then raised by the counts of the ranges before.

    The limits of the ranges are approximate quantiles over all rows, ``bins`` numbers; they
    only decide how evenly the rows are dealt. Nulls come first. Equal values share a range,
    so a value that many rows repeat still meets in one task.
    """
    share = [i / bins for i in range(1, bins)]
    limits = df.agg(F.percentile_approx(order, share, 10 * bins)).first()[0]
    limits = sorted(set(limits or []))
    # The number of limits that a value passes; the array is a constant of fixed size.
    passed = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x <= F.col(order))) if limits else F.lit(0)
    dealt = df.withColumn("_range", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(passed))
    counts = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    same = F.col("l._range") == F.col("r._range")
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order)) - 1
    joined = dealt.withColumn("_inside", inside).alias("l").join(before.alias("r"), same)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._inside") + F.col("r._before")).alias(out))


def prefix_list(df: DataFrame, by: list[str], order: list, value: str, out: str) -> DataFrame:
    """All values before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.collect_list(value).over(w))


def count_windows(df: DataFrame, by: list[str], order: list, size: int) -> DataFrame:
    """df with a column window_id for each full window of ``size`` consecutive rows; the rest is dropped."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn("window_id", F.floor((F.row_number().over(w) - 1) / size))
    return numbered.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "window_id"))).where(F.col("_n") == size).drop("_n")


def run_lengths(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Runs of equal neighbours: by..., value, run_length."""
    a, b = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by, value).orderBy(*order)
    island = df.withColumn("_island", F.row_number().over(a) - F.row_number().over(b))
    return island.groupBy(*by, value, "_island").agg(F.count("*").alias("run_length")).drop("_island")


#: Places of a scan that are combined by one matrix product.
SCAN_BLOCK = 64


def reverse_scan(values: np.ndarray, decay: float) -> np.ndarray:
    """out[t] = values[t] + decay * out[t + 1], in time linear in the length: blocks by a product with the powers of the decay, then the carry from block to block."""
    n = len(values)
    blocks = np.zeros((-(-n // SCAN_BLOCK), SCAN_BLOCK))
    blocks.reshape(-1)[:n] = values[::-1]
    back = np.subtract.outer(np.arange(SCAN_BLOCK), np.arange(SCAN_BLOCK))
    out = blocks @ np.where(back >= 0, np.power(float(decay), np.maximum(back, 0)), 0.0).T
    powers, carry = np.power(float(decay), np.arange(1, SCAN_BLOCK + 1)), 0.0
    for row in out:
        row += powers * carry
        carry = row[-1]
    return out.reshape(-1)[:n][::-1]


def _scanned(values: Column, decay: float) -> Column:
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else reverse_scan(np.asarray(v, float), decay) for v in batch])

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(values)


def with_scan(df: DataFrame, values: Column, decay: Column, out: str) -> DataFrame:
    """df with the reverse scan of an array of double by the row's own decay, null for null; a step of the plan by itself, so array functions may follow."""
    held = df.withColumn(out, values).withColumn("_decay", decay.cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, arrays, decays = batch.columns
            scanned = [reverse_scan(v.values.to_numpy(zero_copy_only=False), d.as_py()) if v.is_valid else None for v, d in zip(arrays, decays, strict=True)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scanned, pa.list_(pa.float64()))], batch.schema.names[:-1])

    return held.mapInArrow(run, held.drop("_decay").schema)


def gae_steps(rewards: Column, values: Column, gamma: float) -> Column:
    """r_t + gamma * v_{t+1} - v_t, with value 0 after the last step."""
    following = F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0.0)))
    return F.zip_with(F.zip_with(rewards, following, lambda r, v: r + gamma * F.coalesce(v, F.lit(0.0))), values, lambda x, v: x - v)


def discounted(values: Column, gamma: float) -> Column:
    """Array of G_t = r_t + gamma * G_{t+1}. Arrow-batched, linear in the length."""
    return _scanned(values, gamma)


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Array of generalised advantages. The differences are column expressions, the scan is Arrow-batched."""
    return _scanned(gae_steps(rewards, values, gamma), gamma * lam)
