"""Aggregations that report on groups, tasks, streams and timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def four_stats(value: str, prefix: str = "") -> list[Column]:
    return [F.avg(value).alias(f"{prefix}mean"), F.median(value).alias(f"{prefix}median"), F.max(value).alias(f"{prefix}max"), F.min(value).alias(f"{prefix}min")]


def pass_at_k_estimate(n: Column, c: Column, k: Column) -> Column:
    """Unbiased estimate that one of k draws from n, c of them right, is right."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - k / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(1 - product)


def pass_at_k(df: DataFrame, group: list[str], correct: Column) -> DataFrame:
    """Mean estimate for k = 1, 2, 4, ... up to each group's size; groups of one give nothing."""
    groups = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(correct).alias("c")).where("n > 1")
    ks = F.transform(F.sequence(F.lit(0), F.floor(F.log2("n")).cast("int")), lambda e: F.pow(F.lit(2), e).cast("long"))
    return groups.select("n", "c", F.explode(ks).alias("k")).select("k", pass_at_k_estimate(F.col("n"), F.col("c"), F.col("k")).alias("p")).groupBy("k").agg(F.avg("p").alias("pass_at_k"))


def zero_variance(df: DataFrame, group: list[str], reward: str, least: int = 1) -> DataFrame:
    """Groups of at least ``least`` non-null rewards that are all equal, counted by the reward rounded to one place."""
    groups = df.groupBy(*group).agg(F.min(reward).alias("lo"), F.max(reward).alias("hi"), F.count(reward).alias("n"))
    return groups.where((F.col("lo") == F.col("hi")) & (F.col("n") >= least)).groupBy(F.round("lo", 1).alias("reward")).agg(F.count("*").alias("groups"))


def category_share(df: DataFrame, category: str) -> DataFrame:
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each category


def task_success(df: DataFrame, task: list[str], value: str, by: list[str]) -> DataFrame:
    """Best value of each task (0 at least), then the mean over tasks."""
    best = df.groupBy(*by, *task).agg(F.greatest(F.max(value), F.lit(0.0)).alias("best"))
    return best.groupBy(*by).agg(F.avg("best").alias("task_success"), F.count("*").alias("tasks"))


def rollup_report(df: DataFrame, dims: list[str], aggregates: list[Column]) -> DataFrame:
    """The aggregates for all rows and for each leading part of dims; level tells how many dims are rolled up."""
    return df.rollup(*dims).agg(F.grouping_id().alias("level"), *aggregates)


def masked_mean(values: Column, mask: Column) -> Column:
    """Sum of masked values over the mask's sum, 1 at least."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: (v * m).cast("double")), F.lit(0.0), lambda a, x: a + x)
    return total / F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))


def histogram_share(value: Column, total: Column, bins: int) -> Column:
    """Number of the first of ``bins`` equal parts of total that holds value; beyond the last: null."""
    b = F.greatest(F.ceil(value * bins / total), F.lit(1))
    return F.when(b <= bins, b)


def threshold_rules(rules: dict[str, tuple[Column, str]]) -> Column:
    """Array of (rule, severity) that hold in a row."""
    return F.filter(F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, (cond, severity) in rules.items()]), lambda x: x.isNotNull())


def conditional_report(df: DataFrame, by: list[str], means: dict[str, tuple[Column | None, Column]], stats: dict[str, Column]) -> DataFrame:
    """scope (the values of ``by``, or all), key, value: means under conditions, and mean, median, largest and least of others, over all rows and for each group, in one pass.

    means: name to (condition or None, value); a mean over no row is null and has no row. stats: name to value.
    """
    aggregates = [F.avg(value if held is None else F.when(held, value)).alias(name) for name, (held, value) in means.items()]
    for name, value in stats.items():
        aggregates += [f(value).cast("double").alias(f"{name}/{kind}") for kind, f in (("mean", F.avg), ("median", F.median), ("max", F.max), ("min", F.min))]
    sets = df.groupingSets([[], by], *by).agg(F.grouping_id().alias("_set"), *aggregates)
    scope = F.when(F.col("_set") > 0, "all").otherwise(F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by]))
    names = [*means, *(f"{n}/{k}" for n in stats for k in ("mean", "median", "max", "min"))]
    wide = sets.select(scope.alias("scope"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return wide.unpivot(["scope"], names, "key", "value").where("value IS NOT NULL")
