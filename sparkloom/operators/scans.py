"""Scans over large groups in parallel: running sums and maxima, merged intervals, chunks by size.

Rows are sorted by ranges of (group, order) and written once. A scan then runs inside each
range, and what a range begins with is the scan of the totals of the ranges before it: a
table with a row for each range and group. So one group of all rows is nobody's single
task, and nothing is looked at twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import written

_AGGREGATES = {"sum": F.sum, "max": F.max}


def ranged(df: DataFrame, by: list[str], order: list[str], name: str = "ranges") -> DataFrame:
    """df with _part and _at: its range, and its place among all rows. Rows that ``order`` leaves equal should be told apart by it."""
    keys = [*by, *order]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    return written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)


def running(parts: DataFrame, by: list[str], value: Column, kind: str, out: str, inclusive: bool = False) -> DataFrame:
    """What ranged() gave, with the sum or maximum of value over the rows of the group before each one (inclusive: and itself). A sum over none is 0, a maximum null."""
    total = _AGGREGATES[kind]
    held = parts.withColumn("_v", value)
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ends = held.groupBy(*by, "_part").agg(total("_v").alias("_t"))
    # One row for each range (and group): few.
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_c", total("_t").over(before)).drop("_t")
    same = F.col("l._part") == F.col("r._part")
    for c in by:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    joined = held.withColumn("_own", total("_v").over(inside)).alias("l").join(carried.alias("r"), same)
    scanned = F.coalesce("l._own", F.lit(0)) + F.coalesce("r._c", F.lit(0)) if kind == "sum" else F.greatest("l._own", "r._c")
    return joined.select(*[F.col(f"l.`{c}`") for c in parts.columns], scanned.alias(out))


def _islands(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Intervals in order with _before, the latest end so far, and _new, whether they begin behind it. Null starts or ends are left out."""
    known = df.select(*by, F.col(start).alias("start"), F.col(end).alias("end")).where("start IS NOT NULL AND end IS NOT NULL")
    scanned = running(ranged(known, by, ["start", "end"], "intervals"), by, F.col("end"), "max", "_before")
    return scanned.withColumn("_new", F.col("_before").isNull() | (F.col("start") > F.col("_before")))


def interval_union(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals merged: by..., start, end, n. Islands are joined over the seams of ranges; equal intervals count each."""
    numbered = running(_islands(df, by, start, end), by, F.col("_new").cast("long"), "sum", "_island", inclusive=True)
    return numbered.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def idle_gaps(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Idle time between merged intervals: by..., gap_start, gap_end, strictly positive. The first interval of an island knows the latest end before it."""
    return _islands(df, by, start, end).where("_new AND _before IS NOT NULL").select(*by, F.col("_before").alias("gap_start"), F.col("start").alias("gap_end"))


def numbered(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """df with a row's place in its group, from 0."""
    return running(ranged(df, by, order, "numbers"), by, F.lit(1).cast("long"), "sum", out).drop("_part", "_at")


def chunks(df: DataFrame, by: list[str], order: str, size: str, capacity: int, out: str = "chunk") -> DataFrame:
    """df with the number of each row's chunk; a chunk closes when its sizes reach the capacity. Null sizes count as 0.

    Every row knows where the chunk that it might open would end: the first place whose sum of
    sizes before it is large enough, found by sorting such sums and bounds together. The
    rows that do open a chunk are those on the way from the group's first row along these
    pointers; they are marked in rounds in which pointers double their reach.
    """
    if capacity <= 0:
        raise ValueError("a chunk must hold something")
    sizes = F.coalesce(F.col(size), F.lit(0)).cast("long")
    parts = ranged(df, by, [order], "chunk-rows")
    placed = running(running(parts, by, F.lit(1).cast("long"), "sum", "_i"), by, sizes, "sum", "_s").drop("_part", "_at")
    placed = written(placed, "chunk-sums")
    group = F.struct(*by) if by else F.lit(0)
    rows = placed.select(F.to_json(group, {"ignoreNullFields": "false"}).alias("g") if by else F.lit("").alias("g"), F.col("_i").alias("i"), F.col("_s").alias("s"))
    # A bound stands before the sums that equal it, so the count of sums before it is the place of the first one that is large enough.
    events = rows.select("g", F.col("s").alias("v"), F.lit(1).cast("long").alias("one"), "i").unionByName(rows.select("g", (F.col("s") + capacity).alias("v"), F.lit(0).cast("long").alias("one"), "i"))
    met = running(ranged(events, ["g"], ["v", "one", "i"], "chunk-bounds"), ["g"], F.col("one"), "sum", "nxt")
    jumps = written(met.where("one = 0").select("g", "i", "nxt"), "chunk-jumps")
    ends = rows.groupBy("g").agg(F.count("*").alias("n"))
    jumps = written(jumps.join(ends, "g").where("nxt < n").select("g", "i", "nxt"), "chunk-jumps")
    starts = written(rows.where("i = 0").select("g", "i"), "chunk-starts")
    while not jumps.isEmpty():
        reached = starts.join(jumps, ["g", "i"]).select("g", F.col("nxt").alias("i"))
        starts = written(starts.unionByName(reached).distinct(), "chunk-starts")
        onward = jumps.select("g", F.col("i").alias("a"), F.col("nxt").alias("i")).join(jumps, ["g", "i"])
        jumps = written(onward.select("g", F.col("a").alias("i"), "nxt"), "chunk-jumps")
    flagged = rows.select("g", "i").join(starts.withColumn("opens", F.lit(1).cast("long")), ["g", "i"], "left").select("g", "i", F.coalesce("opens", F.lit(0)).alias("opens"))
    told = running(ranged(flagged, ["g"], ["i"], "chunk-flags"), ["g"], F.col("opens"), "sum", "_k", inclusive=True).select(F.col("g").alias("_g"), F.col("i").alias("_i"), "_k")
    keyed = placed.withColumn("_g", F.to_json(group, {"ignoreNullFields": "false"}) if by else F.lit(""))
    return keyed.join(told, ["_g", "_i"]).select(*df.columns, (F.col("_k") - 1).cast("int").alias(out))
