"""Longest-processing-time scheduling of groups onto shards.

Groups that must stay together are taken largest first, each to the shard with the
least load so far (a heap). The heap runs over size classes: a size is exact up to
16 significant bits, so there are at most 2^16 + 2^15 * 48 classes whatever the
number of groups, and what a class's groups do one after another is worked out by
the heap for the class as a whole where its count is large. Which group of a class
goes where follows from its rank, computed in parallel.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import parallelism, running_offsets, stash, table, unstash

#: Significant bits of a group's size.
SIZE_BITS = 16
#: Rows of a plan that is broadcast at most: a class and an upper end for each shard.
MOST_BROADCAST = 50_000


def _deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard gets by the greedy rule; adds them to loads.

    Whole rounds first: after the shards are level to within one size, the greedy rule
    gives each shard one group a round, so all but the last rounds are a division.
    """
    n = len(loads)
    got = [0] * n
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    while count:
        load, k = heap[0]
        if count >= 2 * n and max(x for x, _ in heap) - load <= size:
            rounds = count // n - 1
            heap = [(x + rounds * size, j) for x, j in heap]
            heapq.heapify(heap)
            got = [g + rounds for g in got]
            count -= rounds * n
            continue
        # Up to level with the next lightest this shard takes all.
        second = min(heap[1:3], default=None)
        take = 1 if second is None or size == 0 else max(1, min(count, -(-(second[0] - load) // size)))
        take = count if n == 1 else take
        heapq.heapreplace(heap, (load + take * size, k))
        got[k] += take
        count -= take
    for load, k in heap:
        loads[k] = load
    return got


def lpt_classes(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """classes: (class, groups, bytes of them all). Per class the running upper ends of ranks by shard, lightest first."""
    loads = [0] * shards
    out = []
    for size, count, total in sorted(classes, reverse=True):
        # The mean size, so that loads follow the true bytes; sizes of one class differ by less than 2^-15 of it.
        got = _deal(loads, max(1, round(total / count)), count)
        ends, end = [], 0
        for g in got:
            end += g
            ends.append(end)
        out.append((size, ends))
    return out


def lpt_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into a shard; documents with equal texts stay together.

    Rows: the id, size long (UTF-8 bytes of the text plus 1), text_crc32 long,
    digest binary, shard int, slot long (gapless from 0 in each shard, in ascending
    order of id, nulls first). A null text counts as the empty one, so the two form
    one group. Repeated rows are kept, each with a slot of its own. Fewer groups
    than shards leave shards empty; an empty table gives no rows. Very long texts count
    whole. Other columns are not read, whatever their names; groups of the same size
    are dealt by digest. Texts are read once and never shuffled; only ids, sizes and
    digests move.

    Groups of 2^SIZE_BITS bytes and more are scheduled by the mean size of their class, whose sizes differ by
    less than one part in 2^(SIZE_BITS - 1): a heap over single groups would run in one process over all of them.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stash(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    shift = F.greatest(F.lit(0), F.length(F.bin("bytes")) - SIZE_BITS)
    groups = groups.withColumn("shift", shift.cast("int")).withColumn("class", F.expr("shiftleft(shiftright(bytes, shift), shift)"))
    # A range partition by (class, digest): a class with very many groups spans partitions.
    groups = groups.repartitionByRange(parallelism(spark), "class", "digest").select(F.spark_partition_id().alias("pid"), "class", "digest", "bytes")
    groups = stash(groups, "shard-groups")
    by_part = groups.groupBy("class", "pid").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()  # classes are bounded, and a class's parts are neighbours
    totals: dict[int, list[int]] = {}
    for r in by_part:
        t = totals.setdefault(r["class"], [0, 0])
        t[0] += r["n"]
        t[1] += r["b"]
    dealt = lpt_classes([(c, n, b) for c, (n, b) in totals.items()], shards)
    plan = spark.createDataFrame(dealt, "class long, ends array<long>")
    offsets = running_offsets(spark, by_part, ["class", "pid"], "n", "class long, pid int, before long")
    rank = F.row_number().over(Window.partitionBy("class", "pid").orderBy("digest")) - 1
    # Both tables have a row for each class (and partition), at most; they are broadcast only while they are few.
    near = F.broadcast if len(by_part) <= MOST_BROADCAST else lambda x: x
    ranked = groups.withColumn("rank", rank).join(near(offsets), ["class", "pid"]).join(near(plan), "class")
    # Written, so that the join can split a text that very many rows share.
    placed = stash(ranked.select("digest", F.size(F.filter("ends", lambda e: e <= F.col("rank") + F.col("before"))).cast("int").alias("shard")), "shard-groups-placed")

    ordered = rows.join(placed, "digest").repartitionByRange(parallelism(spark), "shard", F.col("_id").asc_nulls_first(), "digest")
    ordered = stash(ordered.select(F.spark_partition_id().alias("pid"), "*"), "shard-order")
    counts = ordered.groupBy("shard", "pid").agg(F.count("*").alias("n")).collect()
    offsets = running_offsets(spark, counts, ["shard", "pid"], "n", "shard int, pid int, before long")
    local = F.row_number().over(Window.partitionBy("shard", "pid").orderBy(F.col("_id").asc_nulls_first(), "digest")) - 1
    out = ordered.withColumn("local", local).join(F.broadcast(offsets), ["shard", "pid"])
    unstash(rows)
    unstash(groups)
    unstash(placed)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "digest", "shard", (F.col("local") + F.col("before")).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lpt_shards(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
