"""Normalisation and ordered windows (N). Groups are orders or users, rewards are discounts or event values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import groups as G
from sparkloom.operators import scans
from sparkloom.plans.registry import query, table

EVENTS = "SELECT event_id, user_id, event_type, value AS reward, event_type = 'purchase' AS won, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events"


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", F.col("value").alias("reward"), (F.col("event_type") == "purchase").alias("won"))
    return G.ordinal(e, ["user_id"], ["ts", "event_id"], "step").withColumn("step", F.col("step") + 1)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_extendedprice")


_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")


def _z(epsilon: str, single: str = "l_discount", deviation: str = "stddev_pop", by: str = "l_orderkey") -> str:
    w = f"OVER (PARTITION BY {by})"
    return f"SELECT {', '.join(_KEYS)}, round(CASE WHEN count(*) {w} <= 1 THEN {single} ELSE (l_discount - avg(l_discount) {w}) / ({deviation}(l_discount) {w} + {epsilon}) END, 6) AS reward_norm FROM lineitem"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*_KEYS, F.round("reward_norm", 6).alias("reward_norm"))


@query(_z("1e-6"))
def n1_group_zscore(spark, sf):
    return _rounded(G.group_zscore(lines(spark, sf), ["l_orderkey"], "l_discount"))


@query(_z("1e-8"))
def n2_group_zscore_fine(spark, sf):
    return _rounded(G.group_zscore(lines(spark, sf), ["l_orderkey"], "l_discount", epsilon=1e-8))


@query(f"SELECT {', '.join(_KEYS)}, CASE WHEN reward_norm IS NULL THEN -999.0 ELSE reward_norm END AS reward_norm FROM ({_z('1e-6', 'NULL', 'stddev_samp')})")
def n3_group_zscore_sample(spark, sf):
    out = _rounded(G.group_zscore(lines(spark, sf), ["l_orderkey"], "l_discount", sample=True, single="nan"))
    return out.withColumn("reward_norm", F.when(F.isnan("reward_norm"), -999.0).otherwise(F.col("reward_norm")))


@query("SELECT event_id, round(CASE WHEN reward BETWEEN 0 AND 1 THEN CASE WHEN max(CASE WHEN reward BETWEEN 0 AND 1 THEN abs(reward) END) OVER w = 0 THEN reward WHEN stddev_pop(CASE WHEN reward BETWEEN 0 AND 1 THEN reward END) OVER w < 1e-8 THEN 0 ELSE (reward - avg(CASE WHEN reward BETWEEN 0 AND 1 THEN reward END) OVER w) / stddev_pop(CASE WHEN reward BETWEEN 0 AND 1 THEN reward END) OVER w END ELSE reward END, 6) AS reward_norm FROM (" + EVENTS + ") WINDOW w AS (PARTITION BY user_id)")
def n4_bounded_zscore(spark, sf):
    return G.bounded_zscore(events(spark, sf), ["user_id"], "reward").select("event_id", F.round("reward_norm", 6).alias("reward_norm"))


@query(
    f"""WITH e AS ({EVENTS}), b AS (SELECT *, CASE WHEN count(*) OVER s > 1 THEN (reward - avg(reward) OVER s) / (stddev_pop(reward) OVER s + 1e-8) WHEN NOT won THEN -1.0 END AS base FROM e WINDOW s AS (PARTITION BY step))
    SELECT event_id, round(coalesce(last_value(base IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0), 6) AS reward_norm FROM b"""
)
def n5_step_zscore(spark, sf):
    return G.step_zscore(events(spark, sf), "user_id", "step", "reward", "won").select("event_id", F.round("reward_norm", 6).alias("reward_norm"))


@query(_z("1e-6", by="l_orderkey, l_linenumber"))
def n6_task_zscore(spark, sf):
    return _rounded(G.group_zscore(lines(spark, sf), ["l_orderkey", "l_linenumber"], "l_discount"))


@query(
    """WITH t AS (SELECT vec_id, i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), s AS (SELECT avg(v) AS m, var_samp(v) AS s2 FROM t WHERE v > 0)
    SELECT vec_id, round(sum((v - m) / sqrt(s2 + 1e-8)), 4) AS white_sum, round(max((v - m) / sqrt(s2 + 1e-8)), 4) AS white_max FROM t, s GROUP BY vec_id"""
)
def n7_masked_whitening(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = G.whiten(e.withColumn("m", F.transform("v", lambda x: F.when(x > 0, 1).otherwise(0))), "v", "m")
    return out.select("vec_id", F.round(F.aggregate("white", F.lit(0.0), lambda a, x: a + x), 4).alias("white_sum"), F.round(F.array_max("white"), 4).alias("white_max"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS lang_index FROM documents")
def n8_row_numbers(spark, sf):
    return G.spread_ordinal(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", "lang_index").select("doc_id", F.col("lang_index").cast("long"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS nth FROM conversations")
def n9_duplicate_ordinal(spark, sf):
    return G.ordinal(table(spark, sf, "conversations"), ["conv_id", "role"], ["turn"], "nth").select("conv_id", "turn", "role", F.col("nth").cast("long"))


@query("SELECT conv_id, turn, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM conversations")
def n10_prefix_actions(spark, sf):
    return G.prefix_list(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role", "before").select("conv_id", "turn", F.array_join("before", ",").alias("before"))


_BUSY = "SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(value * 60000000 AS BIGINT) AS e FROM events"
_MERGED = f"""(SELECT event_type, min(s) AS "start", max(e) AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ({_BUSY}))) GROUP BY event_type, island)"""


def busy(spark, sf):
    us = F.expr("(datediff(ts, DATE'1970-01-01') * 86400L + hour(ts) * 3600L + minute(ts) * 60L) * 1000000L + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)")
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", us.alias("s"), (us + F.round(F.col("value") * 60000000).cast("long")).alias("e"))


@query(f'SELECT event_type, "start", "end", n FROM {_MERGED}')
def n11_interval_union(spark, sf):
    return scans.interval_union(busy(spark, sf), ["event_type"], "s", "e")


@query(f'SELECT event_type, gap_start, gap_end FROM (SELECT event_type, lag("end") OVER (PARTITION BY event_type ORDER BY "start") AS gap_start, "start" AS gap_end FROM {_MERGED}) WHERE gap_end > gap_start')
def n12_idle_gaps(spark, sf):
    return scans.idle_gaps(busy(spark, sf), ["event_type"], "s", "e")


@query(f"WITH e AS ({EVENTS}), w AS (SELECT *, (step - 1) // 3 AS window_id FROM e) SELECT user_id, window_id, round(sum(reward), 6) AS total FROM w GROUP BY user_id, window_id HAVING count(*) = 3")
def n13_count_windows(spark, sf):
    return G.count_windows(events(spark, sf), ["user_id"], ["step"], 3).groupBy("user_id", "window_id").agg(F.round(F.sum("reward"), 6).alias("total"))


@query(f"WITH e AS (SELECT *, step - row_number() OVER (PARTITION BY user_id, event_type ORDER BY step) AS island FROM ({EVENTS})) SELECT user_id, event_type, run_length, count(*) AS runs FROM (SELECT user_id, event_type, island, count(*) AS run_length FROM e GROUP BY ALL) GROUP BY ALL")
def n14_run_lengths(spark, sf):
    return G.run_lengths(events(spark, sf), ["user_id"], ["step"], "event_type").groupBy("user_id", "event_type", "run_length").agg(F.count("*").alias("runs"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("SELECT vec_id, round(sum(embedding[i]::DOUBLE * pow(0.99, i - 1)), 6) AS g0, round(max(embedding[i]::DOUBLE) FILTER (i = len(embedding)), 6) AS g_last FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY vec_id")
def n16_discounted_returns(spark, sf):
    out = _vectors(spark, sf).withColumn("g", G.discounted(F.col("v"), 0.99))
    return out.select("vec_id", F.round(F.get("g", F.lit(0)), 6).alias("g0"), F.round(F.element_at("g", -1), 6).alias("g_last"))


@query(
    """WITH p AS (SELECT a.vec_id, a.embedding AS r, b.embedding AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, i, r[i]::DOUBLE + 0.99 * coalesce(v[i + 1]::DOUBLE, 0) - v[i]::DOUBLE AS delta FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM p))
    SELECT vec_id, round(sum(delta * pow(0.99 * 0.95, i - 1)), 6) AS advantage0 FROM d GROUP BY vec_id"""
)
def n17_gae(spark, sf):
    v = _vectors(spark, sf)
    pairs = v.withColumnRenamed("v", "r").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("values")), "vec_id")
    return pairs.select("vec_id", F.round(F.get(G.gae(F.col("r"), F.col("values"), 0.99, 0.95), F.lit(0)), 6).alias("advantage0"))


@query("SELECT l_suppkey, rank FROM (SELECT l_suppkey, row_number() OVER (ORDER BY p DESC, l_suppkey) AS rank FROM (SELECT l_suppkey, round(avg(l_discount), 9) AS p FROM lineitem GROUP BY l_suppkey)) WHERE rank <= 50")
def n19_candidate_rank(spark, sf):
    means = lines(spark, sf).groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 9).alias("p")).orderBy(F.desc("p"), "l_suppkey").limit(50)
    return G.ordinal(means.withColumn("_all", F.lit(1)), ["_all"], [F.desc("p"), "l_suppkey"], "rank").select("l_suppkey", (F.col("rank") + 1).cast("long").alias("rank"))


@query("SELECT event_id FROM events WHERE (event_id + 1) % 7 = 0 OR event_id = (SELECT max(event_id) FROM events)")
def n20_periodic_trigger(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    last = e.agg(F.max("event_id").alias("last"))
    return e.join(F.broadcast(last), how="cross").where(((F.col("event_id") + 1) % 7 == 0) | (F.col("event_id") == F.col("last"))).select("event_id")
