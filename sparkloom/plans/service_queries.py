"""Graders (R), structured text (F), interval joins (J6, J11), step replay (E1), schedules (B9) and hooks (H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import answers as A
from sparkloom.operators import packing, scans
from sparkloom.plans import hooks
from sparkloom.plans.group_queries import _MERGED, busy
from sparkloom.plans.registry import query, table


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS boxed FROM events")
def r9_last_boxed(spark, sf):
    text = F.concat(F.lit("so \\boxed{1} or \\boxed{"), F.col("user_id").cast("string"), F.lit("} holds"))
    return table(spark, sf, "events").select("event_id", A.boxed(text).alias("boxed"))


@query("SELECT event_id, true AS same, false AS other FROM events")
def r11_same_answer(spark, sf):
    """A fraction in two notations, and another one; two fractions are the same only as the same text, so 0/7 is not 0/8."""
    k = F.col("user_id").cast("string")
    a = F.concat(F.lit("\\dfrac{"), k, F.lit("}{7}"))
    return table(spark, sf, "events").select("event_id", A.same_answer(a, F.concat(k, F.lit("/7"))).alias("same"), A.same_answer(a, F.concat(k, F.lit("/8"))).alias("other"))


@query("SELECT event_id, (event_id % 3 = 0)::INT AS score FROM events")
def r13_marked_score(spark, sf):
    """Also r2, r24."""
    said = F.when(F.col("event_id") % 3 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).cast("string")
    text = F.concat(F.lit("<think>hm</think> \\boxed{"), said, F.lit("}"))
    return table(spark, sf, "events").select("event_id", A.marked_score(text, F.col("user_id").cast("string")).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END AS score FROM events")
def r14_integer_score(spark, sf):
    said = F.when(F.col("event_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).cast("string")
    return table(spark, sf, "events").select("event_id", A.integer_score(F.concat(F.lit("work\nAnswer: $"), said, F.lit("$")), F.col("user_id").cast("string")).alias("score"))


@query("SELECT event_id, user_id AS a, event_type AS b FROM events")
def f38_best_json(spark, sf):
    """Also k12, f74: the object with the wanted keys, inside prose."""
    text = F.concat(F.lit('I say {"x": 1} then ```json\n'), F.to_json(F.struct(F.col("user_id").alias("a"), F.col("event_type").alias("b"))), F.lit("\n``` done {"))
    e = table(spark, sf, "events").select("event_id", A.best_json(text, "a", "b").alias("j"))
    return e.select("event_id", F.from_json("j", "a long, b string").alias("v")).select("event_id", "v.*")


@query("SELECT p_partkey, p_name LIKE '%ring%' AS inside FROM part")
def f54_fuzzy_text(spark, sf):
    """Containment decides here; a text far from all names matches none."""
    return table(spark, sf, "part").select("p_partkey", (A.fuzzy(F.col("p_name"), F.lit("ring")) & F.contains("p_name", F.lit("ring"))).alias("inside"))


@query("SELECT doc_id, n_chars > 10000 AS long FROM documents")
def m4_repetition(spark, sf):
    """Also m3: the ratio is taken of long texts only."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", A.repetitive(F.col("text")).alias("r"), (F.length("text") > 10000).alias("long")).where(F.col("r").isNotNull()).select("doc_id", "long")


@query()
def m4_repetition_verdict(spark, sf):
    """m4 and m3 themselves: the verdict, and the compression ratio of a long text's last part."""
    return table(spark, sf, "documents").select("doc_id", A.repetitive(F.col("text")).alias("repetitive"), A.last_ratio(F.col("text")).alias("ratio"))


#: Texts that names are compared with: inside of some, close to some, far from all.
EXPECTED = ("ring", "small widgets", "bleu rod", "Large  BOLT", "cold wigdet", "xyz")


@query()
def f54_fuzzy_verdict(spark, sf):
    """f54 itself: whether a name matches each of some expected texts, by containment or by matching blocks."""
    expected = F.explode(F.array(*[F.lit(e) for e in EXPECTED])).alias("expected")
    return table(spark, sf, "part").select("p_partkey", "p_name", expected).select("p_partkey", "expected", A.fuzzy(F.col("p_name"), F.col("expected")).alias("same"))


_GAPS = f'(SELECT event_type, gap_start, gap_end FROM (SELECT event_type, lag("end") OVER (PARTITION BY event_type ORDER BY "start") AS gap_start, "start" AS gap_end FROM {_MERGED}) WHERE gap_end > gap_start)'


@query(f"WITH g AS (SELECT * FROM {_GAPS} WHERE event_type = 'purchase'), o AS (SELECT event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(value * 60000000 AS BIGINT) AS e FROM events WHERE event_type = 'click') SELECT gap_start, coalesce(min(event_id), -1) AS first_op FROM g LEFT JOIN o ON o.s < g.gap_end AND o.e > g.gap_start GROUP BY gap_start")
def j6_interval_overlap(spark, sf):
    """Gaps and operations meet by the hours they touch, so no operation is compared with every gap."""
    hour = 3_600_000_000
    b = busy(spark, sf)
    gaps = scans.idle_gaps(b.where("event_type = 'purchase'"), ["event_type"], "s", "e")
    hours = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / hour), F.floor(F.col(e) / hour))).alias("hour")
    ops = b.where("event_type = 'click'").select("event_id", "s", "e", hours("s", "e"))
    held = gaps.select("gap_start", "gap_end", hours("gap_start", "gap_end"))
    met = held.join(ops, (held["hour"] == ops["hour"]) & (F.col("s") < F.col("gap_end")) & (F.col("e") > F.col("gap_start")), "left")
    return met.groupBy("gap_start").agg(F.coalesce(F.min("event_id"), F.lit(-1)).alias("first_op"))


@query("WITH f AS (SELECT conv_id, min(turn) FILTER (length(text) % 3 = 0) AS bad, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id, coalesce(bad, last + 1) AS steps, bad IS NULL AS won FROM f")
def e1_episode_replay(spark, sf):
    """The first wrong step ends an episode; it is won if there is none."""
    c = table(spark, sf, "conversations").withColumn("wrong", F.length("text") % 3 == 0)
    f = c.groupBy("conv_id").agg(F.min(F.when(F.col("wrong"), F.col("turn"))).alias("bad"), F.max("turn").alias("last"))
    return f.select("conv_id", F.coalesce("bad", F.col("last") + 1).alias("steps"), F.col("bad").isNull().alias("won"))


@query()
def b9_schedule(spark, sf):
    """Micro-batches of a step of 256 documents on four ranks: the most bins any rank needs, then a balanced deal of each rank's documents to so many."""
    d = table(spark, sf, "documents").select(F.expr("doc_id div 256").alias("step"), F.pmod("doc_id", F.lit(4)).alias("rank"), "doc_id", "n_chars")
    return packing.schedule(d, "step", "rank", "doc_id", "n_chars", 40000)


@query("SELECT source, sum(12 * (24 * n_chars * 64 * 64 + 4 * n_chars * n_chars * 64))::DOUBLE AS flops FROM documents GROUP BY source")
def m6_flops(spark, sf):
    """Operations of a forward pass over sequences: a linear and a quadratic term for each layer (12 of width 64)."""
    n = F.col("n_chars").cast("double")
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(12 * (24 * n * 64 * 64 + 4 * n * n * 64)).alias("flops"))


@query("SELECT user_id, event_id, n FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 10")
def h5_filter_hook(spark, sf):
    """Also f7, h6: a filter hook sees rows with their group's size."""
    e = table(spark, sf, "events").select("user_id", "event_id").withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    kept = hooks.apply_filter(e, lambda df: (F.col("n") >= 10, F.lit("small")))
    return hooks.chain(kept, lambda df: df.where("keep"), None).select("user_id", "event_id", "n")
