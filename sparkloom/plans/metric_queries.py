"""Aggregations (G, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import metrics as M
from sparkloom.plans.group_queries import busy, events
from sparkloom.plans.registry import query, table


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, max(l_quantity) AS max, min(l_quantity) AS min FROM lineitem GROUP BY l_returnflag")
def g2_four_stats(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*M.four_stats("l_quantity")).withColumn("mean", F.round("mean", 6))


@query(
    """WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1), k AS (SELECT *, unnest([1, 2, 4, 8, 16, 32, 64]) AS k FROM g),
    p AS (SELECT k, CASE WHEN n - c < k THEN 1.0 ELSE 1 - coalesce((SELECT product(1 - k / i) FROM (SELECT unnest(range(n - c + 1, n + 1)) AS i)), 1.0) END AS p FROM k WHERE k <= n) SELECT k::BIGINT AS k, round(avg(p), 6) AS pass_at_k FROM p GROUP BY k"""
)
def g3_pass_at_k(spark, sf):
    return M.pass_at_k(table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R").withColumn("pass_at_k", F.round("pass_at_k", 6))


@query("SELECT round(lo, 1) AS reward, count(*) AS groups FROM (SELECT min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_orderkey) WHERE lo = hi GROUP BY 1")
def g4_zero_variance(spark, sf):
    return M.zero_variance(table(spark, sf, "lineitem"), ["l_orderkey"], "l_tax")


@query("SELECT round(lo, 1) AS reward, count(*) AS groups FROM (SELECT min(l_tax) AS lo, max(l_tax) AS hi, count(l_tax) AS n FROM lineitem GROUP BY l_orderkey) WHERE lo = hi AND n > 1 GROUP BY 1")
def g5_zero_variance_pairs(spark, sf):
    return M.zero_variance(table(spark, sf, "lineitem"), ["l_orderkey"], "l_tax", least=2)


@query("SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def g6_category_share(spark, sf):
    return M.category_share(table(spark, sf, "events"), "event_type").withColumn("share", F.round("share", 6))


@query("SELECT l_suppkey, round(sum(l_discount) / 64, 6) AS reward, round(count(*) FILTER (l_returnflag = 'R') / 64, 6) AS win_rate FROM lineitem GROUP BY l_suppkey")
def g7_skill_reward_fixed(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_suppkey").agg(F.round(F.sum("l_discount") / 64, 6).alias("reward"), F.round(F.count_if(F.col("l_returnflag") == "R") / 64, 6).alias("win_rate"))


@query("SELECT s_suppkey, round(coalesce(sum(l_discount), 0) / coalesce(nullif(count(l_orderkey), 0), 1), 6) AS reward FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def g8_skill_reward_observed(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_discount").alias("s"), F.count("*").alias("n"))
    joined = table(spark, sf, "supplier").join(sums, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.select("s_suppkey", F.round(F.coalesce("s", F.lit(0.0)) / F.coalesce(F.nullif("n", F.lit(0)), F.lit(1)), 6).alias("reward"))


@query("SELECT event_type, round(avg(best), 6) AS task_success, count(*) AS tasks FROM (SELECT event_type, user_id, greatest(max(value), 0) AS best FROM events GROUP BY ALL) GROUP BY event_type")
def g9_task_success(spark, sf):
    return M.task_success(table(spark, sf, "events"), ["user_id"], "value", ["event_type"]).withColumn("task_success", F.round("task_success", 6))


@query("SELECT lang, count(*) AS samples, round(avg(quality), 6) AS success, round(sum(least(quality + toxic, 1)) / sum(1), 6) AS action_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def g10_branch_metrics(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    clipped = F.least(F.col("quality") + F.col("toxic"), F.lit(1))
    return d.groupBy("lang").agg(F.count("*").alias("samples"), F.round(F.avg("quality"), 6).alias("success"), F.round(F.sum(clipped) / F.count("*"), 6).alias("action_rate"))


@query("SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, grouping(lang, source)::BIGINT AS level, count(*) AS samples, round(avg(quality), 6) AS success FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)")
def g11_rollup_report(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id")
    out = M.rollup_report(d, ["lang", "source"], [F.count("*").alias("samples"), F.round(F.avg("quality"), 6).alias("success")])
    return out.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("lang", "source")})


@query("SELECT key, value FROM (SELECT round(avg(CASE WHEN won THEN reward END), 6) AS won_reward, round(avg(CASE WHEN NOT won THEN reward END), 6) AS lost_reward, round(avg(won::INT), 6) AS win_rate FROM (SELECT value AS reward, event_type = 'purchase' AS won FROM events)) UNPIVOT (value FOR key IN (won_reward, lost_reward, win_rate))")
def g14_rollout_report(spark, sf):
    e = events(spark, sf)
    row = e.agg(F.round(F.avg(F.when(F.col("won"), F.col("reward"))), 6).alias("won_reward"), F.round(F.avg(F.when(~F.col("won"), F.col("reward"))), 6).alias("lost_reward"), F.round(F.avg(F.col("won").cast("int")), 6).alias("win_rate"))
    return row.unpivot([], ["won_reward", "lost_reward", "win_rate"], "key", "value")


@query("SELECT round(avg(n_chars), 6) AS mean, median(n_chars) AS median, max(n_chars) AS max, min(n_chars) AS min, round(avg((n_chars > 4000)::INT), 6) AS truncated FROM documents")
def g17_length_report(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(*M.four_stats("n_chars"), F.round(F.avg((F.col("n_chars") > 4000).cast("int")), 6).alias("truncated")).withColumn("mean", F.round("mean", 6))


@query("SELECT sum(n_chars) / 100.0 / 8 AS per_worker, max(n_chars) / 100.0 AS longest, (SELECT count(*) FROM documents WHERE n_chars = (SELECT max(n_chars) FROM documents)) AS tied FROM documents")
def g18_throughput(spark, sf):
    d = table(spark, sf, "documents")
    top = d.agg(F.sum("n_chars").alias("s"), F.max("n_chars").alias("m"), F.max_by(F.struct("doc_id"), "n_chars").alias("_"))
    tied = d.groupBy("n_chars").agg(F.count("*").alias("tied")).withColumnRenamed("n_chars", "m")
    return top.join(tied, "m").select((F.col("s") / 100.0 / 8).alias("per_worker"), (F.col("m") / 100.0).alias("longest"), "tied")


@query("SELECT source, round(avg(quality), 6) AS mean_reward, round(avg(toxic), 6) AS truncated, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def g19_eval_summary(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("mean_reward"), F.round(F.avg("toxic"), 6).alias("truncated"), F.count("*").alias("n"))


@query("SELECT round(sum(l_discount) / nullif(sum(l_tax), 0), 6) AS ratio FROM lineitem")
def g20_ratio_of_sums(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(F.try_divide(F.sum("l_discount"), F.sum("l_tax")), 6).alias("ratio"))


@query("SELECT round(avg(m), 6) AS mean_of_means FROM (SELECT avg(value) AS m FROM events GROUP BY user_id % 8)")
def g21_mean_of_means(spark, sf):
    ranks = table(spark, sf, "events").groupBy((F.col("user_id") % 8).alias("rank")).agg(F.avg("value").alias("m"))
    return ranks.agg(F.round(F.avg("m"), 6).alias("mean_of_means"))


@query("SELECT round(var_samp(v), 8) AS variance, count(*) AS n FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings) WHERE v > 0")
def g22_masked_variance(spark, sf):
    v = table(spark, sf, "embeddings").select(F.explode("embedding").alias("v")).where("v > 0").select(F.col("v").cast("double").alias("v"))
    return v.agg(F.round(F.var_samp("v"), 8).alias("variance"), F.count("*").alias("n"))


@query("SELECT round(sum(m), 5) AS total FROM (SELECT vec_id, sum(v) FILTER (v > 0) / greatest(count(*) FILTER (v > 0), 1) AS m FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id)")
def g23_masked_mean_sum(spark, sf):
    mask = F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    return table(spark, sf, "embeddings").agg(F.round(F.sum(M.masked_mean(F.transform("embedding", lambda x: x.cast("double")), mask)), 5).alias("total"))


@query("SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem")
def g24_column_means(spark, sf):
    return table(spark, sf, "lineitem").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])


@query("SELECT bin, round(count(*) / ((SELECT count(*) FROM documents) + 1e-9), 6) AS share FROM (SELECT greatest(ceil(n_chars * 10 / 20000.0), 1)::BIGINT AS bin FROM documents) WHERE bin <= 10 GROUP BY bin")
def g25_histogram_share(spark, sf):
    d = table(spark, sf, "documents")
    counted = d.groupBy(M.histogram_share(F.col("n_chars"), F.lit(20000.0), 10).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("all"))
    return counted.join(F.broadcast(total), how="cross").where("bin IS NOT NULL").select("bin", F.round(F.col("n") / (F.col("all") + 1e-9), 6).alias("share"))


@query("SELECT round(avg(n), 6) AS mean_turns, max(n) AS max_turns, min(n) AS min_turns, round(avg(a), 6) AS mean_assistant FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)")
def g26_multi_turn(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "assistant").alias("a"))
    return c.agg(F.round(F.avg("n"), 6).alias("mean_turns"), F.max("n").alias("max_turns"), F.min("n").alias("min_turns"), F.round(F.avg("a"), 6).alias("mean_assistant"))


@query("SELECT role, sum(length(text)) AS total, count(*) AS n FROM conversations GROUP BY role")
def g28_role_metrics(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.sum(F.length("text")).alias("total"), F.count("*").alias("n"))


@query("SELECT count(*) AS samples, count(DISTINCT user_id) AS groups, round(count(*) / count(DISTINCT user_id), 6) AS mean_size, round(coalesce(avg(value), 0), 6) AS mean_reward FROM events")
def g29_buffer_meta(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    out = g.agg(F.sum("n").alias("samples"), F.count("*").alias("groups"), F.sum("s").alias("s"))
    return out.select("samples", "groups", F.round(F.coalesce(F.try_divide("samples", "groups"), F.lit(0.0)), 6).alias("mean_size"), F.round(F.coalesce(F.try_divide("s", "samples"), F.lit(0.0)), 6).alias("mean_reward"))


@query("SELECT round(sum(m * n) / sum(n), 6) AS weighted FROM (SELECT avg(value) AS m, count(*) AS n FROM events GROUP BY event_type)")
def g30_weighted_mean(spark, sf):
    b = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return b.agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("weighted"))


_REASON = "CASE WHEN text IS NULL OR text = '' THEN 'no_text' WHEN n_chars < 200 THEN 'short' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN n_chars > 8000 THEN 'long' ELSE 'kept' END"


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM documents) GROUP BY reason")
def g31_reject_reasons(spark, sf):
    """Also f2, f8: one ordered chain of reasons, counted."""
    return table(spark, sf, "documents").groupBy(F.expr(_REASON).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(sum(value) / sum(sum(value)) OVER (), 6) AS share, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def g32_kernel_stats(spark, sf):
    """Also g43: counts, totals, shares and means by category."""
    from pyspark.sql import Window

    k = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("t"))
    return k.select("event_type", "n", F.round("t", 4).alias("total"), F.round(F.col("t") / F.sum("t").over(Window.partitionBy()), 6).alias("share"), F.round(F.col("t") / F.col("n"), 6).alias("mean"))


_STREAM = "SELECT user_id, count(*) AS n, sum(e - s) AS busy, max(e) - min(s) AS span, round(sum(e - s) / (max(e) - min(s)) * 100, 6) AS utilisation FROM (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(value * 60000000 AS BIGINT) AS e FROM events) GROUP BY user_id"


def _streams(spark, sf):
    return busy(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("busy"), (F.max("e") - F.min("s")).alias("span")).withColumn("utilisation", F.round(F.col("busy") / F.col("span") * 100, 6))


@query(_STREAM)
def g33_stream_stats(spark, sf):
    return _streams(spark, sf)


@query(f"SELECT user_id % 4 AS rank, sum(n)::BIGINT AS events, round(avg(utilisation), 6) AS utilisation FROM ({_STREAM}) GROUP BY 1")
def g34_cross_rank(spark, sf):
    return _streams(spark, sf).groupBy((F.col("user_id") % 4).alias("rank")).agg(F.sum("n").alias("events"), F.round(F.avg("utilisation"), 6).alias("utilisation"))


@query("SELECT conv_id, round(count(*) FILTER (role = 'assistant') / count(*), 6) AS accuracy FROM conversations GROUP BY conv_id")
def g35_episode_summary(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.round(F.try_divide(F.count_if(F.col("role") == "assistant"), F.count("*")), 6).alias("accuracy"))


@query("SELECT user_id, round(sum(coalesce(CASE WHEN event_type <> 'error' THEN value END, 0)) / count(*), 6) AS mean_reward FROM events GROUP BY user_id")
def g36_episode_mean(spark, sf):
    r = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum(F.coalesce(r, F.lit(0.0))) / F.count("*"), 6).alias("mean_reward"))


@query("SELECT round(max(CASE WHEN event_type = 'click' THEN t END) / sum(t), 6) AS wait_ratio, round(sum(n) / sum(t), 6) AS per_second FROM (SELECT event_type, sum(value) AS t, count(*) AS n FROM events GROUP BY event_type)")
def g37_timer_report(spark, sf):
    """Also g38: timers are summed by name, then compared."""
    t = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("t"), F.count("*").alias("n"))
    return t.agg(F.round(F.max(F.when(F.col("event_type") == "click", F.col("t"))) / F.sum("t"), 6).alias("wait_ratio"), F.round(F.sum("n") / F.sum("t"), 6).alias("per_second"))


@query("SELECT event_id, round(coalesce(CASE WHEN event_type <> 'error' THEN value END, (SELECT avg(value) FROM events WHERE event_type = 'purchase'), 0), 6) AS raw_reward FROM events")
def g39_fallback_reward(spark, sf):
    e = table(spark, sf, "events")
    mean = e.agg(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("mean"))
    raw = F.coalesce(F.when(F.col("event_type") != "error", F.col("value")), "mean", F.lit(0.0))
    return e.join(F.broadcast(mean), how="cross").select("event_id", F.round(raw, 6).alias("raw_reward"))


@query(
    """WITH l AS (SELECT doc_id, lower(trim(line, ' ')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, ' ') <> ''), c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) >= 12 GROUP BY ALL), m AS (SELECT doc_id, max(n) AS most FROM c GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS lines FROM l GROUP BY doc_id)
    SELECT doc_id, most, lines, most >= 3 AND most >= 0.5 * lines AS flagged FROM m JOIN a USING (doc_id)"""
)
def g40_repeated_line(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.lower(F.trim("line")).alias("line")).where("line <> ''")
    counts = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    out = counts.groupBy("doc_id").agg(F.max(F.when(F.length("line") >= 12, F.col("n"))).alias("most"), F.sum("n").alias("lines")).where("most IS NOT NULL")
    return out.withColumn("flagged", (F.col("most") >= 3) & (F.col("most") >= 0.5 * F.col("lines")))


@query("SELECT CASE WHEN value < 1 THEN 'short' WHEN value < 5 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def g41_launch_buckets(spark, sf):
    bucket = F.when(F.col("value") < 1, "short").when(F.col("value") < 5, "medium").otherwise("long")
    return table(spark, sf, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT conv_id, count(*) FILTER (role = 'assistant') AS turns FROM conversations GROUP BY conv_id")
def g44_assistant_turns(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("turns"))


@query(f"SELECT user_id, rule, severity FROM (SELECT user_id, unnest([CASE WHEN utilisation < 90 THEN 'idle' END, CASE WHEN n > 70 THEN 'busy' END]) AS rule, unnest(['high', 'low']) AS severity FROM ({_STREAM})) WHERE rule IS NOT NULL")
def g45_threshold_rules(spark, sf):
    rules = M.threshold_rules({"idle": (F.col("utilisation") < 90, "high"), "busy": (F.col("n") > 70, "low")})
    return _streams(spark, sf).select("user_id", F.explode(rules).alias("r")).select("user_id", "r.rule", "r.severity")


@query(f"SELECT user_id, CASE WHEN n > 80 AND utilisation > 20 THEN 'main' WHEN n > 60 THEN 'side' ELSE 'idle' END AS role FROM ({_STREAM})")
def g46_stream_role(spark, sf):
    return _streams(spark, sf).select("user_id", F.when((F.col("n") > 80) & (F.col("utilisation") > 20), "main").when(F.col("n") > 60, "side").otherwise("idle").alias("role"))


_EPISODES = "SELECT user_id, date_trunc('day', ts) AS day, count(*) AS steps, count(*) FILTER (value <= 100) AS correct, bool_and(value <= 100)::INT AS won, sum(value) AS reward, max(length(event_type)) AS longest, min_by(event_type, event_id) AS task FROM events GROUP BY ALL"
_REPORTED = {
    "episodes/reward": "avg(reward)", "episodes/won": "avg(won)", "episodes/won_reward": "avg(CASE WHEN won = 1 THEN reward END)", "episodes/lost_reward": "avg(CASE WHEN won = 0 THEN reward END)", "steps/won": "avg(CASE WHEN won = 1 THEN steps END)", "steps/lost": "avg(CASE WHEN won = 0 THEN steps END)",
    "episodes/partial": "avg(CASE WHEN won = 0 THEN (correct > 0)::INT END)", "steps/accuracy": "avg(correct / steps)", "steps/last_right": "avg(CASE WHEN steps > 1 THEN correct / steps END)", "episodes/long": "avg((steps >= 5)::INT)",
}
_FOUR = {f"{name}/{kind}": f"{f}({column})" for name, column in (("steps", "steps"), ("correct", "correct"), ("reward", "reward"), ("longest", "longest")) for kind, f in (("mean", "avg"), ("median", "median"), ("max", "max"), ("min", "min"))}


@query(
    f"WITH e AS ({_EPISODES}) " + " UNION ALL ".join(f"SELECT {scope} AS scope, '{name}' AS key, round(({f})::DOUBLE, 5) AS value FROM e {group} HAVING ({f}) IS NOT NULL" for scope, group in (("'all'", ""), ("task", "GROUP BY task")) for name, f in (_REPORTED | _FOUR).items())
)
def g15_episode_report(spark, sf):
    """Also g14: conditional means and four statistics of episodes (a user's day), over all and by kind of task: success, rewards and steps of won and lost ones, accuracy of steps."""
    c = F.col
    right = F.col("value") <= 100
    e = table(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(
        F.count("*").alias("steps"), F.count_if(right).alias("correct"), F.min(right.cast("int")).alias("won"), F.sum("value").alias("reward"), F.max(F.length("event_type")).alias("longest"), F.min_by("event_type", "event_id").alias("task"),
    )
    won, lost, share = c("won") == 1, c("won") == 0, c("correct") / c("steps")
    means = {
        "episodes/reward": (None, c("reward")), "episodes/won": (None, c("won")), "episodes/won_reward": (won, c("reward")), "episodes/lost_reward": (lost, c("reward")), "steps/won": (won, c("steps")), "steps/lost": (lost, c("steps")),
        "episodes/partial": (lost, (c("correct") > 0).cast("int")), "steps/accuracy": (None, share), "steps/last_right": (c("steps") > 1, share), "episodes/long": (None, (c("steps") >= 5).cast("int")),
    }
    out = M.conditional_report(e, ["task"], means, {n: c(n) for n in ("steps", "correct", "reward", "longest")})
    return out.select("scope", "key", F.round("value", 5).alias("value"))
