"""Per-token arrays (V). Embeddings stand for log-probabilities; the second series is that of the next id."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import tokens as T
from sparkloom.operators import advantages as A
from sparkloom.plans.registry import query, table

#: One row for each token: vec_id, i, a, b.
_PAIRS = "(SELECT vec_id, i, x[i]::DOUBLE AS a, y[i]::DOUBLE AS b FROM (SELECT p.vec_id, p.embedding AS x, q.embedding AS y, unnest(range(1, len(p.embedding) + 1)) AS i FROM embeddings p JOIN embeddings q ON q.vec_id = p.vec_id + 1))"


def pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    out = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return out.withColumn("m", F.transform("a", lambda x: F.when(x > 0, 1).otherwise(0)))


def _sum(column):
    return F.round(T.total(column), 6)


@query(f"SELECT vec_id, round(sum(a - b), 6) AS k1, round(sum((a - b) * (a - b) / 2), 6) AS k2, round(sum(exp(b - a) - 1 - (b - a)), 6) AS k3, round(sum(greatest(-10, least(10, exp(b - a) - 1 - (b - a)))), 6) AS low_var_kl FROM {_PAIRS} GROUP BY vec_id")
def v1_kl(spark, sf):
    return pairs(spark, sf).select("vec_id", *[_sum(T.kl(F.col("a"), F.col("b"), k)).alias(k) for k in ("k1", "k2", "k3", "low_var_kl")])


@query(f"SELECT vec_id, round(coalesce(avg(a - b) FILTER (a > 0), 0), 6) AS sequence_kl, count(*) AS n FROM {_PAIRS} GROUP BY vec_id")
def v2_sequence_kl(spark, sf):
    kl = T.masked_stats(T.kl(F.col("a"), F.col("b")), F.col("m"))["mean"]
    spread = pairs(spark, sf).select("vec_id", T.broadcast(kl, F.col("a")).alias("k"))
    return spread.select("vec_id", F.round(F.get("k", F.lit(0)), 6).alias("sequence_kl"), F.size("k").cast("long").alias("n"))


@query(f"SELECT vec_id, sum(CASE WHEN a < 0 AND s > 0.01 THEN 0 ELSE 1 END)::DOUBLE AS kept FROM (SELECT *, avg(a - b) OVER (PARTITION BY vec_id) AS s FROM {_PAIRS}) GROUP BY vec_id")
def v3_off_policy_mask(spark, sf):
    p = pairs(spark, sf).withColumn("s", T.total(T.kl(F.col("a"), F.col("b"))) / F.size("a"))
    return p.select("vec_id", T.total(T.off_policy_mask(F.col("a"), F.col("s"), 0.01)).alias("kept"))


_R, _C = "exp(a - b)", "greatest(0.8, least(1.2, exp(a - b)))"


@query(f"SELECT vec_id, round(sum(greatest(-a * {_R}, -a * {_C})), 6) AS loss, round(sum(CASE WHEN a < 0 THEN least(greatest(-a * {_R}, -a * {_C}), -a * 3.0) ELSE greatest(-a * {_R}, -a * {_C}) END), 6) AS dual, round(avg(CASE WHEN -a * {_C} > -a * {_R} THEN 1.0 ELSE 0.0 END), 6) AS clip_share FROM {_PAIRS} GROUP BY vec_id")
def v4_policy_loss(spark, sf):
    r = F.zip_with("a", "b", lambda a, b: F.exp(a - b))
    p = pairs(spark, sf).withColumn("r", r)
    loss = lambda dual: _sum(T.policy_loss(F.col("r"), F.col("a"), 0.2, 0.2, dual))
    return p.select("vec_id", loss(None).alias("loss"), loss(3.0).alias("dual"), F.round(T.clip_share(F.col("r"), F.col("a"), 0.2, 0.2), 6).alias("clip_share"))


@query(f"SELECT vec_id, round(sum(label - 0.1 * (a - b)), 6) AS advantage, round(sum(-0.1 * (a - b)) + max(label), 6) AS shaped FROM {_PAIRS} JOIN embeddings USING (vec_id) GROUP BY vec_id")
def v6_baseline_and_terminal(spark, sf):
    """Also v5, v8, v13, v15: a reward spread over tokens, less a share of the divergence; or added at the last token."""
    p = pairs(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    kl = T.kl(F.col("a"), F.col("b"))
    return p.select("vec_id", _sum(F.transform(kl, lambda k: F.col("label") - 0.1 * k)).alias("advantage"), _sum(T.terminal_reward(kl, F.col("label").cast("double"), 0.1)).alias("shaped"))


@query(f"SELECT vec_id, round(sum(greatest(0.9, least(1.1, {_R}))), 6) AS truncated, round(sum(CASE WHEN {_R} BETWEEN 0.9 AND 1.1 THEN {_R} ELSE 0 END), 6) AS pop, sum(CASE WHEN {_R} BETWEEN 0.9 AND 1.1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS mask FROM {_PAIRS} GROUP BY vec_id")
def v9_importance_weights(spark, sf):
    w = lambda mode: T.total(T.importance(F.col("a"), F.col("b"), 0.9, 1.1, mode))
    return pairs(spark, sf).select("vec_id", F.round(w("truncate"), 6).alias("truncated"), F.round(w("pop"), 6).alias("pop"), w("mask").alias("mask"))


@query(f"SELECT vec_id, round(exp(greatest(-20, least(20, coalesce(sum(a - b) FILTER (a > 0), 0)))), 5) AS sequence, round(exp(coalesce(avg(a - b) FILTER (a > 0), 0)), 6) AS geometric FROM {_PAIRS} GROUP BY vec_id")
def v10_sequence_weights(spark, sf):
    w = lambda g: T.sequence_weight(F.col("a"), F.col("b"), F.col("m"), g)
    return pairs(spark, sf).select("vec_id", F.round(w(False), 5).alias("sequence"), F.round(w(True), 6).alias("geometric"))


@query(f"SELECT vec_id, round(coalesce(sum(b) FILTER (a > 0), 0), 6) AS sum, round(coalesce(avg(b) FILTER (a > 0), 0), 6) AS mean, round(coalesce(min(b) FILTER (a > 0), 0), 6) AS min, round(coalesce(max(b) FILTER (a > 0), 0), 6) AS max FROM {_PAIRS} GROUP BY vec_id")
def v11_masked_stats(spark, sf):
    out = pairs(spark, sf).select("vec_id", T.masked_stats(F.col("b"), F.col("m")).alias("s"))
    return out.select("vec_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("sum", "mean", "min", "max")])


@query(f"SELECT vec_id, round(exp(-coalesce(avg(a) FILTER (a > 0), 0)), 6) AS ppl, round(exp(-coalesce(avg(b) FILTER (a > 0), 0)), 6) AS rollout_ppl, round(avg(exp(2 * (a - b))) - 1, 6) AS chi2 FROM {_PAIRS} GROUP BY vec_id")
def v12_mismatch_metrics(spark, sf):
    chi2 = T.total(F.zip_with("a", "b", lambda a, b: F.exp(2 * (a - b)))) / F.size("a") - 1
    return pairs(spark, sf).select("vec_id", F.round(T.perplexity(F.col("a"), F.col("m")), 6).alias("ppl"), F.round(T.perplexity(F.col("b"), F.col("m")), 6).alias("rollout_ppl"), F.round(chi2, 6).alias("chi2"))


@query("SELECT vec_id, label + 1 AS n, round(list_sum(embedding[len(embedding) - label:]::DOUBLE[]), 6) AS total FROM embeddings")
def v14_suffix(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    s = T.suffix(F.col("v"), F.col("label") + 1)
    return e.select("vec_id", F.size(s).alias("n"), _sum(s).alias("total"))


@query("SELECT vec_id, coalesce(len(embedding) - list_position(list_transform(embedding, lambda x: x > 0), true) + 1, 0) AS length FROM embeddings")
def r22_response_length(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)).alias("m"))
    return e.select("vec_id", T.response_length(F.col("m")).alias("length"))


#: Tokens with their estimator, then the sums that each one gives: row by row of the next tokens for the two that look ahead.
_ADVANTAGES = f"""WITH p AS (SELECT t.*, label AS reward, (a > 0)::INT AS m, max(i) OVER w AS last, max(CASE WHEN a > 0 THEN i END) OVER w AS seen, coalesce(lead(b) OVER (PARTITION BY t.vec_id ORDER BY i), 0) AS following, t.vec_id % 5 AS kind FROM {_PAIRS} t JOIN embeddings e ON e.vec_id = t.vec_id WINDOW w AS (PARTITION BY t.vec_id)),
r AS (SELECT *, CASE kind WHEN 2 THEN -0.1 * (a - b) + CASE WHEN i = last THEN reward ELSE 0 END + 0.99 * following - b ELSE -0.1 * (a - b) * m + CASE WHEN i = seen THEN reward ELSE 0 END END AS step, CASE kind WHEN 2 THEN 0.99 * 0.95 ELSE 0.99 END AS decay FROM p WHERE kind IN (2, 3)),
ahead AS (SELECT x.vec_id, x.i, sum(y.step * pow(x.decay, y.i - x.i)) AS g FROM r x JOIN r y ON y.vec_id = x.vec_id AND y.i >= x.i GROUP BY x.vec_id, x.i),
u AS (SELECT p.*, CASE WHEN kind IN (0, 1) THEN reward WHEN kind = 4 THEN reward - 0.1 * (a - b) ELSE g END AS g, CASE WHEN kind = 2 THEN g + b WHEN kind = 3 THEN g WHEN kind = 4 THEN reward - 0.1 * (a - b) ELSE reward END AS ret FROM p LEFT JOIN ahead USING (vec_id, i)),
d AS (SELECT *, g - 0.2 * (a - b) AS adv FROM u),
s AS (SELECT kind, avg(adv) AS mean, var_samp(adv) AS var FROM d WHERE m = 1 GROUP BY kind)
SELECT vec_id, ['grpo', 'gspo', 'ppo', 'reinforce_plus_plus', 'reinforce_plus_plus_baseline'][kind + 1] AS estimator, i, round(adv, 5) AS advantage, round(ret, 5) AS returns, round((adv - mean) / sqrt(var + 1e-8), 4) AS whitened FROM d JOIN s USING (kind)"""


def samples(spark, sf):
    """The next id's series is the reference, the teacher and the critic; a fifth of the ids for each estimator."""
    kind = F.get(F.array(*map(F.lit, A.ESTIMATORS)), F.pmod("vec_id", F.lit(5)).cast("int"))
    p = pairs(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("reward")), "vec_id").where(F.array_contains("m", 1))
    return p.select("vec_id", kind.alias("estimator"), "reward", F.col("a").alias("log_probs"), F.col("b").alias("ref_log_probs"), F.col("b").alias("teacher_log_probs"), F.col("b").alias("values"), F.col("m").alias("mask"))


@query(_ADVANTAGES)
def v7_advantages(spark, sf):
    """Five estimators in one plan, with the distillation term, plain and whitened."""
    out = A.advantages(samples(spark, sf), kl_coef=0.1, gamma=0.99, lam=0.95, distil=0.2)
    white = A.whiten_by(out.withColumn("whitened", F.col("advantages")), "estimator", "whitened", "mask")
    tokens = white.select("vec_id", "estimator", F.posexplode(F.arrays_zip("advantages", "returns", "whitened")).alias("i", "t"))
    return tokens.select("vec_id", "estimator", (F.col("i") + 1).cast("long").alias("i"), F.round("t.advantages", 5).alias("advantage"), F.round("t.returns", 5).alias("returns"), F.round("t.whitened", 4).alias("whitened"))
