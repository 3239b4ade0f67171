"""Per-token advantages by estimator, with an optional distillation term and whitening over all masked tokens.

All estimators are one pass over the rows; the two that look ahead share one linear scan.
Whitening takes two passes over sums of rows: the mean, then the squared distances from
it; only one row for each estimator is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import tokens as T
from sparkloom.functions.binding import let
from sparkloom.operators.groups import gae_steps, with_scan

ESTIMATORS = ("grpo", "gspo", "ppo", "reinforce_plus_plus", "reinforce_plus_plus_baseline")


def _last_place(values: Column, mask: Column, reward: Column) -> Column:
    """values with the reward added where the mask has its last 1; a row that is all masked is an error."""
    at = F.size(mask) - F.array_position(F.reverse(mask), 1)
    found = F.when(F.array_contains(mask, 1), at).otherwise(F.raise_error(F.lit("a sequence is fully masked")).cast("long"))
    return let(found, lambda k: F.transform(values, lambda v, i: v + F.when(i == k, reward).otherwise(0.0)))


def whiten_by(df: DataFrame, by: str, values: str, mask: str, epsilon: float = 1e-8, shift_mean: bool = True) -> DataFrame:
    """values whitened by mean and unbiased variance of all masked tokens of the same ``by``. A kind without a masked token is an error."""
    own = df.withColumn("_m", T.masked(F.col(values), F.col(mask)))
    mean = own.groupBy(by).agg((F.sum(T.total(F.col("_m"))) / F.nullif(F.sum(F.size("_m")), F.lit(0))).alias("_mean"))
    # A row for each estimator: a handful.
    off = own.join(F.broadcast(mean), by).withColumn("_d", F.aggregate("_m", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))))
    n = F.sum(F.size("_m"))
    stats = off.groupBy(by).agg(F.first("_mean").alias("_mean"), (F.sum("_d") / F.greatest(n - 1, F.lit(1))).alias("_var"))
    some = F.when(F.col("_mean").isNotNull(), F.sqrt(F.col("_var") + epsilon)).otherwise(F.raise_error(F.lit("no token is in the mask")).cast("double"))
    back = F.lit(0.0) if shift_mean else F.col("_mean")
    return df.join(F.broadcast(stats), by).withColumn("_s", some).withColumn(values, F.transform(values, lambda x: (x - F.col("_mean")) / F.col("_s") + back)).drop("_mean", "_var", "_s")


def advantages(df: DataFrame, estimator: str = "estimator", kl_kind: str = "k1", kl_coef: float = 0.0, gamma: float = 1.0, lam: float = 1.0, distil: float | None = None, whiten: bool = False) -> DataFrame:
    """df with advantages and returns (arrays of double).

    Columns read: the estimator's name, reward, log_probs, ref_log_probs (not with kl_coef 0), values (ppo), mask (array<int>), teacher_log_probs (with distil).
    distil: the share of the reverse divergence from the teacher that is taken off. An unknown estimator is an error.
    """
    kl = F.transform("log_probs", lambda x: F.lit(0.0)) if kl_coef == 0 else T.kl(F.col("log_probs"), F.col("ref_log_probs"), kl_kind)
    name = F.coalesce(F.col(estimator), F.lit("null"))
    held = df.withColumns({"_kl": kl, "_reward": F.col("reward").cast("double")})
    ppo, ahead = name == "ppo", name == "reinforce_plus_plus"
    values = F.col("values") if "values" in df.columns else F.when(ppo, F.raise_error(F.lit("ppo needs values"))).cast("array<double>")
    shaped = gae_steps(T.terminal_reward(F.col("_kl"), F.col("_reward"), kl_coef), values, gamma)
    penalties = F.zip_with("_kl", "mask", lambda k, m: -kl_coef * k * m)
    late = _last_place(penalties, F.col("mask"), F.col("_reward"))
    # The two that look ahead, each with its decay; nothing for the others.
    held = with_scan(held, F.when(ppo, shaped).when(ahead, late), F.when(ppo, gamma * lam).otherwise(gamma), "_ahead")
    unknown = F.raise_error(F.concat(F.lit("unknown estimator "), name)).cast("array<double>")
    adv = F.when(name.isin("grpo", "gspo"), T.broadcast(F.col("_reward"), F.col("_kl"))).when(ppo | ahead, F.col("_ahead"))
    adv = adv.when(name == "reinforce_plus_plus_baseline", F.transform("_kl", lambda k: F.col("_reward") - kl_coef * k)).otherwise(unknown)
    out = held.withColumn("advantages", adv)
    out = out.withColumn("returns", F.when(ppo, F.zip_with("_ahead", values, lambda a, v: a + v)).otherwise(F.col("advantages"))).drop("_kl", "_reward", "_ahead")
    if distil is not None:
        off = F.zip_with("log_probs", "teacher_log_probs", lambda s, t: distil * (s - t))
        out = out.withColumn("advantages", F.zip_with("advantages", off, lambda a, x: a - x))
    return whiten_by(out, estimator, "advantages", "mask") if whiten else out
