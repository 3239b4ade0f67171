"""Per-token array mathematics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.binding import let


def kl(lp: Column, base: Column, kind: str = "k1") -> Column:
    """Per-token estimate of the divergence of lp from base: k1, k2, k3 or low_var_kl (k3 clamped to 10)."""
    ratio = lambda a, b: a - b
    forms = {
        "k1": lambda a, b: ratio(a, b),
        "k2": lambda a, b: ratio(a, b) * ratio(a, b) / 2,
        "k3": lambda a, b: F.exp(b - a) - 1 - (b - a),
        "low_var_kl": lambda a, b: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(b - a) - 1 - (b - a))),
    }
    if kind not in forms:
        raise ValueError(f"unknown kind {kind!r}")
    return F.zip_with(lp, base, forms[kind])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def masked(values: Column, mask: Column) -> Column:
    """The values at places where the mask is above 0."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda t: t["m"] > 0), lambda t: t["v"])


def masked_stats(values: Column, mask: Column) -> Column:
    """sum, mean, min and max over the mask; 0 if it is empty."""
    m = masked(values, mask)
    n = F.size(m)
    zero = F.lit(0.0)
    return F.struct(total(m).alias("sum"), F.when(n > 0, total(m) / n).otherwise(zero).alias("mean"), F.coalesce(F.array_min(m), zero).alias("min"), F.coalesce(F.array_max(m), zero).alias("max"))


def broadcast(value: Column, like: Column) -> Column:
    return F.array_repeat(value, F.size(like))


def policy_loss(ratio: Column, advantage: Column, low: float, high: float, dual: float | None = None) -> Column:
    """Clipped objective per token, as a loss; with dual also bounded for negative advantages."""

    def one(r: Column, a: Column) -> Column:
        loss = F.greatest(-a * r, -a * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), r)))
        return loss if dual is None else F.when(a < 0, F.least(loss, -a * dual)).otherwise(loss)

    return F.zip_with(ratio, advantage, one)


def clip_share(ratio: Column, advantage: Column, low: float, high: float) -> Column:
    """Share of tokens at which the clipped loss is the larger one."""
    clipped = F.zip_with(ratio, advantage, lambda r, a: F.when(-a * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), r)) > -a * r, 1.0).otherwise(0.0))
    return total(clipped) / F.size(clipped)


def importance(train: Column, rollout: Column, low: float, high: float, mode: str = "truncate", safety: float = 20.0) -> Column:
    """exp(train - rollout) per token; truncate: clamped to [low, high]; pop: 0 outside; mask: 1 inside, 0 outside."""

    def one(t: Column, r: Column) -> Column:
        w = F.exp(F.greatest(F.lit(-safety), F.least(F.lit(safety), t - r)))
        inside = (w >= low) & (w <= high)
        return {"truncate": F.greatest(F.lit(low), F.least(F.lit(high), w)), "pop": F.when(inside, w).otherwise(0.0), "mask": F.when(inside, 1.0).otherwise(0.0)}[mode]

    return F.zip_with(train, rollout, one)


def sequence_weight(train: Column, rollout: Column, mask: Column, geometric: bool = False, safety: float = 20.0) -> Column:
    """One weight of a whole sequence: the product of token ratios, or their geometric mean."""
    log = total(masked(F.zip_with(train, rollout, lambda t, r: t - r), mask))
    log = log / F.greatest(F.size(masked(train, mask)), F.lit(1)) if geometric else log
    return F.exp(F.greatest(F.lit(-safety), F.least(F.lit(safety), log)))


def off_policy_mask(advantage: Column, sequence_kl: Column, delta: float) -> Column:
    """0 where the advantage is negative in a sequence that has drifted by more than delta, else 1."""
    return F.transform(advantage, lambda a: F.when((a < 0) & (sequence_kl > delta), 0.0).otherwise(1.0))


def suffix(values: Column, n: Column) -> Column:
    """The last n values once the first is dropped."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(n <= 0, F.slice(rest, 1, 0)).otherwise(F.slice(rest, F.greatest(F.size(rest) - n + 1, F.lit(1)), n))


def terminal_reward(kl_values: Column, reward: Column, coefficient: float) -> Column:
    """-coefficient * kl everywhere, and the reward added at the last token."""
    return let(kl_values, lambda v: F.transform(v, lambda k, i: -coefficient * k + F.when(i == F.size(v) - 1, reward).otherwise(0.0)))


def perplexity(lp: Column, mask: Column) -> Column:
    return F.exp(-masked_stats(lp, mask)["mean"])


def response_length(mask: Column) -> Column:
    """Tokens from the first 1 of a mask on; 0 without one."""
    at = F.array_position(mask, 1)
    return F.when(at > 0, F.size(mask) - at + 1).otherwise(F.lit(0).cast("long"))
