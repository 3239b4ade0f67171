import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import advantages as A
from sparkloom.operators.groups import reverse_scan

KIND = "id int, estimator string, reward double, log_probs array<double>, ref_log_probs array<double>, teacher_log_probs array<double>, values array<double>, mask array<int>"


def rows(n=40, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = int(rng.integers(1, 300))
        mask = rng.integers(0, 2, k)
        mask[rng.integers(0, k)] = 1
        out.append((i, A.ESTIMATORS[i % 5], float(rng.normal()), *(rng.normal(size=k).tolist() for _ in range(4)), mask.tolist()))
    return out


def brute(r, kl_coef, gamma, lam, distil):
    _, kind, reward, lp, ref, teacher, values, mask = r
    lp, ref, teacher, values, mask = map(np.array, (lp, ref, teacher, values, mask))
    kl = lp - ref if kl_coef else np.zeros(len(lp))
    if kind in ("grpo", "gspo"):
        adv = np.full(len(lp), reward)
        ret = adv
    elif kind == "ppo":
        token, carry, adv = -kl_coef * kl, 0.0, np.zeros(len(lp))
        token[-1] += reward
        for t in reversed(range(len(lp))):
            carry = token[t] + gamma * (values[t + 1] if t + 1 < len(lp) else 0.0) - values[t] + gamma * lam * carry
            adv[t] = carry
        ret = adv + values
    elif kind == "reinforce_plus_plus":
        token, carry, adv = -kl_coef * kl * mask, 0.0, np.zeros(len(lp))
        token[np.flatnonzero(mask)[-1]] += reward
        for t in reversed(range(len(lp))):
            carry = token[t] + gamma * carry
            adv[t] = carry
        ret = adv
    else:
        adv = reward - kl_coef * kl
        ret = adv
    return (adv - distil * (lp - teacher) if distil else adv), ret


@pytest.mark.parametrize("kl_coef, gamma, lam, distil", [(0.0, 1.0, 1.0, None), (0.1, 0.99, 0.95, 0.2)])
def test_every_estimator(spark, kl_coef, gamma, lam, distil):
    given = rows()
    df = spark.createDataFrame(given, KIND)
    got = {r["id"]: r for r in A.advantages(df, kl_coef=kl_coef, gamma=gamma, lam=lam, distil=distil).collect()}
    white = {r["id"]: r["advantages"] for r in A.advantages(df, kl_coef=kl_coef, gamma=gamma, lam=lam, distil=distil, whiten=True).collect()}
    assert len(got) == len(given)
    want = {r[0]: brute(r, kl_coef, gamma, lam, distil) for r in given}
    for r in given:
        np.testing.assert_allclose(got[r[0]]["advantages"], want[r[0]][0], atol=1e-9)
        np.testing.assert_allclose(got[r[0]]["returns"], want[r[0]][1], atol=1e-9)
    for kind in A.ESTIMATORS:
        own = [r for r in given if r[1] == kind]
        inside = np.concatenate([want[r[0]][0][np.array(r[7]) == 1] for r in own])
        for r in own:
            np.testing.assert_allclose(white[r[0]], (want[r[0]][0] - inside.mean()) / np.sqrt(inside.var(ddof=1) + 1e-8), atol=1e-6)


def test_errors(spark):
    one = spark.createDataFrame([(1, "other", 1.0, [0.0], [0.0], [0.0], [0.0], [1])], KIND)
    with pytest.raises(Exception, match="unknown estimator other"):
        A.advantages(one).collect()
    masked = spark.createDataFrame([(1, "reinforce_plus_plus", 1.0, [0.0], [0.0], [0.0], [0.0], [0])], KIND)
    with pytest.raises(Exception, match="fully masked"):
        A.advantages(masked).collect()
    with pytest.raises(Exception, match="no token is in the mask"):
        A.advantages(masked.withColumn("estimator", F.lit("grpo")), whiten=True).collect()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
@pytest.mark.parametrize("decay", [0.0, 0.9405, 1.0])
def test_scan_equals_recurrence(n, decay):
    values, carry = np.random.default_rng(n).normal(size=n), 0.0
    want = np.zeros(n)
    for t in reversed(range(n)):
        carry = values[t] + decay * carry
        want[t] = carry
    np.testing.assert_allclose(reverse_scan(values, decay), want, atol=1e-9)


def test_long_scans_are_linear():
    values = np.random.default_rng(0).normal(size=131_072)
    began = time.time()
    reverse_scan(values, 0.9405)
    assert time.time() - began < 1
