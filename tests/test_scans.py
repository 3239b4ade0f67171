import random

import pytest

from sparkloom.operators import packing, scans


def merged(rows):
    """Intervals merged one by one, and the gaps between."""
    out = []
    for k, a, b in sorted((r for r in rows if None not in r[1:]), key=lambda r: (r[0] or "", r[1], r[2])):
        if out and out[-1][0] == k and a <= out[-1][2]:
            out[-1] = (k, out[-1][1], max(out[-1][2], b), out[-1][3] + 1)
        else:
            out.append((k, a, b, 1))
    return out, [(x[0], x[2], y[1]) for x, y in zip(out, out[1:]) if x[0] == y[0]]


@pytest.mark.parametrize("seed", range(3))
def test_intervals_of_one_large_group(spark, seed):
    """One type has nearly all rows, one interval spans many others, some repeat; islands run over the seams of ranges."""
    rnd = random.Random(seed)
    rows = [("x" if rnd.random() < 0.9 else None if rnd.random() < 0.5 else "y", a := rnd.randint(0, 20000), a + rnd.randint(0, 12)) for _ in range(3000)]
    rows += [("x", 5000, 9000), ("x", 5000, 9000), ("y", 3, None), ("x", None, 4)]
    df = spark.createDataFrame(rows, "k string, s long, e long").repartition(5)
    islands, between = merged(rows)
    key = lambda r: (r[0] or "", *r[1:])
    got = sorted((tuple(r) for r in scans.interval_union(df, ["k"], "s", "e").collect()), key=key)
    assert got == sorted(islands, key=key)
    assert sorted((tuple(r) for r in scans.idle_gaps(df, ["k"], "s", "e").collect()), key=key) == sorted(between, key=key)


def test_intervals_of_nothing(spark):
    df = spark.createDataFrame([], "k string, s long, e long")
    assert scans.interval_union(df, ["k"], "s", "e").count() == 0 and scans.idle_gaps(df, ["k"], "s", "e").count() == 0


@pytest.mark.parametrize("capacity", [1, 37, 400, 10**6])
def test_chunks_equal_the_sequential_rule(spark, capacity):
    """One group of nearly all rows; zero, null and large sizes; a group of one row; a null group."""
    rnd = random.Random(capacity)
    rows = [("a" if i % 20 else "b" if i % 40 else None, i, rnd.choice([0, None, 1, 5, 30, 500])) for i in range(1500)] + [("c", 0, 3)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(4)
    want, state = {}, {}
    for g, i, n in sorted(rows, key=lambda r: r[1]):
        k, total = state.get(g, (0, 0))
        want[g, i] = k
        total += n or 0
        state[g] = (k + 1, 0) if total >= capacity else (k, total)
    out = scans.chunks(df, ["g"], "i", "n", capacity)
    assert out.columns == ["g", "i", "n", "chunk"]
    assert {(r["g"], r["i"]): r["chunk"] for r in out.collect()} == want


def test_chunks_without_groups(spark):
    assert sorted(tuple(r) for r in scans.chunks(spark.createDataFrame([(1, 3), (2, 3), (3, 5), (4, 1)], "i long, n long"), [], "i", "n", 6).collect()) == [(1, 3, 0), (2, 3, 0), (3, 5, 1), (4, 1, 1)]
    with pytest.raises(ValueError):
        scans.chunks(spark.range(1), [], "id", "id", 0)


def test_schedules(spark):
    """Every rank has the micro-batches that the fullest one needs, dealt as largest differencing deals them."""
    rnd = random.Random(3)
    rows = [(i // 60, i % 3, i, rnd.choice([None, 5, 40, 90])) for i in range(180)]
    got = packing.schedule(spark.createDataFrame(rows, "step long, rank int, i long, n long"), "step", "rank", "i", "n", 100).collect()
    assert len(got) == len(rows)
    for step in range(3):
        held = {rank: [(i, n or 0) for s, r, i, n in rows if (s, r) == (step, rank)] for rank in range(3)}
        most = max(max(packing.first_fit_bins([n for _, n in x], 100)) + 1 for x in held.values())
        for rank, x in held.items():
            own = sorted((r["i"], r["micro_batch"]) for r in got if (r["step"], r["rank"]) == (step, rank))
            assert [p for _, p in own] == packing.largest_differencing([n for _, n in x], most)
            assert {r["micro_batches"] for r in got if r["step"] == step} == {most}
