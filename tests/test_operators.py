import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import tokens as T
from sparkloom.operators import groups as G
from sparkloom.operators import metrics as M
from sparkloom.operators import packing, pages
from sparkloom.operators import relational as R
from sparkloom.sources import files
from sparkloom.streaming import stateful


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()] or [F.lit(1)])
    return df.select(column.alias("out")).first()["out"]


def test_group_zscore_variants(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0)], "g string, r double")
    got = sorted((r["g"], round(r["reward_norm"], 5)) for r in G.group_zscore(df, ["g"], "r").collect())
    mean, std = 4 / 3, ((1 / 9 + 25 / 9 + 16 / 9) / 3) ** 0.5
    assert got == sorted([("a", round((x - mean) / (std + 1e-6), 5)) for x in (1, 3, 0)] + [("b", 5.0)])
    alone = G.group_zscore(df, ["g"], "r", sample=True, single="nan").where("g = 'b'").first()["reward_norm"]
    assert alone != alone


def test_step_zscore_copies_the_step_before(spark):
    rows = [("a", 1, 1.0, True), ("b", 1, 3.0, False), ("a", 2, 9.0, True), ("a", 3, 9.0, True), ("b", 5, 2.0, False)]
    got = {(r["e"], r["s"]): round(r["reward_norm"], 4) for r in G.step_zscore(spark.createDataFrame(rows, "e string, s int, r double, won boolean"), "e", "s", "r", "won").collect()}
    assert got == {("a", 1): -1.0, ("b", 1): 1.0, ("a", 2): -1.0, ("a", 3): -1.0, ("b", 5): -1.0}


def test_returns_and_advantages(spark):
    assert one(spark, G.discounted(F.col("r"), 0.5), r=[1.0, 2.0, 4.0]) == [3.0, 4.0, 4.0]
    got = one(spark, G.gae(F.col("r"), F.col("v"), 0.9, 0.5), r=[1.0, 2.0], v=[0.5, 1.0])
    last = 2.0 - 1.0
    assert got == pytest.approx([1.0 + 0.9 * 1.0 - 0.5 + 0.45 * last, last])


def test_pass_at_k(spark):
    rows = [("a", i < 1) for i in range(4)] + [("b", False), ("b", False), ("c", True)]
    got = {r["k"]: r["pass_at_k"] for r in M.pass_at_k(spark.createDataFrame(rows, "g string, ok boolean"), ["g"], F.col("ok")).collect()}
    assert got == pytest.approx({1: 0.125, 2: 0.25, 4: 1.0})


def test_top_k_breaks_ties_by_id(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = [(r["row_id"], r["rank"]) for r in R.top_k(df.where("id = 0"), df, 3, "id", "id", "v").orderBy("rank").collect()]
    assert got == [(0, 1), (2, 2), (4, 3)]


@pytest.mark.parametrize("descending", [True, False])
def test_top_k_equals_brute_force(spark, monkeypatch, descending):
    """Many copies of few vectors, small blocks, vectors of nothing, null vectors; ids of text. Queries and rows in several blocks."""
    monkeypatch.setattr(R, "MOST_QUERIES", 20)
    rnd = random.Random(3)
    kinds = [[float(rnd.randint(-3, 3)) for _ in range(5)] for _ in range(60)] + [[0.0] * 5, [1.0, 0.0, 0.0, 0.0, 0.0]]
    rows = [(f"r{i:04}", rnd.choice(kinds) if i % 3 else kinds[-1]) for i in range(900)] + [("n1", None), ("n0", [1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = R.top_k(df.where("id < 'r0040' AND id >= 'r' OR id = 'n1'"), df, 4, "id", "id", "v", descending).collect()

    def score(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return round(dot(a, b) / (max(dot(a, a) ** 0.5, 1e-12) * max(dot(b, b) ** 0.5, 1e-12)), 9)

    known = {i: v for i, v in rows if v and None not in v}
    for q in [f"r{i:04}" for i in range(40)]:
        want = sorted((-score(known[q], v) if descending else score(known[q], v), i) for i, v in known.items())[:4]
        assert [(r["row_id"], abs(r["score"])) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, pytest.approx(abs(s), abs=2e-9)) for s, i in want]
    assert [(r["row_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == "n1"] == [("n0", None), ("n1", None), ("r0000", None), ("r0001", None)]
    assert len(got) == 41 * 4


def test_products_of_vectors_do_not_grow_with_expressions(spark):
    """3,000 queries against 6,000 rows: 18 million pairs. How long expressions for each pair took here was not measured."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(6000, 32)))], "id long, v array<double>")
    began = time.time()
    assert R.top_k(df.where("id % 2 = 0"), df, 2, "id", "id", "v").count() == 6000
    assert time.time() - began < 30


def test_longest_shared_prefixes(spark):
    """Equal names, names inside names, none shared, empty and null ones, a repeated key; and a prefix of all names meets no join of all rows."""
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choices("ab\u00e9", k=rnd.randint(0, 6)))) for i in range(60)] + [(100, None), (101, "q"), (102, "long name"), (103, "long name"), (104, "long name too"), (7, "long nam"), (None, "qq")]
    df = spark.createDataFrame(rows, "k long, name string")
    want = {}
    for at, (k, name) in enumerate(rows):
        others = [n for j, (_, n) in enumerate(rows) if j != at and n]
        best = next((name[:i] for i in range(len(name or ""), 0, -1) if any(n.startswith(name[:i]) for n in others)), None)
        want[k] = max(want.get(k), best, key=lambda x: len(x or ""))
    out = R.longest_shared_prefix(df, "k", "name", "prefix")
    assert {r["k"]: r["prefix"] for r in out.collect()} == want
    # What is joined to the rows are their own prefixes: a row each at most.
    hot = spark.range(3000).select("id", F.concat(F.lit("same"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("")).alias("name"))
    plan = R.longest_shared_prefix(hot, "id", "name", "prefix")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "_prefix" not in plan.split("Join")[1].split("\n")[0]


def test_margin_filter(spark):
    df = spark.createDataFrame([("a", 1, 0.9, 10), ("a", 2, 0.1, 10), ("b", 1, 0.5, 4)], "g string, c int, p double, n int")
    got = {r["g"]: (r["keep"], r["z"]) for r in R.margin_filter(df, ["g"], "c", "p", "n").collect()}
    assert got["a"][0] and got["a"][1] > 5 and got["b"] == (True, None)


def test_packing():
    assert packing.first_fit_bins([5, 6, 4, 5], 10) == [0, 1, 0, 2]
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 100) for _ in range(60)]
    parts = packing.largest_differencing(sizes, 4)
    sums = [sum(n for n, p in zip(sizes, parts) if p == k) for k in range(4)]
    assert max(sums) - min(sums) <= 5
    assert packing.largest_differencing([], 3) == []
    even = packing.largest_differencing(sizes, 4, equal=True)
    sums = [sum(n for n, p in zip(sizes, even, strict=True) if p == k) for k in range(4)]
    assert [even.count(k) for k in range(4)] == [15] * 4 and max(sums) - min(sums) <= 10
    with pytest.raises(ValueError):
        packing.largest_differencing(sizes[:59], 4, equal=True)


def test_token_functions(spark):
    assert one(spark, T.kl(F.col("a"), F.col("b"), "k2"), a=[1.0, 2.0], b=[0.0, 4.0]) == [0.5, 2.0]
    stats = one(spark, T.masked_stats(F.col("a"), F.col("m")), a=[1.0, 2.0, 5.0], m=[1, 0, 1])
    assert tuple(stats) == (6.0, 3.0, 1.0, 5.0)
    assert tuple(one(spark, T.masked_stats(F.col("a"), F.col("m")), a=[1.0], m=[0])) == (0.0, 0.0, 0.0, 0.0)
    assert one(spark, T.suffix(F.col("a"), F.lit(2)), a=[1, 2, 3]) == [2, 3]
    assert one(spark, T.suffix(F.col("a"), F.lit(0)), a=[1, 2, 3]) == []
    assert one(spark, T.response_length(F.col("m")), m=[0, 0, 1, 0]) == 2
    with pytest.raises(ValueError):
        T.kl(F.col("a"), F.col("b"), "other")


def test_text_functions(spark):
    assert one(spark, X.normalise_answer(F.lit("The  Cat, an animal!"))) == "cat animal"
    f1 = one(spark, X.token_f1(F.lit("a cat sat"), F.lit("the cat ran away")))
    assert f1["f1"] == pytest.approx(0.4) and one(spark, X.token_f1(F.lit("yes"), F.lit("yes it is")))["f1"] == 0
    action = one(spark, X.parse_action_repr(F.lit("[button] Go now -> HOVER")))
    assert tuple(action) == ("button", "Go now", "CLICK", "")
    assert tuple(one(spark, X.parse_model_action(F.lit("type e12 | hi there")))) == ("TYPE", "e12", "hi there")
    got = one(spark, X.action_of(F.lit("<think>x</think><action> Open Box </action>")))
    assert (got["action"], got["valid"]) == ("open box", True)
    assert one(spark, X.grammar_prompt(F.lit('x Your task is to: put it there. "more'))) == "put it there"
    assert one(spark, X.audit(F.lit("plain text")))["pass"]
    for bad in ("aaaaaaaaaa", "go " * 9, "café", "zero​width"):
        assert not one(spark, X.audit(F.lit(bad)))["pass"]
    assert one(spark, X.judgment_index(F.lit("Judgment: 3"), F.lit(2))) is None


def test_page_snapshot(spark):
    html = "<form><input type=checkbox name=a><input name=b><input type=hidden name=h><a href=x><b>Go</b></a><a href=y>Go</a><div role=Tab title=true placeholder=T></div><p>no</p><i tabindex=0>x</i></form></p>"
    rows = pages.snapshot(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id", "html").orderBy("ref").collect()
    assert [(r["ref"], r["role"], r["name"], r["nth"]) for r in rows] == [("e1", "checkbox", "a", 0), ("e2", "textbox", "b", 0), ("e3", "link", "Go", 0), ("e4", "link", "Go", 1), ("e5", "tab", "T", 0), ("e6", "button", "x", 0)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 2}\n')
    read = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long")
    assert sorted(r["id"] for r in files.good_rows(read).collect()) == [1, 2]
    assert files.split_slice("x.parquet@[2:5]") == ("x.parquet", (2, 5)) and files.split_slice("x") == ("x", None)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "t" / "c.json").write_text("broken")
    assert sorted((r["task_index"], r["x"]) for r in files.read_json_arrays(spark, str(tmp_path / "t"), "x:long").collect()) == [(0, 1), (1, 2)]
    with pytest.raises(ValueError):
        files.read_any(spark, "x.csv")


def test_pages_are_parsed_a_few_at_a_time():
    batch = pd.DataFrame({"id": range(1000), "html": ["<a>x</a>" * (i % 3) for i in range(999)] + [None]})
    frames = list(pages.parsed(iter([batch]), "id", "html"))
    assert max(map(len, frames)) <= 64
    assert [(i, len(e)) for f in frames for i, e in zip(f["id"], f["e"], strict=True)] == [(i, i % 3) for i in range(999)] + [(999, 0)]


def test_slices_follow_the_order_of_files(spark, tmp_path):
    """Later files are larger, and some are cut into splits; slices inside a file, over several, of nothing, and beyond the end. Also lines that can't be read."""
    path = tmp_path / "t.parquet"
    path.mkdir()
    sizes, at = [5, 40, 3, 3000], 0
    for k, n in enumerate(sizes):
        pq.write_table(pa.table({"id": list(range(at, at + n)), "pad": ["x" * 50 + str(i) for i in range(n)]}), path / f"part-{k}.parquet", row_group_size=500)
        at += n
    (tmp_path / "a.jsonl").write_text("".join(f'{{"id": {i}}}\nno\n' for i in range(20)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        for a, b in ((3, 7), (0, 60), (44, 50), (47, 1700), (3040, 4000), (7, 7), (9000, 9001)):
            assert [r["id"] for r in files.read_any(spark, f"{path}@[{a}:{b}]").collect()] == list(range(a, min(b, at))), (a, b)
        assert [r["id"] for r in files.read_any(spark, f"{tmp_path}/a.jsonl@[3:9]", "id long").collect()] == list(range(3, 9))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_cursor_wraps_into_the_next_epoch(spark):
    df = spark.range(5).withColumnRenamed("id", "ord")
    rows, offset, epochs = files.cursor(df, "ord", 3, 4, seed=7)
    assert offset == 2 and epochs == 1 and rows.count() == 4
    whole, _, _ = files.cursor(df, "ord", 0, 5, seed=7)
    assert sorted(r["ord"] for r in whole.collect()) == [0, 1, 2, 3, 4]


def test_groups_complete_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4), ("b", 5), ("a", 6)], "k string, v long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, v long").parquet(src)
    done = stateful.complete_groups(stream, "k", ["v"], size=2)
    q = done.writeStream.format("memory").queryName("done").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["k"], r["v"]) for r in spark.table("done").collect())
    assert got == [("a", 1), ("a", 3), ("b", 2), ("b", 5)]


def test_spread_ordinal(spark):
    """Numbers as by one window, with null keys and values, ties, few and many ranges, and an empty table."""
    rows = [(None if i % 11 == 0 else "ab"[i % 7 == 0], None if i == 50 else (i * 37) % 101 // 2, i) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    for bins in (2, 9, 200):
        found = G.spread_ordinal(df, ["k"], "v", "n", bins).collect()
        assert sorted(r.id for r in found) == list(range(101))
        for key in ("a", "b", None):
            mine = sorted((r.n, -1 if r.v is None else r.v) for r in found if r.k == key)
            assert [n for n, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
    assert G.spread_ordinal(df.limit(0), ["k"], "v", "n").collect() == []
