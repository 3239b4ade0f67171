import difflib
import zlib

import pytest

from sparkloom.functions import answers as A
from sparkloom.plans import hooks
from sparkloom.plans.registry import QUERIES


def test_boxes():
    assert A.last_boxed(r"\boxed{1} and \boxed{\frac{a}{b}} x") == r"\frac{a}{b}"
    assert A.last_boxed("none") is None and A.last_boxed(r"\boxed{open") is None and A.last_boxed(None) is None


def test_scores():
    assert A.score_marked(r"<think>\boxed{1}</think> \boxed{7}", r"\boxed{7}") == 1
    assert A.score_marked(r"\boxed{7}", "7") == 0 and A.score_marked(None, "7") == 0
    assert A.score_integer("Answer: 3\nAnswer: x = $42$", "42.0") == 1.0
    assert A.score_integer("so \\boxed{42}", "42", strict=True) == 1.0 and A.score_integer("Answer: 4", "x") == -1.0


def test_json_and_fuzzy():
    assert A.json_object('x {"a": 1} {"b": {"c": 2}, "a": 3} {', ("a", "b")) == '{"b": {"c": 2}, "a": 3}'
    assert A.json_object("no") is None
    assert A.fuzzy_equal("Search flights", "search flight") and A.fuzzy_equal("colour", "color") and not A.fuzzy_equal("", "x") and not A.fuzzy_equal("abc", "xyz")
    assert A.compression_ratio("ab" * 10000) > 10 and A.compression_ratio("") == float("inf")


def test_hooks(spark):
    df = spark.range(4)
    assert hooks.apply_filter(df, None).where("keep").count() == 4
    rows = hooks.apply_filter(df, lambda d: (d["id"] > 1, d["id"].cast("string"))).collect()
    assert sorted((r["keep"], r["reason"]) for r in rows if not r["keep"]) == [(False, "0"), (False, "1")]
    hooks.hook("half")(lambda d: d.where("id % 2 = 0"))
    assert hooks.chain(df, "half", None).count() == 2 and hooks.load("os.path.join")("a", "b") == "a/b"


def test_repetition_verdicts_match_brute_force(spark, tmp_path):
    noise = "".join(chr(33 + zlib.crc32(str(i).encode()) % 90) for i in range(12000))
    texts = [None, "", "ab" * 5000, "ab" * 5001, noise, noise + "z" * 10000, "z" * 10000 + noise, "é" * 10001]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["repetitive"], r["ratio"]) for r in QUERIES["m4_repetition_verdict"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        raw = text[-10000:].encode() if text and len(text) > 10000 else None
        ratio = raw and len(raw) / len(zlib.compress(raw))
        assert got[i] == (bool(ratio and ratio > 10), ratio)
    assert [got[i][0] for i in range(len(texts))] == [False, False, False, True, False, True, False, True]


def test_fuzzy_verdicts_match_brute_force(spark, tmp_path):
    names = [None, "", " ", "blue rod", "cold widget", "small widget", "large bolt", "spring ring", "RI\nNG", "widget"]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    by_ratio = 0
    for r in QUERIES["f54_fuzzy_verdict"](spark, str(tmp_path)).collect():
        a, b = (" ".join((x or "").lower().split()) for x in (names[r["p_partkey"]], r["expected"]))
        inside = bool(a and b) and (a in b or b in a)
        close = bool(a and b) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.72
        assert r["same"] == (inside or close), (a, b)
        by_ratio += close and not inside
    assert by_ratio > 2
