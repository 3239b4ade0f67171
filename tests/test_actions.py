import difflib
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import actions
from sparkloom.plans import action_queries

SF = "/root/testdata/sf0.001"


def matches(expected, actual):
    return expected in actual or actual in expected or difflib.SequenceMatcher(None, expected, actual).ratio() >= 0.72


def fits(expected, actual):
    return not expected or actual in actions.STANDS_FOR.get(expected, [expected])


def test_texts_and_roles(spark):
    elements = spark.createDataFrame([(1, "e1", "n1", "Textbox", "Search  the site"), (1, "e2", "n2", "button", "Sign in"), (1, "e3", None, "option", ""), (2, "e1", "n1", "button", "Sign in")], "page_id long, ref string, node_id string, role string, text string")
    step = "page_id long, step int, ids array<string>, op string, value string, repr string"
    steps = spark.createDataFrame(
        [
            (1, 1, ["n2", "n2", " "], "CLICK", None, "[link] anything -> CLICK"),
            (1, 2, None, "TYPE", "", "[searchbox] serch the site -> TYPE: Some  Words"),
            (1, 3, [], "hover", None, "[button] sign -> HOVER"),
            (1, 4, [], "CLICK", None, "sign in"),
            (1, 5, [], "CLICK", None, "[combobox] what -> CLICK"),
            (1, 6, [], "CLICK", None, None),
        ],
        step,
    )
    got = {(r["step"], r["ref"]) for r in actions.expected_refs(steps, elements).collect()}
    assert got == {(1, "e2"), (2, "e1"), (3, "e2"), (4, "e2"), (4, "e3"), (5, "e3"), (6, "e1"), (6, "e2"), (6, "e3")}
    said = spark.createDataFrame([(1, 1, "click e2"), (1, 2, '{"op": "type", "ref": "e1", "value": "some words"}'), (1, 3, "CLICK e1"), (1, 4, "CLICK e9"), (1, 5, "go there"), (1, 6, "{bad json"), (1, 2, "TYPE e1: other")], "page_id long, step int, action string")
    out = sorted((r["step"], r["ok"], r["reason"], r["mode"]) for r in actions.verdicts(said, steps, elements).collect())
    assert out == [(1, True, "ok", "pos_candidates"), (2, False, "mismatch", "action_repr_fuzzy"), (2, True, "ok", "action_repr_fuzzy"), (3, False, "mismatch", "action_repr_fuzzy"), (4, False, "unknown_ref", "none"), (5, False, "invalid_action_format", "none"), (6, False, "invalid_action_format", "none")]


def test_equal_steps_and_elements_are_compared_once(spark):
    """2,000 steps of one text on a page with 2,000 elements of one role and text, one of them without a role: four million refs, and one pair of texts."""
    elements = spark.range(2000).select(F.lit(1).alias("page_id"), F.concat(F.lit("e"), "id").alias("ref"), F.lit(None).cast("string").alias("node_id"), F.when(F.col("id") != 7, "button").alias("role"), F.lit("Sign in").alias("text"))
    said = F.when(F.col("id") < 1999, "[button] sign -> CLICK").otherwise("[] sign -> CLICK")
    steps = spark.range(2000).select(F.lit(1).alias("page_id"), F.col("id").alias("step"), F.array().cast("array<string>").alias("ids"), F.lit("CLICK").alias("op"), F.lit("").alias("value"), said.alias("repr"))
    by_id, rest, fits = actions.expected_classes(steps, elements)
    assert by_id.count() == 0 and rest.count() == 2000
    assert {r["role"]: r["count"] for r in fits.groupBy("role").count().collect()} == {"button": 1999, "": 2000}
    assert actions.expected_refs(steps, elements).count() == 1999 * 1999 + 2000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pages_equal_brute_force(spark):
    asked, steps, elements = (x.collect() for x in action_queries.page_steps(spark, SF))
    by_page, refs, verdicts = {}, set(), set()
    for e in elements:
        by_page.setdefault(e["page_id"], []).append(e)
    plain = lambda t: " ".join((t or "").lower().split())
    acts = {(a["page_id"], a["step"]): a["action"].split()[1] for a in asked}
    for s in steps:
        role, rest = s["repr"][1:].split("] ", 1)
        target, ids = plain(" ".join(rest.rsplit(" -> ", 1)[0].split()).strip(" .")), s["ids"]
        own = by_page[s["page_id"]]
        good = {e["ref"] for e in own if (e["node_id"] in ids if ids else fits(role, e["role"]) and matches(target, plain(e["text"])))}
        refs |= {(s["page_id"], s["step"], r) for r in good}
        ref = acts[s["page_id"], s["step"]]
        known = any(e["ref"] == ref for e in own)
        reason = "unknown_ref" if not known else "ok" if ref in good else "mismatch"
        verdicts.add((s["page_id"], s["step"], reason == "ok", reason, "none" if not known else "pos_candidates" if ids else "action_repr_fuzzy"))
    assert {tuple(r) for r in action_queries.j9_page_refs(spark, SF).collect()} == refs
    assert {tuple(r) for r in action_queries.f55_page_verdicts(spark, SF).collect()} == verdicts
