"""Actions on page elements: which elements a step expects, and whether an action is the expected one.

A step names its element by node ids or, where it has none, by a role and a text. The
similarity join over roles and texts runs only for steps without ids, over distinct roles and
texts, and only inside a page and a role that can stand for the expected one. Texts match if one contains the
other; only pairs that lengths allow come to the matching-block ratio, in Arrow batches.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X

# Roles that can stand for an expected one (all others stand for themselves), and the least ratio of matching blocks.
STANDS_FOR = {"searchbox": ["textbox", "searchbox"], "textbox": ["textbox", "searchbox"], "combobox": ["combobox", "listbox", "option"], "option": ["option", "combobox"]}
LEAST_RATIO = 0.72


def roles_for(role: Column) -> Column:
    """The roles that can stand for a (normalised) role."""
    out = F.array(role)
    for expected, roles in STANDS_FOR.items():
        out = F.when(role == expected, F.array(*map(F.lit, roles))).otherwise(out)
    return out


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def texts_match(expected: Column, actual: Column, least: float | None = LEAST_RATIO) -> Column:
    """Normalised texts of which one contains the other, or whose matching blocks make up enough of both; least None: containment alone."""
    inside = F.contains(expected, actual) | F.contains(actual, expected)
    if least is None:
        return inside
    n, m = F.length(expected), F.length(actual)
    possible = ~inside & (2 * F.least(n, m) >= least * (n + m))
    # Pairs that lengths rule out, or that containment settles, come to the ratio as nothing.
    ratio = F.pandas_udf(_ratios, "double")(F.when(possible, expected).otherwise(""), F.when(possible, actual).otherwise("x"))
    return inside | possible & (ratio >= least)


def _ids(ids: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: X.squeeze(x)), lambda x: x != ""))


def _plain_steps(steps: DataFrame, page: str, step: str) -> DataFrame:
    """page, step, ids, op, role, target, value of each step: what its action and its description say."""
    said = X.parse_action_repr(F.col("repr"))
    rows = steps.select(page, step, _ids(F.col("ids")).alias("ids"), F.col("op").alias("_op"), F.col("value").alias("_value"), said.alias("r"))
    value = F.coalesce(F.nullif(X.squeeze(F.col("_value")), F.lit("")), F.col("r.value"))
    return rows.select(page, step, "ids", X.normal_op(F.col("_op")).alias("op"), "r.role", X.squeeze(F.col("r.target"), lower=True).alias("target"), value.alias("value"))


def expected_classes(steps: DataFrame, elements: DataFrame, page: str = "page_id", step: str = "step", least: float | None = LEAST_RATIO) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What expected_refs() gives, not yet spread over the steps that mean the same: rows by id (page, step, ref), the other steps (page, step, role, target), and the elements of each kind of step (page, role, target, ref).

    Steps of a page with one role and text are one kind, elements with one role and text another; only kinds are compared, and a text is compared once in a page.
    """
    plain = _plain_steps(steps, page, step)
    rows = elements.select(page, "ref", X.squeeze(F.col("node_id")).alias("node"), X.squeeze(F.col("role"), lower=True).alias("role"), X.squeeze(F.col("text"), lower=True).alias("text"))
    by_id = plain.select(page, step, F.explode("ids").alias("node")).join(rows, [page, "node"]).select(page, step, "ref")
    rest = plain.where(F.size("ids") == 0).select(page, step, "role", "target")
    # A null role is neither given nor empty, and fits nothing.
    asked = rest.where("role IS NOT NULL").select(page, "role", "target").distinct().withColumn("wanted", F.when(F.col("role") != "", roles_for(F.col("role"))))
    there = rows.select(page, "role", "text").distinct().withColumnRenamed("role", "has")
    targets = asked.groupBy(page, "target").agg(F.flatten(F.collect_set("wanted")).alias("wanted"), F.bool_or(F.col("wanted").isNull()).alias("any"))
    texts = there.groupBy(page, "text").agg(F.collect_set("has").alias("all"))
    met = targets.join(texts, page).where(F.col("any") | F.arrays_overlap("wanted", "all")).where(texts_match(F.col("target"), F.col("text"), least)).select(page, "target", "text")
    kinds = met.join(asked, [page, "target"]).join(there, [page, "text"]).where(F.col("wanted").isNull() | F.array_contains("wanted", F.col("has")))
    # An element's role may be null, where any will do.
    named = rows.select(F.col(page).alias("_page"), F.col("text").alias("_text"), F.col("role").alias("_has"), "ref")
    fits = kinds.join(named, (F.col(page) == F.col("_page")) & (F.col("text") == F.col("_text")) & F.col("has").eqNullSafe(F.col("_has")))
    return by_id, rest, fits.select(page, "role", "target", "ref")


def expected_refs(steps: DataFrame, elements: DataFrame, page: str = "page_id", step: str = "step", least: float | None = LEAST_RATIO) -> DataFrame:
    """The elements that each step may mean: page, step, ref.

    steps: page, step, ids (array), op, value, repr (``[role] target -> OP: value``); elements: page, ref, node_id, role, text.
    Steps with ids take the elements with these; the others the elements of a fitting role
    and text. An empty role or text fits all.
    """
    by_id, rest, fits = expected_classes(steps, elements, page, step, least)
    return by_id.unionByName(rest.join(fits, [page, "role", "target"]).select(page, step, "ref"))


def verdicts(actions: DataFrame, steps: DataFrame, elements: DataFrame, page: str = "page_id", step: str = "step", least: float | None = LEAST_RATIO) -> DataFrame:
    """Whether each action is what its step expects: page, step, ok, reason, mode, op_ok, target_ok, value_ok.

    actions: page, step, action (``OP eN | value`` or JSON). An action meets one element at most, by its ref, so no step
    meets all elements. Without op or ref the action is invalid, without its element unknown.
    Clicks need no value. A step without an action has no row.
    """
    parsed = actions.select(page, step, X.parse_model_action(F.col("action")).alias("a"))
    rows = elements.select(page, F.col("ref").alias("_ref"), X.squeeze(F.col("node_id")).alias("node"), X.squeeze(F.col("role"), lower=True).alias("_role"), X.squeeze(F.col("text"), lower=True).alias("text"), F.lit(True).alias("known"))
    met = parsed.join(_plain_steps(steps, page, step), [page, step]).withColumn("_ref", F.col("a.ref")).join(rows, [page, "_ref"], "left")
    invalid, unknown = (F.col("a.op") == "") | (F.col("a.ref") == ""), F.col("known").isNull()
    by_id = F.size("ids") > 0
    role_ok = (F.col("role") == "") | F.array_contains(roles_for(F.col("role")), F.col("_role"))
    asked = F.when(invalid | unknown | by_id | ~role_ok, "").otherwise(F.col("target"))
    target_ok = F.when(by_id, F.array_contains("ids", F.col("node"))).otherwise(role_ok & texts_match(asked, F.coalesce("text", F.lit("")), least))
    value_ok = (F.col("op") == "CLICK") | (X.squeeze(F.col("a.value"), lower=True) == X.squeeze(F.col("value"), lower=True))
    told = met.select(page, step, invalid.alias("invalid"), unknown.alias("unknown"), (F.col("a.op") == F.col("op")).alias("op_ok"), target_ok.alias("target_ok"), value_ok.alias("value_ok"), by_id.alias("by_id"))
    ok = F.col("op_ok") & F.col("target_ok") & F.col("value_ok")
    barred = F.col("invalid") | F.col("unknown")
    reason = F.when(F.col("invalid"), "invalid_action_format").when(F.col("unknown"), "unknown_ref").when(ok, "ok").otherwise("mismatch")
    mode = F.when(barred, "none").when(F.col("by_id"), "pos_candidates").otherwise("action_repr_fuzzy")
    flag = lambda c: F.when(~barred, F.col(c))
    return told.select(page, step, (~barred & ok).alias("ok"), reason.alias("reason"), mode.alias("mode"), *[flag(c).alias(c) for c in ("op_ok", "target_ok", "value_ok")])
