"""Answers that no column expression can read: balanced braces, formulas, JSON inside prose, fuzzy text. Arrow-batched."""

from __future__ import annotations

import difflib
import json
import lzma
import re
import zlib
from bz2 import compress as bz2_compress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.formulas import final_form, same_formula


def last_boxed(text: str | None) -> str | None:
    r"""Content of the last \boxed{...} with balanced braces."""
    at = (text or "").rfind("\\boxed{")
    if at < 0:
        return None
    start, depth = at + 7, 1
    for i in range(start, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if not depth:
            return text[start:i]
    return None


def score_boxed(response: str | None, truth: str | None) -> int:
    """1 if the last box of a reply holds the truth (or the truth's own box)."""
    truth = last_boxed(truth) if truth and "\\boxed" in truth else truth
    return int(bool(truth) and same_formula(last_boxed(response), truth))


def score_marked(response: str | None, truth: str | None) -> int:
    """1 if the boxed answer behind the reasoning equals the truth. The reasoning must have an end."""
    response = response or ""
    if "</think>" in response:
        response = response.rsplit("</think>", 1)[1]
    elif "###Response" in response:
        response = response.split("###Response")[1]
    else:
        return 0
    return score_boxed(response, truth)


def score_integer(response: str | None, truth: str | None, strict: bool = False) -> float:
    """1 or -1: the last 'Answer:' line among the last 300 characters (strict: the box among the last 100) against a whole number."""
    tail = (response or "")[-300:]
    if strict:
        return 1.0 if last_boxed(tail[-100:]) == truth else -1.0
    found = re.findall(r"(?i)Answer\s*:\s*([^\n]+)", tail)
    try:
        want = str(int(float(final_form(truth or ""))))
    except (ValueError, OverflowError):
        return -1.0
    return 1.0 if final_form(found[-1] if found else "[INVALID]") == want else -1.0


def json_object(text: str | None, keys: tuple[str, ...] = ()) -> str | None:
    """The best JSON object in a text: most wanted keys, then longest, then last; whole text, fenced blocks or balanced braces."""
    text, best = text or "", None
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            value, end = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(value, dict):
            rank = (sum(k in value for k in keys), end - m.start(), end)
            if best is None or rank > best[0]:
                best = (rank, value)
    return None if best is None else json.dumps(best[1], ensure_ascii=False)


def fuzzy_equal(expected: str | None, actual: str | None, least: float = 0.72) -> bool:
    """One contains the other, or their matching blocks make up enough of both; case and space aside."""
    a, b = (" ".join((x or "").lower().split()) for x in (expected, actual))
    if not a or not b:
        return False
    return a in b or b in a or difflib.SequenceMatcher(None, a, b).ratio() >= least


def compression_ratio(text: str | None, kind: str = "zlib") -> float:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return float("inf")
    packed = {"zlib": zlib.compress, "bz2": bz2_compress, "lzma": lzma.compress}[kind](raw)
    return len(raw) / len(packed)


def _batched(f, kind: str):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*(None if v is None or v is pd.NA or v != v else v for v in row)) for row in zip(*columns, strict=True)], dtype=object)

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def boxed(text: Column) -> Column:
    return _batched(last_boxed, "string")(text)


def same_answer(given: Column, truth: Column) -> Column:
    return _batched(same_formula, "boolean")(given, truth)


def boxed_score(response: Column, truth: Column) -> Column:
    return _batched(score_boxed, "int")(response, truth)


def marked_score(response: Column, truth: Column) -> Column:
    return _batched(score_marked, "int")(response, truth)


def integer_score(response: Column, truth: Column) -> Column:
    return _batched(score_integer, "double")(response, truth)


def best_json(text: Column, *keys: str) -> Column:
    return _batched(lambda t: json_object(t, keys), "string")(text)


def fuzzy(a: Column, b: Column) -> Column:
    """Containment is tested first, in the JVM."""
    squeezed = [F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))) for x in (a, b)]
    inside = (squeezed[0] != "") & (squeezed[1] != "") & (F.contains(squeezed[0], squeezed[1]) | F.contains(squeezed[1], squeezed[0]))
    return F.when(inside, True).otherwise(_batched(fuzzy_equal, "boolean")(a, b))


def last_ratio(text: Column, least: int = 10000) -> Column:
    """Compression ratio of the last part of long texts, null for others; the packer sees long texts only."""
    long = F.length(text) > least
    return F.when(long, _batched(compression_ratio, "double")(F.when(long, F.right(text, F.lit(least)))))


def repetitive(text: Column, least: int = 10000, ratio: float = 10.0) -> Column:
    """Long texts whose last part compresses too well."""
    return F.coalesce(last_ratio(text, least) > ratio, F.lit(False))
