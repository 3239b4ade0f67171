"""Rule-based rewards: each row goes to the grader that its own kind, or the default, names.

All rows are graded in one pass; what needs Python sees nothing of the rows of other kinds, in
Arrow batches. A reply's kind may begin with ``boxed_``: then its last box is graded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import answers as A
from sparkloom.functions import text as X
from sparkloom.functions.binding import let

# Fixed value: letters that may be chosen if a row says nothing of its choices.
LETTERS = "ABCDEFGH"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _plain(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))


def chosen_letter(reply: Column, letters: Column) -> Column:
    """The letter a reply settles on, behind its thinking: one named by a phrase, else the last valid capital that stands alone."""
    # Phrases around the letter, in order of weight.
    phrases = [r"(?i)(?:answer|option|choice)\s*(?:is|:)?\s*([A-Z])", r"(?i)([A-Z])\s*(?:is\s*(?:the)?\s*correct)", r"(?i)final\s*(?:answer|option)\s*(?:is|:)?\s*([A-Z])"]
    named = [F.upper(F.regexp_extract(reply, p, 1)) for p in phrases]
    alone = F.filter(F.regexp_extract_all(reply, F.lit(r"(?U)\b([A-Z])\b"), F.lit(1)), lambda x: F.array_contains(letters, x))
    return F.coalesce(*[F.when(F.array_contains(letters, n), n) for n in named], F.try_element_at(alone, F.lit(-1)))


def choice_reward(response: Column, label: Column, choices: Column | None = None, letters: Column | None = None, correct: Column | None = None, answers: list[Column] = ()) -> Column:
    """1.0 if the chosen letter is the correct one; without both letters, if the reply holds the text of a right answer.

    choices, letters: arrays; correct: a letter; answers: further texts of the right answer. Each may be null. The correct
    letter is the given one, else the label if it is a letter, else the letter of the choice that the label names.
    """
    strings, none = "array<string>", F.lit(None)
    choices = F.coalesce(choices if choices is not None else none.cast(strings), F.array().cast(strings))
    given = F.transform(letters if letters is not None else none.cast(strings), lambda x: F.upper(x))
    alphabet = F.array(*map(F.lit, _ALPHABET))
    valid = F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).when(F.size(choices) > 0, F.slice(alphabet, F.lit(1), F.size(choices))).otherwise(F.slice(alphabet, 1, len(LETTERS)))
    label = F.btrim(label)

    def judge(x: Column) -> Column:
        single = F.when((F.length(label) == 1) & F.array_contains(x["valid"], F.upper(label)), F.upper(label))
        named = F.get(x["valid"], (F.array_position(F.transform(x["choices"], lambda c: _plain(c)), _plain(label)) - 1).cast("int"))
        told = F.coalesce(F.nullif(F.upper(F.btrim(correct if correct is not None else none.cast("string"))), F.lit("")), single, F.when(label != "", named))
        return let(F.struct(told.alias("right"), chosen_letter(x["reply"], x["valid"]).alias("said")), lambda y: score(x, y))

    def score(x: Column, y: Column) -> Column:
        choice = F.get(x["choices"], (F.array_position(x["valid"], y["right"]) - 1).cast("int"))
        targets = F.filter(F.transform(F.array(choice, *answers, label), lambda t: _plain(t)), lambda t: t.isNotNull() & (t != ""))
        reply = _plain(x["reply"])
        held = let(reply, lambda r: F.exists(targets, lambda t: F.contains(r, t)))
        fallback = F.coalesce(y["said"] == F.upper(label), F.lit(False)) & y["right"].isNull() & (label != "")
        return F.when(y["said"].isNotNull() & y["right"].isNotNull(), (y["said"] == y["right"]).cast("double")).otherwise((F.coalesce(held, F.lit(False)) | fallback).cast("double"))

    reply = F.substring_index(F.coalesce(response, F.lit("")), "</think>", -1)
    return F.when(response.isNull(), 0.0).otherwise(let(F.struct(reply.alias("reply"), valid.alias("valid"), choices.alias("choices")), judge))


def _choice(df: DataFrame, response: Column, label: Column, seed: int) -> Column:
    has = lambda c: F.col(c) if c in df.columns else None
    return choice_reward(response, label, has("choices"), has("valid_letters"), has("correct_letter"), [F.col(c) for c in ("correct_answer", "answer_text") if c in df.columns])


#: Graders by the name of their kind: (df, response, label, seed) to a column of double.
GRADERS: dict[str, Callable] = {
    "deepscaler": lambda df, r, l, seed: A.marked_score(r, l).cast("double"),
    "dapo": lambda df, r, l, seed: A.integer_score(r, l),
    "math": lambda df, r, l, seed: A.boxed_score(r, l).cast("double"),
    "f1": lambda df, r, l, seed: F.when(r.isNull(), 0.0).otherwise(X.token_f1(r, l)["f1"]),
    "gpqa": _choice,
    "random": lambda df, r, l, seed: F.pmod(F.xxhash64(F.lit(seed), r, l), F.lit(2)).cast("double"),
}


def rewards(df: DataFrame, default: str | None = None, response: str = "response", label: str = "label", kind: str = "rm_type", seed: int = 0, graders: dict[str, Callable] | None = None, custom: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """df with reward (double). The row's kind decides, where it is null or empty the default; custom replaces all graders.

    A kind without a grader, or none at all, is an error, when a row has it. random gives 0 or 1 by a hash of seed and texts, so a task that runs again gives the same.
    """
    if custom is not None:
        return df.withColumn("reward", custom(df).cast("double"))
    known = GRADERS | (graders or {})
    own = F.btrim(F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit(default or "")))
    held = df.withColumns({"_boxed": own.startswith("boxed_"), "_kind": F.regexp_replace(own, "^boxed_", "")})
    # Graders see nothing of the rows of other kinds, so all kinds are graded in one pass over the rows.
    box = A.boxed(F.when(F.col("_boxed"), F.col(response)))
    held = held.withColumn("_reply", F.when(F.col("_boxed"), F.coalesce(box, F.lit(""))).otherwise(F.col(response)))
    said = F.when(F.col("_kind") == "", F.lit("no kind of reward is given")).otherwise(F.concat(F.lit("no grader for "), F.col("_kind")))
    reward = None
    for name, grade in known.items():
        mine = F.col("_kind") == name
        value = grade(held, F.when(mine, F.col("_reply")), F.when(mine, F.col(label)), seed)
        reward = F.when(mine, value) if reward is None else reward.when(mine, value)
    return held.withColumn("reward", reward.otherwise(F.raise_error(said).cast("double"))).drop("_boxed", "_kind", "_reply")
