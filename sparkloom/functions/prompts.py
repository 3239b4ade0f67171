"""Prompts: blocks of listed actions taken out, and placeholders filled from lists of items."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.answers import _batched
from sparkloom.functions.binding import let


def _closing(text: str, at: int) -> int | None:
    """The place behind the bracket that closes the one at ``at``; None if nothing does."""
    depth = 0
    for m in re.compile(r"[\[\]]").finditer(text, at):
        depth += 1 if m[0] == "[" else -1
        if not depth:
            return m.end()
    return None


def without_list(text: str | None, marker: str = "Admissible actions:") -> str:
    """The text without the lines that begin a list at the marker, up to the bracket that closes it and the line ends behind; single blank lines, no spaces at line ends.

    A marker without a list loses its line; a list that never closes stays, with all behind it.
    """
    text, out, at = text or "", [], 0
    while (found := text.find(marker, at)) >= 0:
        out.append(text[at : text.rfind("\n", 0, found) + 1])
        opened = text.find("[", found)
        if opened < 0:
            line_end = text.find("\n", found)
            at = len(text) if line_end < 0 else line_end + 1
            out.append("" if line_end < 0 else "\n")
            continue
        closed = _closing(text, opened)
        if closed is None:
            at = found
            break
        at = re.compile(r"[ \t]*[\r\n]*").match(text, closed).end()
        out.append("\n")
    lines = [line.rstrip() for line in "".join([*out, text[at:]]).replace("\r\n", "\n").split("\n")]
    return "\n".join(line for i, line in enumerate(lines) if line or not i or lines[i - 1]).strip()


def without_lists(text: Column, marker: str = "Admissible actions:") -> Column:
    """without_list(); only texts with the marker come to Python as they are, the others lose their blank lines here."""
    held = F.coalesce(F.contains(text, F.lit(marker)), F.lit(False))
    lines = F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"(?U)[\s&&[^\n]]+(?=\n|\z)", ""), r"\n{3,}", "\n\n")
    plain = F.regexp_replace(lines, r"(?U)\A\s+|\s+\z", "")
    return F.when(held, _batched(lambda t: without_list(t, marker), "string")(F.when(held, text))).otherwise(plain)


def fill_placeholders(messages: Column, items: dict[str, tuple[str, Column]]) -> Column:
    """messages (array of role, content) with contents as parts of kind and value, and error.

    items: for each placeholder its kind and an array of values. Each placeholder takes the next value of its kind, from message
    to message; the text between is of kind "text". error: what is missing or left over, null if all fits; a placeholder without a value has a null one.
    """
    either = "|".join(re.escape(p) for p in items)

    def cut(m: Column, at: Column) -> Column:
        pieces = F.filter(F.split(F.coalesce(m["content"], F.lit("")), f"(?={either})|(?<={either})"), lambda s: s != "")
        return F.transform(pieces, lambda s: F.struct(at.alias("at"), s.alias("said")))

    def filled(parts: Column) -> Column:
        of = lambda p: F.filter(F.transform(parts, lambda x, i: F.when(x["said"] == p, i)), lambda i: i.isNotNull())
        return let(F.struct(*[of(p).alias(f"p{k}") for k, p in enumerate(items)]), lambda at: told(parts, at))

    def told(parts: Column, at: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            kind, value = F.lit("text"), x["said"]
            for k, (p, (name, values)) in enumerate(items.items()):
                own = F.get(F.coalesce(values, F.array().cast("array<string>")), (F.array_position(at[f"p{k}"], i) - 1).cast("int"))
                kind, value = F.when(x["said"] == p, name).otherwise(kind), F.when(x["said"] == p, own).otherwise(value)
            return F.struct(x["at"].alias("at"), kind.alias("kind"), value.alias("value"))

        errors = []
        for k, (name, values) in enumerate(items.values()):
            over = F.size(at[f"p{k}"]) - F.coalesce(F.size(values), F.lit(0))
            errors.append(F.when(over > 0, F.concat(over.cast("string"), F.lit(f" {name} missing"))).when(over < 0, F.concat((-over).cast("string"), F.lit(f" {name} left over"))))
        error = F.nullif(F.concat_ws("; ", *errors), F.lit(""))
        own = lambda all_parts, k: F.transform(F.filter(all_parts, lambda x: x["at"] == k), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value")))
        done = let(F.transform(parts, one), lambda all_parts: F.transform(messages, lambda m, k: F.struct(m["role"].alias("role"), own(all_parts, k).alias("content"))))
        return F.struct(done.alias("messages"), error.alias("error"))

    return let(F.flatten(F.transform(messages, cut)), filled)
