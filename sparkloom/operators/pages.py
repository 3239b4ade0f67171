"""Web pages as rows of elements: one Arrow pass parses, the rest are column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_KIND = "depth int, ord int, tag string, attrs map<string, string>, text string"
# Roles that can be acted on, the roles of tags and of input types, and words that are no name.
INTERACTIVE = "button checkbox combobox link menuitem option radio searchbox slider spinbutton switch tab textbox".split()
_ROLE_OF_TAG = {"a": "link", "button": "button", "option": "option", "select": "combobox", "summary": "button", "textarea": "textbox"}
_ROLE_OF_INPUT = {
    "button": "button", "checkbox": "checkbox", "email": "textbox", "image": "button", "number": "spinbutton", "password": "textbox", "radio": "radio", "range": "slider",
    "reset": "button", "search": "searchbox", "submit": "button", "tel": "textbox", "text": "textbox", "url": "textbox",
}
_NAMES = ("aria_label", "aria_description", "label", "title", "placeholder", "name", "text_value", "input_value", "value")
_NO_NAMES = ("true", "false", "null", "undefined")


class _Flat(HTMLParser):
    """Elements in document order with their own text; close tags without a match are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.rows.append({"depth": len(self.open), "ord": len(self.rows), "tag": tag, "attrs": {k: v or "" for k, v in attrs}, "text": ""})
        if tag not in _VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and self.open:
            # An element's own text; elements that can be acted on have the text of all below them.
            for i in self.open:
                row = self.rows[i]
                if i == self.open[-1] or row["tag"] in _ROLE_OF_TAG or "role" in row["attrs"] or "onclick" in row["attrs"]:
                    row["text"] = f"{row['text']} {text}".strip()


#: Pages whose elements a Python worker holds at once: an Arrow batch has thousands of pages.
PAGES_AT_ONCE = 64


def parsed(batches: Iterator[pd.DataFrame], key: str, html: str) -> Iterator[pd.DataFrame]:
    """key, e (the elements) of each page, a few pages at a time."""
    for batch in batches:
        for start in range(0, len(batch), PAGES_AT_ONCE):
            some, out = batch.iloc[start : start + PAGES_AT_ONCE], []
            for page in some[html]:
                flat = _Flat()
                flat.feed(page or "")
                out.append(flat.rows)
            yield pd.DataFrame({key: some[key].array, "e": out})


def elements(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, depth, ord, tag, attrs, text: a row for each element."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return parsed(batches, key, html)

    return df.select(key, html).mapInPandas(run, f"{key} {kind}, e array<struct<{_KIND.replace(' int', ':int').replace(' string', ':string', 1).replace(' map<', ':map<').replace('text string', 'text:string')}>>").select(key, F.explode("e").alias("e")).select(key, "e.*")


def role(tag: Column, attrs: Column) -> Column:
    """The role in which an element can be acted on: its explicit one, else by input type, tag, or what makes it clickable; empty if there is none."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    told = lambda k: F.when(plain(F.element_at(attrs, k)).isin(INTERACTIVE), plain(F.element_at(attrs, k)))
    kind = F.coalesce(F.nullif(plain(F.element_at(attrs, "type")), F.lit("")), F.lit("text"))
    by_input = F.when(kind == "hidden", "").otherwise(F.coalesce(*[F.when(kind == k, v) for k, v in _ROLE_OF_INPUT.items()], F.lit("textbox")))
    by_tag = F.coalesce(*[F.when(tag == k, v) for k, v in _ROLE_OF_TAG.items()])
    clickable = (plain(F.element_at(attrs, "is_clickable")) == "true") | F.map_contains_key(attrs, "onclick") | F.map_contains_key(attrs, "tabindex")
    return F.coalesce(told("role"), F.when(tag == "input", by_input), by_tag, told("aria_role"), F.when(clickable, "button"), F.lit(""))


def primary_name(attrs: Column, text: Column, words: int = 14) -> Column:
    """The first attribute that is a name, else the text; so many words at most. Empty if there is none."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    usable = lambda c: F.when((squeezed(c) != "") & ~F.lower(squeezed(c)).isin(*_NO_NAMES), squeezed(c))
    chosen = F.coalesce(*[usable(F.element_at(attrs, k)) for k in _NAMES], usable(text), F.lit(""))
    return F.array_join(F.slice(F.split(chosen, " "), 1, words), " ")


def snapshot(df: DataFrame, key: str, html: str, depth: int = 20) -> DataFrame:
    """Numbered references to the elements of a page that can be acted on: key, ref, role, name, nth (of the same role and name). depth: how deep the walk goes, part of this operator's definition."""
    e = elements(df, key, html).where(F.col("depth") <= depth).select(key, "ord", role(F.col("tag"), F.col("attrs")).alias("role"), primary_name(F.col("attrs"), F.col("text")).alias("name")).where("role <> ''")
    nth = F.row_number().over(Window.partitionBy(key, "role", "name").orderBy("ord")) - 1
    ref = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    return e.select(key, F.concat(F.lit("e"), ref.cast("string")).alias("ref"), "role", "name", nth.alias("nth"))


class _Owned(_Flat):
    """Elements with the words that stand in each of them, not below."""

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        self.rows[-1]["own"] = []

    def handle_data(self, data):
        if self.open:
            self.rows[self.open[-1]]["own"] += data.split()


def outline_text(html: str | None, nodes: int = 64, words: int = 12, chars: int = 2000) -> str:
    """The first elements of a page in document order, each as its tag, id, role and first words (its own before those below), in one line of at most ``chars`` characters."""
    page = _Owned()
    page.feed(html or "")
    rows = page.rows
    first = next((i for i, r in enumerate(rows) if r["depth"] == 0 and r["tag"] == "html"), 0)
    if not rows:
        return "<html>"
    out = []
    for at in range(first, len(rows)):
        row = rows[at]
        if len(out) == nodes or at > first and row["depth"] <= rows[first]["depth"]:
            break
        said, below = list(row["own"]), at + 1
        while len(said) < words and below < len(rows) and rows[below]["depth"] > row["depth"]:
            said += rows[below]["own"]
            below += 1
        marks = [f"{name}={value}" for name, value in (("id", " ".join(row["attrs"].get("backend_node_id", "").split())), ("role", " ".join(row["attrs"].get("role", "").lower().split()))) if value]
        out.append(" ".join([" ".join(["<" + row["tag"], *marks]) + ">", *said[:words]]))
    return " ".join(out)[:chars]


def outline(html: Column) -> Column:
    """outline_text() of each page, in Arrow batches."""
    return F.pandas_udf(_outlines, "string")(html)


def _outlines(pages: pd.Series) -> pd.Series:
    return pd.Series([outline_text(p) for p in pages])
