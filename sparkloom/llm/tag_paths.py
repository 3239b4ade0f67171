"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each with its root-to-leaf tag path. Per path the
text length and the punctuation of its nodes are added up and divided by the number
of nodes. Both series are smoothed over the paths in page order, fused into one
score and held against a threshold from the scores' spread. The nodes of the paths
above it are the content nodes; they settle which element holds the article. From
it all blocks are taken that no menu, header, footer, advert, form or the like
contains, so that short headings and last words stay.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches, table

_TOKEN = re.compile(
    r"""<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(?=[a-zA-Z/])[^<>]*>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORDS = re.compile(r"[a-z]+")

# Fixed values of HTML: element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag ends first, and the elements that it does not look past.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_PARAGRAPH_END = frozenset({"table", "td", "th", "button", "object", "caption"})

#: Elements that never hold article text, wherever they stand.
NEVER = frozenset("nav footer aside form script style template noscript iframe head title button select option textarea fieldset dialog menu svg canvas object audio video map".split())
#: Words in a class, id or role that mark what is not the article.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus
    footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup
    promo promoted promotion related reply replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored
    subscribe subscription teaser toolbar topbar widget widgets complementary contentinfo alert dialog""".split()
)
#: Names that mark the article's own element.
HOLDS = frozenset("article main".split())

_PUNCTUATION = re.compile(r"[.,;:!?…。，！？؟،¿¡]")


class _Element:
    """path: a number for its tag path. never: holds no article text, whatever it is marked as. marks: the words that say so by its class, id or role."""

    __slots__ = ("article", "barred", "depth", "h1", "length", "main", "marks", "never", "parent", "path", "tag")

    def __init__(self, tag: str, parent: _Element | None, path: int, never: bool, marks: frozenset = frozenset()):
        self.tag, self.parent, self.path, self.never, self.marks, self.length = tag, parent, path, never, marks, 0
        self.depth = 0 if parent is None else parent.depth + 1
        self.h1, self.main, self.article = (tag == t or parent is not None and getattr(parent, t) for t in ("h1", "main", "article"))
        self.barred = never or bool(marks) or parent is not None and parent.barred

    def chain(self) -> list[_Element]:
        """The element and all that hold it, the innermost first."""
        out, e = [], self
        while e is not None:
            out.append(e)
            e = e.parent
        return out


def _marks(attributes: str) -> tuple[bool, frozenset]:
    """Whether the element is hidden, and its marks."""
    marks, hidden = set(), bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes))
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            marks |= MARKS.intersection(_WORDS.findall(value.lower()))
        elif name == "aria-hidden" and value.strip("\"'").lower() == "true":
            hidden = True
    return hidden, frozenset(marks)


_RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in RAW}
#: Elements that a mark in their own class does not bar: single blocks of a text, such as a highlighted paragraph.
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre table figure".split())


def _nodes(page: str) -> list[tuple[_Element, int, str]]:
    """Text nodes in page order: their element, the number of their block, and their text.

    Tag paths are numbered, and a tag that is not open is not looked for among the
    open ones, so that deep and unbalanced pages stay cheap.
    """
    here, block, out, at = _Element("", None, 0, False), 0, [], 0
    paths: dict[tuple[int, str], int] = {}
    held: dict[str, int] = {}

    def close(e: _Element) -> _Element:
        """Ends the open elements down to e, and e."""
        now = here
        while True:
            held[now.tag] -= 1
            if now is e:
                return e.parent
            now = now.parent

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            out.append((here, block, html.unescape(text)))
        if not m:
            return out
        at = m.end()
        if not m[1]:
            if m[0].startswith("<![CDATA["):
                out.append((here, block, m[0][9:-3]))
            continue
        tag = m[1].lower()
        if m[0][1] == "/":
            e = here if held.get(tag) else None
            while e is not None and e.tag != tag:
                e = None if tag in INLINE and e.tag and e.tag not in INLINE else e.parent
            if e is not None and e.parent is not None:
                here = close(e)
            if tag not in INLINE:
                block += 1
            continue
        if tag in VOID:
            if tag == "br":
                out.append((here, block, " "))
            elif tag == "hr":
                block += 1
            continue
        if tag not in INLINE:
            block += 1
            ends, until = CLOSES.get(tag, ({"p"}, _PARAGRAPH_END))
            e = here if any(held.get(t) for t in ends) else None
            while e is not None and e.tag not in ends and e.tag not in until:
                e = e.parent
            if e is not None and e.tag in ends:
                here = close(e)
        attributes = m[2] or ""
        hidden, marks = _marks(attributes) if attributes and tag not in ("html", "body") and tag not in HOLDS else (False, frozenset())
        if tag in _BLOCKS:
            marks = frozenset()
        never = hidden or tag in NEVER or tag == "header" and not here.article
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else len(page)
            block += 1
            continue
        if m[0].endswith("/>") and tag not in INLINE:
            continue
        held[tag] = held.get(tag, 0) + 1
        here = _Element(tag, here, paths.setdefault((here.path, tag), len(paths) + 1), never, marks)


def _smooth(values: list[float]) -> list[float]:
    """Gaussian of radius 1 over neighbours, the ends weighted anew."""
    side = math.exp(-0.5 * 4)
    out = []
    for i, v in enumerate(values):
        total, weight = v, 1.0
        for j in (i - 1, i + 1):
            if 0 <= j < len(values):
                total += side * values[j]
                weight += side
        out.append(total / weight)
    return out


def path_scores(nodes: list[tuple[_Element, int, str]]) -> dict[tuple[int, bool], float]:
    """Fused score of each tag path. Paths below a barred element are kept apart."""
    sums: dict[tuple[int, bool], list[float]] = {}
    for element, _, text in nodes:
        length = len("".join(text.split()))
        if length:
            s = sums.setdefault((element.path, element.barred), [0, 0, 0])
            s[0] += 1
            s[1] += length
            s[2] += len(_PUNCTUATION.findall(text))
    lengths = _smooth([s[1] / s[0] for s in sums.values()])
    marks = _smooth([s[2] / s[0] for s in sums.values()])
    return {path: math.sqrt(a * (1 + b)) for path, a, b in zip(sums, lengths, marks, strict=True)}


def _length(text: str) -> int:
    return len("".join(text.split()))


def _passing(nodes: list[tuple[_Element, int, str]]) -> set[int]:
    """The numbers of the paths that are not barred and reach the threshold."""
    scores = path_scores(nodes)
    free = {path: s for (path, barred), s in scores.items() if not barred}
    if not free:
        return set()
    mean = sum(scores.values()) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores))
    threshold = min(spread, 0.5 * max(free.values())) if len(free) > 1 else 0.0
    return {path for path, s in free.items() if s >= threshold}


def _bar(nodes: list[tuple[_Element, int, str]]) -> None:
    """Settles which elements are barred. A mark on what holds most of the page's content by path scores says nothing: that is a wrapper.

    Most is 0.8, or over a half with the page's h1 or main element. This holds for an
    element, then for a word on all elements that still have it as a mark (an article in pieces).
    """
    elements = {id(e): e for element, _, _ in nodes for e in reversed(element.chain())}
    if not any(e.marks for e in elements.values()):
        return

    def settle() -> None:
        for e in elements.values():  # parents come first
            e.barred = e.never or bool(e.marks) or e.parent is not None and e.parent.barred

    kept = {k: e.marks for k, e in elements.items()}
    for e in elements.values():
        e.marks = frozenset()
    settle()
    passing = _passing(nodes)
    content = [(element.chain(), _length(text)) for element, _, text in nodes if not element.barred and element.path in passing]
    total = sum(n for _, n in content)
    heads = [element.chain() for element, _, text in nodes if not element.barred and text.strip() and (element.h1 or element.main)]

    def most(of) -> set:
        """of: what a chain of elements counts for."""
        held: dict = {}
        for chain, n in content:
            for k in of(chain):
                held[k] = held.get(k, 0) + n
        headed = {k for chain in heads for k in of(chain)}
        return {k for k, n in held.items() if n > 0 and (n >= 0.8 * total or n > 0.5 * total and k in headed)}

    for k in most(lambda chain: {id(e) for e in chain if kept[id(e)]}):
        kept[k] = frozenset()
    words = most(lambda chain: {w for e in chain for w in kept[id(e)]})
    for k, e in elements.items():
        e.marks = kept[k] - words
    settle()


def _menus(blocks: dict[int, list[tuple[_Element, str]]], passing: set[int]) -> set[int]:
    """Blocks of link lists: runs with three links or more, no text outside of links, and no path that reaches the threshold."""
    out, run, links = set(), [], set()
    for block, nodes in [*blocks.items(), (-1, [])]:
        held = [next((id(e) for e in element.chain() if e.tag == "a"), None) for element, text in nodes if text.strip()]
        if not held and block >= 0:
            continue
        if held and None not in held and not any(element.path in passing for element, _ in nodes):
            run.append(block)
            links.update(held)
            continue
        if len(links) >= 3:
            out.update(run)
        run, links = [], set()
    return out


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, joined by one space.

    Every block with a path that reaches the threshold is taken. The article's element
    adds what is too short for that, but for link lists, and an h1 before it.
    """
    nodes = _nodes(page or "")
    _bar(nodes)
    passing = _passing(nodes)
    if not passing:
        return ""
    total, holders = 0, {}
    for element, _, text in nodes:
        if not element.barred and element.path in passing:
            length = _length(text)
            total += length
            for e in element.chain():
                e.length += length
            holders[id(element)] = element
    # The deepest element with most of the content.
    region = None
    for element in holders.values():
        e = element
        while e.parent is not None and e.length < 0.8 * total:
            e = e.parent
        depth = e.depth
        if region is None or depth > region[0]:
            region = (depth, e)
    home = region[1]
    for e in home.chain():
        if e.tag in HOLDS:
            home = e
            if e.tag == "article":
                break
    while home.tag in INLINE or home.tag in ("p", "h1", "h2", "h3", "li", "blockquote", "pre"):
        home = home.parent

    blocks: dict[int, list[tuple[_Element, str]]] = {}
    for element, block, text in nodes:
        if not element.barred:
            blocks.setdefault(block, []).append((element, text))
    known = {id(element): any(e is home for e in element.chain()) for element, _, _ in nodes}
    inside = {block for block, held in blocks.items() if any(known[id(element)] for element, _ in held)}
    first = min(inside, default=0)
    taken = inside - _menus({b: blocks[b] for b in blocks if b in inside}, passing)
    for block, held in blocks.items():
        if any(element.path in passing and text.strip() or block < first and element.h1 for element, text in held):
            taken.add(block)
    out = [" ".join("".join(text for _, text in blocks[block]).split()) for block in sorted(taken)]
    return " ".join(b for b in out if b)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the id and url columns, text string, n_chars long (code points).

    A null or empty page, and one without any article text, gives an empty text.
    Null ids and urls are kept, repeated pages are extracted each, other columns are
    not read whatever their names, paths of equal score are treated alike, very long and deep pages are read whole,
    an empty table gives no rows. Each row depends on its page alone:
    there is no shuffle. Unclosed and unbalanced tags are tolerated.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    return rows.mapInArrow(run, f"_id {kinds['_id']}, _url {kinds['_url']}, text string, n_chars long").withColumnsRenamed({"_id": id_col, "_url": url_col})


def op4_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
