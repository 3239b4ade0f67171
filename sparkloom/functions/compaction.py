"""Long trajectories made shorter: of each step's page only the lines around the elements that matter stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.binding import let

# Lines kept on each side, tokens beyond which a trajectory is cut, and the marks around a page's lines.
RADIUS, LIMIT = 5, 25600
_STEP = r"\n\n\[Step (\d+)\]\n"
_PAGE, _AFTER = r"(?s)\A(.*?Current page snapshot \(source=.*?\):\n)", "\n\nPrevious actions:\n"
_REF = r"\[ref=(e\d+)\]"


def lines_around(snapshot: Column, refs: Column, radius: int = RADIUS) -> Column:
    """The lines up to ``radius`` from the last line of each reference, with marks where lines are left out between. Without a line for any reference the text stays."""

    def hits(x: Column) -> Column:
        # Of several lines of one reference the last one counts.
        last = F.transform(x["refs"], lambda r: F.array_max(F.filter(F.transform(x["of"], lambda o, i: F.when(o == r, i)), lambda i: i.isNotNull())))
        return let(F.array_distinct(F.filter(last, lambda i: i.isNotNull())), lambda at: kept(x, at))

    def kept(x: Column, at: Column) -> Column:
        near = F.filter(F.sequence(F.lit(0), F.size(x["lines"]) - 1), lambda i: F.exists(at, lambda a: F.abs(a - i) <= radius))
        return let(near, lambda k: F.when((F.size(at) == 0) | (F.size(k) == F.size(x["lines"])), x["whole"]).otherwise(joined(x, k)))

    def joined(x: Column, k: Column) -> Column:
        def line(i: Column, j: Column) -> Column:
            left_out = i - F.get(k, j - 1) - 1
            mark = F.concat(F.lit("- ... omitted "), left_out.cast("string"), F.lit(" unrelated elements ...\n"))
            return F.concat(F.when((j > 0) & (left_out > 0), mark).otherwise(""), F.get(x["lines"], i))

        return F.array_join(F.transform(k, line), "\n")

    # A line end at the end of the text opens no line.
    lines = F.split(F.regexp_replace(snapshot, r"\n\z", ""), "\n")
    of = F.transform(lines, lambda s: F.nullif(F.regexp_extract(s, _REF, 1), F.lit("")))
    return F.when((snapshot == "") | (F.size(refs) == 0), snapshot).otherwise(let(F.struct(lines.alias("lines"), of.alias("of"), F.array_distinct(refs).alias("refs"), snapshot.alias("whole")), hits))


def action_refs(block: Column) -> Column:
    """The references of all actions in tags."""
    said = F.regexp_extract_all(block, F.lit(r"(?is)<action>(.*?)</action>"), F.lit(1))
    return F.filter(F.transform(said, lambda a: X.parse_model_action(a)["ref"]), lambda r: r != "")


def compacted(trajectory: Column, expected: Column, radius: int = RADIUS) -> Column:
    """The trajectory with each step's page cut to the lines around what the step's actions name and what ``expected`` (a map of step to references) lists."""

    def block(b: Column) -> Column:
        head = F.regexp_extract(b, _PAGE, 1)
        return let(F.struct(head.alias("head"), F.substring(b, F.length(head) + 1, F.length(b)).alias("rest"), b.alias("all")), cut)

    def cut(x: Column) -> Column:
        page = F.substring_index(x["rest"], _AFTER, 1)
        step = F.regexp_extract(x["all"], rf"\A{_STEP}", 1).try_cast("int")
        wanted = F.coalesce(F.try_element_at(expected, step), F.array().cast("array<string>"))
        refs = F.array_union(action_refs(x["all"]), wanted)
        whole = (x["head"] == "") | ~F.contains(x["rest"], F.lit(_AFTER))
        return F.when(whole, x["all"]).otherwise(let(page, lambda p: F.concat(x["head"], lines_around(p, refs, radius), F.substring(x["rest"], F.length(p) + 1, F.length(x["rest"])))))

    return F.array_join(F.transform(F.split(trajectory, rf"(?={_STEP})"), lambda b, i: F.when(b.rlike(rf"\A{_STEP}"), block(b)).otherwise(b)), "")


def compact_long(trajectory: Column, tokens: Column, expected: Column, limit: int = LIMIT, radius: int = RADIUS) -> Column:
    """compacted() for trajectories of more than ``limit`` tokens; others stay."""
    return F.when(tokens > limit, compacted(trajectory, expected, radius)).otherwise(trajectory)
