import re

from pyspark.sql import functions as F

from sparkloom.functions import compaction


def around(page, refs, radius=5):
    lines = page.splitlines()
    at = {m[1]: i for i, line in enumerate(lines) if (m := re.search(r"\[ref=(e\d+)\]", line))}
    keep = sorted({i for r in refs if r in at for i in range(max(0, at[r] - radius), min(len(lines), at[r] + radius + 1))})
    if not keep or len(keep) == len(lines):
        return page
    out = []
    for before, i in zip([None, *keep], keep):
        if before is not None and i - before > 1:
            out.append(f"- ... omitted {i - before - 1} unrelated elements ...")
        out.append(lines[i])
    return "\n".join(out)


def test_lines_around_references(spark):
    page = "\n".join(f"- link [ref=e{i % 30}]" if i % 3 == 0 else f"- text {i}" for i in range(90))
    cases = [(page, ["e3"]), (page, ["e0", "e27", "e99"]), (page, []), (page, ["e99"]), ("", ["e1"]), ("- a [ref=e1]\n- b", ["e1"]), (page + "\n", ["e6", "e6"])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, page string, refs array<string>")
    got = [r["t"] for r in df.select("i", compaction.lines_around(F.col("page"), F.col("refs")).alias("t")).orderBy("i").collect()]
    assert got == [around(*c) for c in cases]


def test_only_long_trajectories_and_pages_between_marks_are_cut(spark):
    page = "\n".join(f"- link [ref=e{i}]" for i in range(40))
    first = f"\n\n[Step 0]\nCurrent page snapshot (source=a\nb):\n{page}\n\nPrevious actions:\nnone <action>CLICK e20</action> <ACTION>{{\"op\": \"TYPE\", \"ref\": \"e39\"}}</ACTION>"
    second = f"\n\n[Step 1]\nCurrent page snapshot (source=x):\n{page}\n\nno marker behind"
    third = f"\n\n[Step 12]\nCurrent page snapshot (source=x):\n{page}\n\nPrevious actions:\n<action>go</action>"
    text = "Task\n[Step 3]\n" + first + second + third
    want = "Task\n[Step 3]\n" + first.replace(page, around(page, ["e20", "e39"])) + second + third.replace(page, around(page, ["e2"]))
    df = spark.createDataFrame([(text,), ("no steps",), (None,)], "t string")
    expected = F.create_map(F.lit(12), F.array(F.lit("e2")))
    cut = lambda n: [r[0] for r in df.select(compaction.compact_long(F.col("t"), F.lit(n), expected, limit=10)).collect()]
    assert cut(11) == [want, "no steps", None] and cut(10) == [text, "no steps", None]
