"""Text functions on cases that the tables do not hold."""

from pyspark.sql import functions as F

from sparkloom.functions import text as X


def one(spark, **columns):
    """The first row of the expressions."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def words(text):
    return F.split(F.lit(text), " ")


def test_repeated_chunk(spark):
    r = one(
        spark, four=X.has_repeated_chunk(words("go north go north go north go north")), three=X.has_repeated_chunk(words("go north go north go north end")),
        short=X.has_repeated_chunk(words("a b a b a b a b a b")), inside=X.has_repeated_chunk(words("x " + "take the lamp " * 4 + "y")), empty=X.has_repeated_chunk(F.array().cast("array<string>")),
        run=X.equal_run(words("a b a b a"), 2),
    )
    assert (r.four, r.three, r.short, r.inside, r.empty, r.run) == (True, False, False, True, False, 3)


def test_tag_sequence(spark):
    start = "<|im_start|>assistant "
    good = start + "<think>a</think><search>b</search> <information>c</information>\n<think>d</think><answer>e</answer>"
    r = one(
        spark, good=X.valid_tag_sequence(F.lit(good)), no_marker=X.valid_tag_sequence(F.lit(good[len(start):])), stray=X.valid_tag_sequence(F.lit(good + " x")),
        open=X.valid_tag_sequence(F.lit(good.replace("</answer>", ""))), short=X.valid_tag_sequence(F.lit(start + "<think>a</think><answer>b</answer>")), long=X.valid_tag_sequence(F.lit(good.replace("c<", "c" * 200_000 + "<"))),
    )
    assert (r.good, r.no_marker, r.stray, r.open, r.short, r.long) == (True, False, False, False, True, True)


def test_composite_score_without_answer(spark):
    """A single answer is not told from the prompt's, so only structure and retrieval count."""
    golds = F.array(F.lit("Paris"))
    text = "<|im_start|>assistant <think>a</think><search>b</search><information>In the paris of old</information><think>d</think><answer>Paris</answer>"
    r = one(spark, found=X.composite_score(F.lit(text), golds), none=X.composite_score(F.lit("nothing"), golds))
    assert (round(r.found, 6), r.none) == (0.3, 0.0)


def test_enclosing_lines(spark):
    doc = "first line\nsecond one here\nthird"
    r = one(spark, lines=X.enclosing_lines(F.lit(doc), F.array(*[F.lit(s) for s in ("one", "missing", "second", "here third", "first")])))
    assert r.lines == ["second one here", "second one here\nthird", "first line"]


def test_detail_bits(spark):
    attributes = F.create_map(*[F.lit(x) for x in ("title", " Go  home ", "value", "7", "type", "submit", "placeholder", "GO home", "option_selected", "true", "aria_label", "a b c d e f g h i j k l")])
    assert one(spark, b=X.detail_bits(attributes, F.lit("go home"))).b == ['value="7"', 'aria_label="a b c d e f g h i j"', "[selected]"]


def test_step_blocks_without_a_header(spark):
    r = one(spark, none=X.step_blocks(F.lit("no header")), two=X.step_blocks(F.lit("ab\n\n[Step 4]\nx\n\n[Step 9]\n")))
    assert r.none == [] and [tuple(s) for s in r.two] == [(4, 2, 14), (9, 14, 25)]


def test_tool_calls(spark):
    bad = '<tool_call>{"name": "code_interpreter", "arguments": {broken}</tool_call><code> 1 + 1 </code>'
    r = one(
        spark, bad=X.tool_action(F.lit(bad)), other=X.tool_action(F.lit('<tool_call>{"name": "search", "arguments": {"code": "x"}}</tool_call>')), none=X.last_tool_call(F.lit("plain")),
        unnamed=X.last_tool_call(F.lit('<tool_call>{"arguments": {}}</tool_call>')), bare=X.last_tool_call(F.lit('<tool_call>{"name": "f"}</tool_call>')),
    )
    assert tuple(r.bad) == ("code", "1 + 1") and tuple(r.other) == (None, "")
    assert r.none is None and r.unnamed is None and tuple(r.bare) == ("f", "{}")


def test_multiple_choice(spark):
    cases = {
        "So the answer is (x) B. Not C": "C", "Option: b, though C is tempting": "B", "I say D is the correct one": "D", "final answer Z, or F": "F", "the answer is A</think> Perhaps G": "G", "no letter": None, "": None,
    }
    got = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", X.multiple_choice(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == list(cases.values())


def test_audit_of_repeats(spark):
    line = "Take the red lamp."
    cases = {
        "\n".join([line, "x", line, "y", line]): "repeated line", "\n".join([line, "x", line, "y", "z", "w", line]): "", "go north go north go north go north": "repeated chunk", "ha " * 8: "repeated token",
        "aaaaaaaa " + "no " * 9: "long character run", "": "",
    }
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, t string").select("i", X.audit(F.col("t")).alias("a")).orderBy("i").collect()
    assert [r.a.reasons for r in got] == [*cases.values(), ""]
