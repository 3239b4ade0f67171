import pytest
from pyspark.sql import functions as F

from sparkloom.functions import formulas
from sparkloom.operators import rewards

SAME = [
    (r"\frac{1}{2}", "0.5"), (r"\dfrac{1}{2}", "1/2"), (r"\frac12", "1/2"), (r"\frac1{72}", r"\frac{1}{72}"), ("x=5", "5"), (r"5\text{ cm}", "5"), (r"\text{yes}", "Yes"), (r"\sqrt{8}", r"2\sqrt{2}"), (r"\sqrt3", r"\sqrt{3}"),
    (r"2\sqrt{3}", r"\sqrt{12}"), ("1,234", "1234"), ("(1,2)", "(1, 2)"), (r"[0,\infty)", r"[0, \infty)"), (r"\left(1, 2\right)", "(1,2)"), (r"3\pi", r"\pi*3"), ("x+1", "1+x"), ("(x+1)^2", "x^2+2x+1"), (r"50\%", "50"), ("10 degrees", "10"),
    (r"30^\circ", "30"), ("7 3/4", "31/4 + 0"), (r"\frac{\sqrt{2}}{2}", r"1/\sqrt{2}"), ("2 million", "2*10^6"), ("1/(2+sqrt(3))", "2-sqrt(3)"), ("x*y", "y*x"), ("- 5", "-5"), ("5.0", "5"), ("1 and 2", "1 or 2"), ("", ""), (".5", r"\frac{1}{2}"), (r"(\frac{1}{2}, 3)", "(0.5,3)"),
]
OTHER = [("2/4", "1/2"), ("6/2", "3"), ("(1,2)", "[1,2]"), ("(1,2)", "(1,2,3)"), ("x", "y"), ("", "5"), ("3.0001", "3"), ("abc", "abd"), ("2^10", "1024"), ("1/0", "1"), (None, "1"), ("1", None), ("x+y+z", "z+y+x"), ("(", "1"), ("sqrt(", "x"), ("((((x+1)^9)^9)^9)^9", "x")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_formulas(a, b):
    assert formulas.same_formula(a, b) and formulas.same_formula(b, a)


@pytest.mark.parametrize("a, b", OTHER)
def test_other_formulas(a, b):
    assert not formulas.same_formula(a, b)


@pytest.mark.parametrize("a, b", [("x = $42$", "42"), ("1,000 meters", "1000"), (r"\text{12}", "12"), (r"\boxed{7}", "7"), ("a 5", "5")])
def test_final_forms(a, b):
    assert formulas.final_form(a) == b


def graded(spark, rows, **more):
    kind = "id int, rm_type string, response string, label string, choices array<string>, valid_letters array<string>, correct_letter string, correct_answer string, answer_text string"
    df = spark.createDataFrame([(i, *r, *[None] * (8 - len(r))) for i, r in enumerate(rows)], kind)
    return [r["reward"] for r in rewards.rewards(df, **more).orderBy("id").collect()]


def test_each_kind(spark):
    rows = [
        ("deepscaler", r"<think>\boxed{1}</think> so \boxed{\frac{1}{2}}", r"\boxed{0.5}"), ("deepscaler", r"\boxed{1}", "1"), ("deepscaler", r"a###Response\boxed{2}###Response\boxed{1}", "2"), ("deepscaler", r"</think>\boxed{1}", ""),
        ("dapo", "x\nAnswer: $42$", "42.0"), ("dapo", "Answer: 41", "42"), ("boxed_dapo", r"\boxed{Answer: 7}", "7"),
        ("math", r"\boxed{2\sqrt{2}}", r"\sqrt{8}"), ("math", "none", "1"), ("math", None, "1"),
        ("f1", "the red fox", "a red dog"), ("boxed_f1", r"no \boxed{red dog}", "red dog"), ("f1", "yes", "yes it is"), ("f1", None, "x"),
        ("gpqa", "<think>answer is A</think>The answer is B", "b"), ("gpqa", "I say C", "B"), ("gpqa", "it is the Red Fox!", "red fox"), ("gpqa", "B", "blue dog", ["red fox", "Blue  dog"]), ("gpqa", "option D", "Z", None, ["z", "d"]),
        ("gpqa", "the answer: Q, so B", "x", ["a", "b"], None, "b"), ("gpqa", "nothing of use", "x", None, None, None, "of USE"), ("gpqa", None, "A"), ("gpqa", "", "A"), ("gpqa", "well, the second choice text", None, ["one", "second choice text"], None, "B"),
    ]
    want = [1, 0, 1, 0, 1, -1, 1, 1, 0, 0, 0.5, 1, 0, 0, 1, 0, 1, 1, 0, 1, 1, 0, 0, 1]
    assert graded(spark, rows) == pytest.approx(want)


def test_defaults_errors_and_hooks(spark):
    assert graded(spark, [(None, r"\boxed{1}", "1"), ("", r"\boxed{2}", "1"), ("f1", "x", "x")], default=" math ") == [1, 0, 1]
    for kind, said in (("other", "no grader for other"), ("boxed_ifeval", "no grader for ifeval"), ("", "no kind of reward")):
        with pytest.raises(Exception, match=said):
            graded(spark, [(kind, "x", "x")])
    assert graded(spark, [("length", "abc", "x")], graders={"length": lambda df, r, label, seed: F.length(r).cast("double")}) == [3]
    assert graded(spark, [("other", "abc", "x")], custom=lambda df: F.length("label")) == [1]
    drawn = graded(spark, [("random", f"r{i}", "x") for i in range(200)])
    assert set(drawn) == {0, 1} and 60 < sum(drawn) < 140 and drawn == graded(spark, [("random", f"r{i}", "x") for i in range(200)])
