import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import prompts
from sparkloom.plans import prompt_queries
from sparkloom.plans.registry import ORACLE_SQL
from sparkloom.sources import vectors


@pytest.mark.parametrize(
    "text, want",
    [
        (None, ""), ("", ""), ("plain\n\n\n\ntext  \nend ", "plain\n\ntext\nend"), ("a\nAdmissible actions: [x, [y], z]\n\n\nb", "a\n\nb"), ("a\nAdmissible actions: none\nb", "a\n\nb"), ("a\nAdmissible actions: none", "a"),
        ("a\nAdmissible actions: [open\nb", "a\nAdmissible actions: [open\nb"), ("see Admissible actions: [x]\t\r\nb Admissible actions: [y] c", "c"), ("Admissible actions: []", ""), ("a ] b\nAdmissible actions:\n[\n[]\n]", "a ] b"),
    ],
)
def test_lists_are_taken_out(spark, text, want):
    assert prompts.without_list(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(prompts.without_lists(F.col("t"))).first()[0] == want


def test_placeholders_across_messages(spark):
    kind = "id int, m array<struct<role: string, content: string>>, images array<string>, films array<string>"
    rows = [
        (1, [("user", "see <image> and <image><video>"), ("assistant", "no"), ("user", "<image>")], ["a", "b", "c"], ["v"]),
        (2, [("user", "<image><image>")], ["a"], None), (3, [("user", "none"), ("user", "")], ["a", "b"], ["v"]), (4, [("user", None)], None, None), (5, [], [], []),
    ]
    df = spark.createDataFrame(rows, kind).withColumn("f", prompts.fill_placeholders(F.col("m"), {"<image>": ("image", F.col("images")), "<video>": ("video", F.col("films"))}))
    got = {r["id"]: ([[tuple(p) for p in m["content"]] for m in r["f"]["messages"]], r["f"]["error"]) for r in df.collect()}
    assert got[1] == ([[("text", "see "), ("image", "a"), ("text", " and "), ("image", "b"), ("video", "v")], [("text", "no")], [("image", "c")]], None)
    assert got[2] == ([[("image", "a"), ("image", None)]], "1 image missing")
    assert got[3] == ([[("text", "none")], []], "2 image left over; 1 video left over")
    assert got[4] == ([[]], None) and got[5] == ([], None)


def test_cache_grows_by_what_is_new(spark, tmp_path):
    path, kind = str(tmp_path / "cache"), "k string, t string, vector int"
    first = spark.createDataFrame([("a", "one two", 1), (" a ", "one two", 1), ("b", "three", 1), (None, None, 1), ("b", "three", 2)], kind)
    assert [vectors.build(first, path, "k", "t") for _ in range(2)] == [3, 0]
    changed = spark.createDataFrame([("a", "one two", 1), ("b", "four", 1)], kind)
    with pytest.raises(Exception, match="no vector for b"):
        vectors.match(changed.drop("vector"), path, "k", "t").collect()
    assert vectors.build(changed, path, "k", "t") == 1
    got = {(r["k"], r["t"]): r["vector"] for r in vectors.match(first.unionByName(changed).drop("vector"), path, "k", "t").collect()}
    for (_, t), v in got.items():
        np.testing.assert_allclose(v, vectors.hashed_words(t))
    assert abs(np.linalg.norm(got["b", "four"]) - 1) < 1e-6 and not any(got[None, None])
    with pytest.raises(ValueError):
        vectors.match(first, str(tmp_path / "none"), "k", "t")


def test_every_text_with_a_word_has_a_vector_of_length_one(spark, tmp_path):
    """Words that cancel each other, white space of rarer kinds, texts of nothing: as the SQL of the query has it."""
    places = {}
    for i in range(1000):
        v = vectors.hashed_words(f"w{i}")
        at = int(np.flatnonzero(v)[0])
        if (at, -v[at]) in places:
            pair = f"w{i} {places[at, -v[at]]}"
            break
        places[at, v[at]] = f"w{i}"
    texts = [pair, f"{pair}\n{pair}", "\u00a0", "\x0b", " \t\n", "", None, "word"]
    rows = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["norm"] for r in prompt_queries.s19_cached_vectors(spark, str(tmp_path)).collect()}
    sql = ORACLE_SQL["s19_cached_vectors"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {i: float(norm) for i, _, norm in duckdb.execute(sql).fetchall()}
    assert got == want == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1}
