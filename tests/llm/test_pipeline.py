import corpus_pipeline
from sparkloom.llm.common import stash
from tests.llm.fixtures import none, odd, prose


def test_stages_keep_columns_and_take_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, prose(900, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd(spark), none(spark)):
        columns, before = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stash(stage(spark, docs, str(tmp_path)), "test")
            after = docs.count()
            assert after <= before, name
            before = after
            assert docs.columns == (columns if name != "tokenize" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def test_decisions_take_effect(spark, tmp_path):
    leak = prose(900, 40)
    rows = [(i, prose(i, 150)) for i in range(150)]
    rows += [(500, rows[7][1]), (501, "short"), (502, prose(700, 200) + " " + leak.replace("\n", " ")), (503, " ".join(f"{w}###" for w in prose(701, 200).split()))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {501, 502, 503}.isdisjoint(got)
    assert set(range(150)) <= got
