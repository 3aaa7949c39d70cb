import corpus_pipeline
from tests.llm.test_dealt import SCHEMA, corpus
from tulya.llm import entry
from tulya.llm.common import written


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rows = [r[:5] + ("x", "y") for r in corpus(60) if r[0] is not None]
    docs = spark.createDataFrame([(r[0], r[1], r[2] or "xx", r[3], r[4], *r[5:]) for r in rows], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = written(stage(spark, now, str(tmp_path)), "test")
        after = {r.doc_id for r in now.select("doc_id").collect()}
        assert after <= before, name
        assert now.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "decontaminate":
            assert before - after <= {5, *range(60, 100)}
    assert "copy" in now.columns and after


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(entry.oracle_sql()) <= set(names)
