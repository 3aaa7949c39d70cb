"""A run over documents: what the preflight blocks, and what the record of checks says of a wrong amount."""

from pyspark.sql import functions as F

from tulya.operators import terms
from tulya.plans import run
from tulya.sources import scratch

_TEXT = "રકમ રૂ. 45,000 તા. 12/05/1996 ના રોજ ચૂકવી.\nબીજી રકમ રૂ. 700 છે."
_HINDI = "यह एक दस्तावेज़ है जिसमें केवल देवनागरी लिपि है और कुछ नहीं।"


def test_a_run(spark):
    rows = [(1, 1, "text", _TEXT, 0.9), (2, 1, "text", _TEXT, 0.5), (3, 1, "text", _HINDI, None), (4, 1, "text", _TEXT, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, kind string, text string, confidence double")

    def translate(segments):
        number = F.regexp_extract("source", "([0-9,]+)", 1)
        shown = F.when((F.col("doc_id") == 2) & (number == "700"), F.lit("900")).otherwise(number)
        dated = F.when(F.contains("source", F.lit("1996")), F.lit(" on 12/05/1996")).otherwise(F.lit(""))
        return segments.withColumn("target", F.concat(F.lit("The amount (sum) paid is Rs. "), shown, dated, F.lit(" and no more.")))

    glossary = terms.glossary(spark, [("રકમ", "amount (sum)", "general", False, [], [])])
    locks = spark.createDataFrame([(4, 0, "The amount (sum) of Rs. 45,000 was paid on 12/05/1996, as a reviewer has it.")], "doc_id long, seg_idx int, locked_target string")
    out = run.run(pages, glossary, translate=translate, locks=locks, keep=scratch.kept)
    told = {r.doc_id: r for r in out["documents"].collect()}
    assert not told[3].ok and told[1].ok and {w.code for w in told[3].warnings} >= {"wrong_script"}
    assert {r.doc_id for r in out["scores"].collect()} == {1, 2, 4}  # what is blocked goes no further
    checks = {(r.doc_id, r.check): (r["count"], r.passed) for r in out["checks"].collect()}
    data = "Data extraction and comparison"
    assert checks[1, data] == checks[4, data] and checks[1, data][1] and not checks[2, data][1]
    assert len(checks) == 3 * 7 and all(checks[d, "Segment coverage"][1] and checks[d, "Sentence-level alignment"][1] for d in (1, 2, 4))
    found = {(r.doc_id, r.check) for r in out["findings"].filter("severity = 'critical'").collect()}
    assert (2, "datum.currency_changed") in found and not [d for d, _ in found if d != 2]
    flags = {r.doc_id: [i.rows for i in r["items"] if i.t == "table"][0] for r in out["reports"].collect()}
    assert [x[1] for x in flags[2] if x[0] == data] == ["FLAG"] and [x[1] for x in flags[1] if x[0] == data] == ["PASS"]
    assert any("a reviewer has it" in r.target for r in out["segments"].filter("doc_id = 4").collect())
    low = {r.doc_id: [i.text for i in r["items"] if i.text and "low OCR confidence" in i.text] for r in out["reports"].collect()}
    assert low[2] and not low[1] and not low[4]


def test_stored_blocks_are_matched_by_their_patterns(spark, monkeypatch):
    kept, keep = [], run.datums.kept
    monkeypatch.setattr(run.datums, "kept", lambda df, what: (kept.append(what), keep(df, what))[1])
    pairs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(0).alias("block_ord"), F.lit("body").alias("kind"), F.lit("Rs. 500 is due").alias("source_text"))
    done = pairs.select("doc_id", F.lit(0).alias("seg_idx"), "block_ord", F.col("source_text").alias("source"), F.concat(F.lit("Rs. 50"), F.col("doc_id"), F.lit(" is due")).alias("target"))
    documents = pairs.select("doc_id", F.array().cast("array<struct<code:string,severity:string>>").alias("warnings"), F.lit(True).alias("ok"))
    out = run.verified(pairs, done, documents, terms.glossary(spark, [("રકમ", "amount (sum)", "general", False, [], [])]), reports=False, keep=scratch.kept)
    found = sorted((r.doc_id, r.status, r.other, r.context) for r in out["datums"].filter("side = 's'").collect())
    assert "patterns" in kept
    assert found == [(0, "agreed", "Rs. 500", "Rs. 500 is due"), (1, "changed", "Rs. 501", "Rs. 500 is due"), (2, "changed", "Rs. 502", "Rs. 500 is due")]
