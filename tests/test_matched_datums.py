"""Facts of a block are matched within its row, to the same end as fact by fact."""

from pyspark.sql import functions as F

from tulya.operators import datums
from tulya.plans import queries

PAIRS = [
    ("Rs. 500 and Rs. 500 dated 2001-05-20, 77 items", "Rs. 500 dated 20 May 2001 and 77 and 88"), ("રકમ રૂ. ૫૦૦ તા. ૨૦૦૧-૦૫-૨૦", "An amount of Rs. 900 dated 20 May 2001"),
    ("12,50,000 of 1250000", "1,250,000 and 12,50,000"), ("Rs. 500", ""), ("", "Rs. 500 at 10:30 hrs"), (None, None), ("Rs. 500; 7.5%", "  "),
    ("Section 12(3) and 40 and 40", "sec 12(3), 40"), ("dated 03/04/2001 and Rs. 5", "dated 3 April 2001 and Rs. 5"), ("two of 2 seven", "Seven, two, two"),
    ("Shri Ramesh Patel paid Rs. 900", "Shri Ramesh Patil paid Rs. 901"), ("Rs. 1 " * 40, "Rs. 1 " * 30 + "Rs. 2"), ("100 200 300", "300 200 100 100"), ("Gandhi Bank 5", "Gandhi bank 6"),
]


def _rows(df, *columns):
    return sorted(tuple(str(x) for x in r) for r in df.select(*columns).collect())


def test_matched_in_the_row_as_fact_by_fact(spark):
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "id int, source_text string, target_text string")
    b = b.withColumn("target_blank", F.coalesce(F.trim("target_text"), F.lit("")) == "")
    s, t = (datums.extract_datums(b, f"{x}_text", x[0], ["id"]) for x in ("source", "target"))
    want = datums.match_datums(s, t, b.select("id", "target_blank"), ["id"])
    got = datums.matched_datums(b, ["id"], context=True)
    assert sorted(got.columns) == sorted(want.columns)
    rows = _rows(got, *want.columns)
    assert rows == _rows(want, *want.columns)
    assert {r.status for r in want.select("status").distinct().collect()} >= {"agreed", "changed", "missing", "repeated", "silent", "added", "extra", "ambiguous"}


def test_facts_are_neither_dealt_nor_sorted(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the test tables aren't here")
    plan = queries.must_judge(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_many_blocks_are_matched_by_few_patterns(spark, monkeypatch):
    tables = {}
    keep = datums.kept
    monkeypatch.setattr(datums, "kept", lambda df, what: tables.setdefault(what, keep(df, what)))
    n = F.col("id").cast("string")
    b = spark.range(1000, 3000).select("id", F.concat(F.lit("Rs. "), n, F.lit(" dated 2001-05-20")).alias("source_text"), F.concat(F.lit("Rs. "), n, F.lit(" and "), n).alias("target_text"))
    out = datums.matched_datums(b.withColumn("target_blank", F.lit(False)), ["id"])
    assert tables["patterns"].count() == 1
    found = {(r.side, r.kind, r.status): r["count"] for r in out.groupBy("side", "kind", "status").count().collect()}
    assert found == {("s", "currency", "agreed"): 2000, ("s", "date", "missing"): 2000, ("t", "currency", "agreed"): 2000, ("t", "number", "extra"): 2000}


def test_plain_dates_have_the_value_of_a_reading_by_numbers(spark):
    from tulya.functions import text as X

    raw = [f"{y}-{m}-{d}" for y in ("1996", "2999", "0996", "3000") for m in ("01", "12", "13", "00", "1") for d in ("01", "31", "32", "00", "9")]
    raw += [f"{d} {m} {y}" for d in ("1", "01", "31", "32", "0", "12") for m in ("January", "May", "december", "મે", "Month") for y in ("1996", "96", "3000")]
    raw += ["1996-03-03\n", "3 March 1996 ", "3  March 1996"]
    df = spark.createDataFrame([(x,) for x in raw], "r string")
    numbers = F.transform(F.regexp_extract_all("r", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))
    read = df.select("r", datums.normalize_date(F.col("r")).alias("a"), X.let(numbers, lambda n: datums._date_of(F.col("r"), n)).alias("b")).collect()
    assert [(r.r, r.a) for r in read] == [(r.r, r.b) for r in read]
