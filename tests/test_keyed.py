"""Joins by order, tables replaced by document, and state kept by streams."""

import random

import pytest
from pyspark.sql import functions as F

from tulya.operators import asof
from tulya.sources import scratch, writers
from tulya.streaming import state


@pytest.mark.parametrize("width", [None, 10])
def test_as_of_equals_a_search(spark, width):
    r = random.Random(3)
    key = lambda: r.choice(["a", "a", "a", "b", "c", None])
    rows = [(i, key(), r.choice([None, *range(60)]), r.randrange(5)) for i in range(300)]
    marks = [(key(), r.choice([None, *range(60)]), r.randrange(5), i) for i in range(120)]
    marks = [m for n, m in enumerate(marks) if m[:3] not in {x[:3] for x in marks[:n]}]
    left = spark.createDataFrame(rows, "id int, k string, t int, tie int")
    right = spark.createDataFrame(marks, "k string, t int, tie int, what int")
    cut = None if width is None else F.floor(F.col("t") / width)
    got = {x["id"]: x["what"] for x in asof.as_of(left, right, "k", "t", ["what"], cut, "tie").collect()}
    want = {}
    for i, k, t, tie in rows:
        before = [m for m in marks if k is not None and t is not None and m[0] == k and m[1] is not None and (m[1], m[2]) <= (t, tie)]
        want[i] = max(before, key=lambda m: m[1:3])[3] if before else None
    assert got == want and any(v is not None for v in got.values())
    assert asof.as_of(left, right.limit(0), "k", "t", ["what"], cut, "tie").filter("what is not null").count() == 0
    assert asof.as_of(left.limit(0), right, "k", "t", ["what"], cut).count() == 0


def test_a_mark_of_the_same_place_counts(spark):
    left = spark.createDataFrame([(1, "a", 5)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 7), ("a", 6, 8)], "k string, t int, what int")
    assert asof.as_of(left, right, "k", "t", ["what"]).first()["what"] == 7


def test_replacing_documents(spark):
    path, kind = scratch.new_path(spark, "t"), "doc_id long, x string"
    table = lambda: sorted(map(tuple, writers.documents(spark, path, kind).collect()), key=str)
    assert table() == []
    rows = [(i, f"{i}") for i in range(200)] + [(None, "n")]
    assert writers.replace_documents(spark.createDataFrame(rows, kind), path) == 1
    new = [(3, "c"), (3, "d"), (500, "e"), (None, "m")]
    assert writers.replace_documents(spark.createDataFrame(new, kind), path) == 2
    want = sorted([r for r in rows if r[0] not in (3, None)] + new, key=str)
    assert table() == want
    broken = spark.createDataFrame([(7, "z")], kind).withColumn("x", F.expr("raise_error('no')").cast("string"))
    with pytest.raises(Exception, match="no"):
        writers.replace_documents(broken, path)
    assert table() == want
    ids = spark.createDataFrame([(i,) for i in (0, 3, 999)], "doc_id long")
    assert writers.replace_documents(spark.createDataFrame([], kind), path, removed=ids) == 3
    assert table() == [r for r in want if r[0] not in (0, 3)]
    assert sorted(map(tuple, writers.documents(spark, path, kind, 1).collect()), key=str) == sorted(rows, key=str)


def run(spark, base, kind, parts, transform):
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{base}/in")
        made = transform(spark.readStream.schema(kind).parquet(f"{base}/in"))
        made.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{base}/out").collect()]


def test_a_final_result_ends_its_key(spark):
    parts = [[("a", "draft", 1, "x"), ("b", "draft", 1, "y")], [("a", "final", 3, "z"), ("a", "draft", 2, "late")], [("a", "final", 4, "again"), ("b", "draft", 1, "same"), ("b", "draft", 5, "w")]]
    got = run(spark, scratch.new_path(spark, "s"), "k string, status string, n long, body string", parts, lambda s: state.progressive(s, "k", "status", "n", "body"))
    assert sorted(got) == [("a", "draft", 1, "x"), ("a", "draft", 2, "late"), ("a", "final", 3, "z"), ("b", "draft", 1, "y"), ("b", "draft", 5, "w")]


def test_progress_is_not_repeated_across_batches(spark):
    parts = [[("a", "s", 1.2, 1), ("a", "s", 1.4, 2)], [("a", "s", 0.6, 3), ("a", "t", 1.0, 4)], [("a", "t", 1.1, 5), ("a", "s", 1.0, 6)]]
    got = run(spark, scratch.new_path(spark, "s"), "k string, stage string, p double, n long", parts, lambda s: state.throttled(s, "k", "stage", F.col("p"), "n"))
    assert sorted(got, key=lambda r: r[3]) == [("a", "s", 1, 1), ("a", "t", 1, 4), ("a", "s", 1, 6)]
