"""Places of facts in long texts, and the sweep over overlapping ones."""

import random
import re

from pyspark.sql import functions as F

from tulya.operators import datums, verify


def test_running_equals_a_loop_over_any_length(spark):
    r = random.Random(2)
    rows = [(n, [r.randint(0, 9) for _ in range(n)]) for n in (0, 1, 2, 63, 64, 65, 128, 129, 1000)]
    df = spark.createDataFrame(rows, "n int, v array<int>")
    total = datums.running(F.col("v"), lambda a, x: a + x, F.lit(0))
    most = datums.running(F.col("v"), lambda a, x: F.greatest(a, x), F.lit(-1))
    for row in df.select("v", total.alias("t"), most.alias("m")).collect():
        assert row.t == [sum(row.v[:i]) for i in range(len(row.v))]
        assert row.m == [max(row.v[:i], default=-1) for i in range(len(row.v))]


def test_spans_equal_finditer(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab1 2") for _ in range(r.randint(0, 400))) for _ in range(60)] + ["", "1", "1212", "a1" * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", datums.spans(F.col("t"), "[12]a?").alias("s")).collect()
    for row in got:
        assert [tuple(s) for s in row.s] == [(m.start(), m.end(), m[0]) for m in re.finditer("[12]a?", row.t)]


def test_disjoint_equals_the_rule(spark):
    r = random.Random(6)
    rows = []
    for i in range(80):
        n, width = r.choice([0, 1, 5, 40, 300]), r.choice([20, 400, 4000])
        starts = [r.randrange(width) for _ in range(n)]
        rows.append((i, [(s, s + r.randint(1, 9), r.randrange(5), "k", "x", None) for s in starts]))
    df = spark.createDataFrame(rows, f"i int, f {datums._FOUND.join(['array<', '>'])}")
    for row in df.select("f", datums.disjoint(F.col("f")).alias("kept")).collect():
        kept = []
        for f in sorted(map(tuple, row.f), key=lambda f: (f[0] - f[1], f[0], f[2])):
            if not any(f[0] < k[1] and k[0] < f[1] for k in kept):
                kept.append(f)
        assert [tuple(k)[:3] for k in row.kept] == [k[:3] for k in sorted(kept)]


def test_a_text_of_many_facts(spark):
    text = " ".join(f"Rs. {i} on 12/05/1996" for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id int, t string")
    got = datums.extract_datums(df, "t", "s", ["doc_id"], with_names=False).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"currency": 3000, "date": 3000}


def test_bands_align_as_plain_loops_do():
    r = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    text = lambda n: [set(r.choices(words, k=r.randint(0, 6))) for _ in range(n)]
    before = verify._BAND
    try:
        for band in (1, 2, 7, 256):
            verify._BAND = band
            for _ in range(15):
                a, b = text(r.randint(1, 30)), text(r.randint(1, 30))
                assert list(verify._banded_moves(a, b)) == list(verify._plain_moves(a, b))
        a, b = text(300), text(330)
        assert list(verify._banded_moves(a, b)) == list(verify._plain_moves(a, b))
    finally:
        verify._BAND = before
