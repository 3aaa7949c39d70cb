"""What a score takes from facts is counted once a pattern; no row is dealt by its term."""

import re

import pytest
from pyspark.sql import functions as F

from tests.test_matched_datums import PAIRS
from tulya.operators import datums
from tulya.plans import queries


def test_tallies_are_those_of_the_rows(spark):
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "id int, source_text string, target_text string")
    b = b.withColumn("target_blank", F.coalesce(F.trim("target_text"), F.lit("")) == "")
    matched = datums.matched_datums(b, ["id"]).cache()
    want = {i: [0] * 5 for i in range(len(PAIRS))}
    for r in matched.filter("side = 's'").collect():
        want[r.id][0] += 1
        want[r.id][1] += r.status in ("changed", "missing")
    for r in datums.datum_findings(matched, ["id"]).filter("severity <> 'info'").collect():
        want[r.id][2 + ("critical", "major", "minor").index(r.severity)] += 1
    got = datums.datum_tallies(b, ["id"])
    assert {r.id: [r[c] for c in datums.TALLIES] for r in got.collect()} == want
    assert all(any(w[i] for w in want.values()) for i in range(4))


def test_neither_words_nor_documents_are_dealt_by_term(spark, monkeypatch):
    class Seen(Exception):
        pass

    kept = queries.kept

    def until_terms(df, what):
        if what == "terms":
            raise Seen(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, what)

    monkeypatch.setattr(queries, "kept", until_terms)
    with pytest.raises(Seen) as seen:
        queries._scored(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin [key#" in str(seen.value)
    assert not re.search(r"SortMergeJoin \[key#\d+\], ", str(seen.value))
