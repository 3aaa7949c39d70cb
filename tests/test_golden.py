"""Fixed inputs against what has to come out, and stored-table queries against their SQL on small tables."""

import duckdb
import pytest

from tests import golden
from tulya.plans import reads


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(golden.QUERIES))
def test_golden(spark, name):
    got = golden.QUERIES[name](spark, "")
    want = duckdb.connect().execute(golden.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


_SMALL = [
    "document_lookup", "page_confidences", "mean_confidence", "page_review", "open_jobs", "queue_positions", "row_counts",
    "recent_activity", "parsed_report", "document_types", "health", "statute_lookup", "type_metadata", "empty_retry", "failed_retry",
    "retry_stop", "retry_merge", "placed_answers", "mutation_gap", "property_sentence", "report_status",
]


@pytest.mark.parametrize("name", _SMALL)
def test_reads(spark, name):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the test tables aren't here")
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = reads.QUERIES[name](spark, sf)
    want = db.execute(reads.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())
