"""Lines are compared with the earliest of their runs first, and only what is left with the others, in parts."""

import random

import pytest
from pyspark.sql import functions as F

from tulya.llm import linededup


def _edits(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def _copies(rnd: random.Random, base: list[str], n: int, most: int) -> list[list[str]]:
    """Copies of a line with up to most words replaced, put in or left out."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(1, most)):
            at, how = rnd.randrange(len(w)), rnd.random()
            w[at : at + (how < 0.8)] = [] if how < 0.2 else [f"x{rnd.randrange(9999)}"]
        out.append(w)
    return out


@pytest.mark.parametrize("most_pairs", [1 << 24, 5])
def test_the_same_lines_go_as_by_comparing_all(spark, monkeypatch, most_pairs):
    monkeypatch.setattr(linededup, "MOST_PAIRS", most_pairs)
    rnd = random.Random(5)
    lines = []
    for n in (20, 33, 150, 190):
        base = [f"w{rnd.randrange(500)}" for _ in range(n)]
        lines += _copies(rnd, base, 14, 3 * n // 10)
    rnd.shuffle(lines)
    want = {
        i for i, a in enumerate(lines)
        if any(_edits(a, b) <= max(1, max(len(a), len(b)) // 10) for b in lines[:i])
    }
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    assert {r.doc_id for r in linededup.removed_lines(df).collect()} == want
    assert 0 < len(want) < len(lines)


def test_pairs_of_copies_grow_with_their_number(spark, monkeypatch):
    rnd, base = random.Random(7), [f"word{i}" for i in range(40)]
    lines = [base, *_copies(rnd, base, 60, 4)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    made, written = [], linededup.written
    monkeypatch.setattr(linededup, "written", lambda t, what: (made.append(t.count()) if "pairs" in what else None, written(t, what))[1])
    assert linededup.removed_lines(df).select("doc_id").distinct().count() == df.select(F.lower("text")).distinct().count() - 1
    assert sum(made) <= 2 * len(lines)  # 1,830 are all


def test_long_lines_with_nothing_but_common_runs_make_no_pair(spark, monkeypatch):
    rnd = random.Random(9)
    runs = [[f"a{i}", f"b{i}", f"c{i}"] for i in range(12)]
    lines = [[x for i in range(60) for x in (*rnd.choice(runs), f"own{line}x{i}")] for line in range(12)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    made, written = [], linededup.written
    monkeypatch.setattr(linededup, "written", lambda t, what: (made.append(t.count()) if "pairs" in what else None, written(t, what))[1])
    assert linededup.removed_lines(df).count() == 0
    assert sum(made) == 0
