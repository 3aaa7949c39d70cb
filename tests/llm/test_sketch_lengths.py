"""Words left out count in a line's length as well as in its sketch."""

from tulya.llm import linededup


def test_four_words_left_out_for_two_others_make_no_pair(spark, monkeypatch):
    words = [f"word{i}" for i in range(31)]
    far = [w for i, w in enumerate(words) if i not in (3, 9, 15, 21)] + ["p", "q"]  # three edits are allowed; six bits and two words differ
    near = [w for i, w in enumerate(words) if i not in (3, 9, 15)]
    df = spark.createDataFrame([*enumerate(" ".join(w) for w in (words, far, near))], "doc_id long, text string")
    seen, written = {}, linededup.written
    monkeypatch.setattr(linededup, "written", lambda t, what: seen.setdefault(what, t if what != "pairs" else written(t, what)) and written(t, what))
    assert [r.doc_id for r in linededup.removed_lines(df.filter("doc_id < 2")).collect()] == []
    assert seen["pairs"].count() == 0
    assert [r.doc_id for r in linededup.removed_lines(df).collect()] == [2]
