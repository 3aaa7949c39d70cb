"""Lines that share a run of words and little else are not compared; near ones still are."""

from tulya.llm import linededup


def test_a_shared_run_alone_makes_no_pair(spark, monkeypatch):
    shared = [f"run{i}" for i in range(15)]
    far = [" ".join([*shared, *(f"own{i}x{j}" for j in range(15))]) for i in range(30)]
    near = far[7].replace("own7x3", "p").replace("own7x9", "q").replace("own7x12", "r")  # three words of thirty
    df = spark.createDataFrame([*enumerate(far), (30, near)], "doc_id long, text string")
    seen, written = {}, linededup.written
    monkeypatch.setattr(linededup, "written", lambda t, what: seen.setdefault(what, t if what != "pairs" else written(t, what)) and written(t, what))
    assert [r.doc_id for r in linededup.removed_lines(df).collect()] == [30]
    assert seen["pairs"].count() == 1
