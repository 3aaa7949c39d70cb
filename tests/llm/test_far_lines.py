"""A line goes if any earlier line is within its bound, not only the earliest of a run of words."""

from tulya.llm import linededup


def test_a_line_near_one_that_is_not_the_earliest_of_its_runs(spark):
    a = [f"word{i}" for i in range(20)]
    b = ["x", *a[1:19], "y"]  # two edits from a
    c = ["x", "p", *a[2:18], "q", "y"]  # two from b, four from a; all runs it shares with b are in a
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((a, b, c))], "doc_id long, text string")
    assert sorted(r.doc_id for r in linededup.removed_lines(df).collect()) == [1, 2]
