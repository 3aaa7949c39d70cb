"""The query alignment takes sentences as they are, as its SQL does; a run cleans them first, as the reference does."""

from tulya.operators import verify


def test_accented_letters_end_words_unless_cleaned(spark):
    df = spark.createDataFrame([("a", ["réauxeau enbüeer", "other words"], ["auxeau eer"])], "id string, s array<string>, t array<string>")
    one = lambda **more: verify.align(df, "s", "t", "id", **more).first()
    assert [p.confidence for p in one(clean=False).pairs] == [1.0]
    assert [p.confidence for p in one().pairs] == [0.0]
