"""Facts of short texts are searched once a shape: the same facts as a search of every text."""

from pyspark.sql import functions as F

from tulya.operators import datums

TEXTS = [
    "An amount of Rs. 1,250.50 dated 3 March 1996", "An amount of Rs. 9,999.00 dated 7 March 2011", "under IPC, 1973 and IPC, 2073", "NI Act 1881 or Act 1925",
    "રકમ રૂ. 54321 તા. 1996-03-13", "રકમ રૂ. ૫૪૩૨૧ તા. ૧૯૯૬-૦૩-૧૩", "શ્રી રમેશ૧ પટેલ અને શ્રી રમેશ૨ પટેલ", "7.5 per cent at 10:30 hrs, Pin 380001", "see CR No. 12/2019",
    "Shri Ramesh Patel, the accused - Suresh; 2 of seven; Gandhi Bank", "", None, "no facts", "Rs. 5/- " * 80,
]


def _facts(df):
    return sorted((tuple(str(x) for x in r) for r in datums.extract_datums(df, "t", "s", ["id"]).collect()))


def test_shapes_hold_the_facts_of_their_texts(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    once = _facts(df)
    monkeypatch.setattr(datums, "_SHORT", -1)  # every text is searched as it is
    assert once == _facts(df) and len(once) > 100


def test_numbers_do_not_make_new_shapes_but_statutes_are_their_own(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").select("id", datums.shape(F.col("t")).alias("s"))
    shape = {r.id: r.s for r in df.collect()}
    assert shape[2] == TEXTS[2] and shape[3] == TEXTS[3]  # a statute's year has to be of 19..
    many = spark.range(10000).select(datums.shape(F.concat(F.lit("Rs. "), 10000 + F.col("id"), F.lit(" dated 3 March 1996"))).alias("s"))
    assert many.distinct().count() == 1


def test_no_other_pattern_knows_a_digit(spark):
    import re

    for kind, _, pattern, _ in datums.R.PATTERNS:
        bare = re.sub(r"\{[0-9,]+\}|\[0-9૦-૯\]", "", pattern)
        assert kind == "statute" or not re.search("[0-9૦-૯]", bare), kind
