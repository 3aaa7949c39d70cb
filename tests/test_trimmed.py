"""Blanks of every kind go at both ends; the characters are those of the class."""

import re

from pyspark.sql import functions as F

from tulya.functions import text as X
from tulya.functions.jsregex import BLANK_CHARS, BLANKS


def test_blank_chars_are_the_class():
    assert {chr(i) for i in range(0x10000) if re.match(f"[{BLANKS}]", chr(i))} == set(BLANK_CHARS)


def test_trimmed_and_indic_ratio(spark):
    df = spark.createDataFrame([("　\n a b﻿ \r",), ("  ",), ("રકમ x",), (None,)], "t string")
    got = df.select(X.trimmed("t").alias("a"), F.round(X.indic_ratio("t"), 3).alias("r")).collect()
    assert [tuple(g) for g in got] == [("a b", 0.0), ("", 0.0), ("રકમ x", 0.75), (None, None)]
