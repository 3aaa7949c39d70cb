"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, so it
doesn't depend on their order, and one letter more, less or exchanged moves it by
a known value. Every word is listed under its key less each of its letters' values;
two words differ by an exchange where two such keys are equal, by an addition or a
removal where one equals the other's whole key. Anagrams are many, so a list is
split by the half of the letters that the edit leaves alone, which is the first
half if the edit lies behind it and the last one otherwise: no link is lost. The
order of all letters is compared for what meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, tidy, written

#: Keys are kept under 2 ** 62, so that sums of any length neither fail nor differ.
_MASK = (1 << 62) - 1
#: Words longer than this travel as digests and are fetched for the links they are in.
SHORT = 64
#: A maximal run of letters, after A-Z have become a-z.
LETTERS = r"[a-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run): a row per run of letters of the whole text, A-Z lower-cased. Null texts have none."""
    low = F.translate(docs[text_col], _UPPER, _LOWER)
    return docs.select(docs[id_col].alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), 0)).alias("run"))


def _power(letter: str) -> str:
    code = f"cast(ascii({letter}) as bigint)"
    return " * ".join([code] * 5)


def _short(text: Column) -> Column:
    return F.when(F.length(text) <= SHORT, text).otherwise(F.concat(F.lit("#"), F.md5(text.cast("binary"))))


def _listed(words: DataFrame) -> DataFrame:
    """(rest, side, half, at, shape, first, ref, n): where a word is looked for.

    ``at`` is the place of the letter taken out, -1 for the word as it is; ``shape`` is
    what remains, ``first`` whether that place is the first of a run of one letter (taking
    out any of a run gives one shape).
    """
    key = f"aggregate(split(word, ''), 0L, (a, c) -> (a + {_power('c')}) & {_MASK}L)"
    base = words.select("word", "n", F.expr(key).alias("key"), F.length("word").alias("size"), _short(F.col("word")).alias("ref"))
    whole = base.select(
        F.col("key").alias("rest"),
        F.explode(F.expr("array(true, false)")).alias("side"),
        F.expr("size div 2").cast("int").alias("h"),
        F.lit(-1).alias("at"),
        F.col("word").alias("left_over"),
        F.lit(True).alias("first"),
        "ref",
        "n",
    )
    place = base.select("*", F.explode(F.expr("sequence(0, size - 1)")).alias("at"))
    place = place.select("*", F.expr("substring(word, at + 1, 1)").alias("c"), F.expr("cast((size - 1) div 2 as int)").alias("h"))
    holes = place.select(
        F.expr(f"(key - {_power('c')}) & {_MASK}L").alias("rest"),
        F.expr("at >= h").alias("side"),
        "h",
        "at",
        F.expr("concat(substring(word, 1, at), substring(word, at + 2))").alias("left_over"),
        F.expr("at = 0 or substring(word, at, 1) <> c").alias("first"),
        "ref",
        "n",
    )
    rows = whole.union(holes)
    half = F.expr("if(side, substring(left_over, 1, h), right(left_over, h))")
    return rows.select("rest", "side", _short(half).alias("half"), "at", _short(F.col("left_over")).alias("shape"), "first", "ref", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(ref, near, near_n) of every two of the distinct ``word``s that are one letter apart, both ways."""
    rows = _listed(words)
    a, b = rows.alias("a"), rows.alias("b")
    same_place = (F.col("a.at") == F.col("b.at")) | ((F.col("a.at") == -1) & F.col("b.first")) | ((F.col("b.at") == -1) & F.col("a.first"))
    meet = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("rest", "side", "half", "shape")]
    found = a.join(b, meet[0] & meet[1] & meet[2] & meet[3] & same_place & (F.col("a.ref") != F.col("b.ref")))
    found = found.select(F.col("a.ref").alias("ref"), F.col("b.ref").alias("near"), F.col("b.n").alias("near_n"))
    long = words.filter(F.length("word") > SHORT).select(_short(F.col("word")).alias("near"), F.col("word").alias("whole"))
    digests = F.col("near").startswith("#")
    return found.filter(~digests).union(found.filter(digests).join(long, "near").select("ref", "whole", "near_n"))


def spelling_groups(words: DataFrame, *, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words with their counts n.

    A word's form is the near word of the largest n, the smallest in code-point order
    of several, if that n is at least ``ratio`` times the word's own. The root follows
    forms to the last one; n grows at each, so there is an end. Words without near
    words have n_near 0. Null words are left out; a table without words gives none.
    Words of any length are linked; those over SHORT letters travel as digests of 128
    bits. A letter taken from a place costs the length of its word, so one word costs
    the square of its length.
    """
    if ratio < 2:
        raise ValueError("forms must have more occurrences than their words")
    words = words.filter("word is not null").select("word", "n")
    best = near_words(words).groupBy("ref").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    told = words.withColumn("ref", _short(F.col("word"))).join(best, "ref", "left")
    enough = F.expr(f"-best.less >= {ratio} * n")
    out = written(
        told.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(out.filter("form is not null").select("word", "form"))
    ends = roots.select(F.col("word").alias("w"), "root")
    return out.join(ends, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): every round follows twice as many forms as the one before."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("beyond"))
        with tidy(now.sparkSession):
            left = now.join(ahead, now["root"] == ahead["w"], "left_semi").count()
        if not left:
            return now
        before, now = now, written(
            now.join(ahead, now["root"] == ahead["w"], "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots"
        )
        free(before)


def planted(found: DataFrame, every: int = 97) -> DataFrame:
    """The runs, of which one in ``every`` lacks a letter, both chosen by a checksum of document and run.

    Runs of documents without an id stay as they are.
    """
    h = F.expr("crc32(cast(concat(cast(doc_id as string), ':', run) as binary))")
    at = F.expr("cast(h % length(run) as int)")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, *, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of the words with so many letters and occurrences, written."""
    long = words.filter(F.length("word") >= least_letters)
    return written(long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n), "words")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_groups(counted(planted(runs(docs))))
