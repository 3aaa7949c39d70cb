"""Which targets to ask for again, and which answers to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Weights of the reasons; repairs asked for per document; segments to a request.
WEIGHTS = {"empty": 8, "indic": 7, "transliterated": 7, "foreign_numbers": 6, "lost_numbers": 6, "short": 4, "duplicate": 2}
MOST_REPAIRS, REPAIR_BATCH = 48, 8


def can_repeat(key: Column) -> Column:
    """Whether a text of this key is long enough to count as a repetition of another."""
    return (F.length(key) >= 24) & (F.size(F.split(key, " ")) >= 4)


def target_flags(source: Column, target: Column, repeated: Column) -> Column:
    """array of struct(reason, weight); an empty target has no other reason."""
    texts = F.struct(X.trimmed(F.coalesce(source, F.lit(""))).alias("s"), X.trimmed(F.coalesce(target, F.lit(""))).alias("t"))
    return X.let(texts, lambda x: _flags(x["s"], x["t"], repeated))


def _flags(s: Column, t: Column, repeated: Column) -> Column:
    key = X.target_key(t)
    flag = lambda name: F.struct(F.lit(name).alias("reason"), F.lit(WEIGHTS[name]).alias("weight"))
    flags = F.array(
        F.when(X.indic_ratio(t) > 0, flag("indic")),
        F.when(X.looks_transliterated(t), flag("transliterated")),
        F.when(F.size(X.foreign_numbers(s, t)) > 0, flag("foreign_numbers")),
        F.when(F.size(X.lost_numbers(s, t)) > 0, flag("lost_numbers")),
        F.when((F.length(s) >= 40) & (F.length(t) / F.greatest(F.lit(1), F.length(s)) < 0.45), flag("short")),
        F.when(can_repeat(key) & repeated, flag("duplicate")),
    )
    return F.when(t == "", F.array(flag("empty"))).otherwise(F.filter(flags, lambda f: f.isNotNull()))


def assess(segments: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Adds flags and weight. The same English for two sources of a document counts as repeated."""
    key = X.target_key(F.coalesce("target", F.lit("")))
    same = F.count("*").over(Window.partitionBy(doc_col, key)) > 1
    out = segments.withColumn("_same", same)
    # The generator keeps the flags from being worked out again wherever their weight is used.
    flags = target_flags(F.col("source"), F.col("target"), F.col("_same"))
    out = out.select(*(c for c in segments.columns if c != "flags"), F.explode(F.array(flags)).alias("flags"))
    return out.withColumn("weight", F.aggregate("flags", F.lit(0), lambda a, f: a + f["weight"]))


def repair_queue(assessed: DataFrame, most: int = MOST_REPAIRS, doc_col: str = "doc_id", order_col: str = "seg_idx") -> DataFrame:
    """The heaviest segments of each document with their place in the queue and their batch."""
    rank = F.row_number().over(Window.partitionBy(doc_col).orderBy(F.desc("weight"), order_col))
    out = assessed.filter("weight > 0").withColumn("place", rank).filter(F.col("place") <= most)
    return out.withColumn("batch", F.floor((F.col("place") - 1) / REPAIR_BATCH).cast("int"))


def adopt(assessed: DataFrame, repaired: DataFrame, doc_col: str = "doc_id", order_col: str = "seg_idx") -> DataFrame:
    """A repaired target replaces the old one only if it weighs less."""
    r = repaired.select(doc_col, order_col, F.col("target").alias("_new"))
    out = assessed.join(r, [doc_col, order_col], "left")
    after = F.aggregate(target_flags(F.col("source"), F.col("_new"), F.lit(False)), F.lit(0), lambda a, f: a + f["weight"])
    better = F.col("_new").isNotNull() & (after < F.col("weight"))
    return out.withColumns({"target": F.when(better, F.col("_new")).otherwise(F.col("target")), "adopted": better}).drop("_new")


def cleaner(segments: DataFrame, corrected: DataFrame, doc_col: str = "doc_id", order_col: str = "seg_idx") -> DataFrame:
    """A correction of residue is taken if it holds less of it; what is left is stripped."""
    c = corrected.select(doc_col, order_col, F.col("target").alias("_new"))
    out = segments.join(c, [doc_col, order_col], "left")
    take = F.col("_new").isNotNull() & (X.indic_ratio("_new") < X.indic_ratio("target"))
    return out.withColumn("target", X.strip_residue(F.when(take, F.col("_new")).otherwise(F.col("target")))).drop("_new")


def accepted_chunks(requested: DataFrame, answered: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """doc, chunk_id, asked, got, failed: a chunk fails if under half of its segments are answered."""
    a = answered.select(doc_col, "seg_idx").distinct().withColumn("_got", F.lit(1))
    out = requested.join(a, [doc_col, "seg_idx"], "left").groupBy(doc_col, "chunk_id").agg(
        F.count("*").alias("asked"), F.count("_got").alias("got")
    )
    return out.withColumn("failed", F.col("got") * 2 < F.col("asked"))
