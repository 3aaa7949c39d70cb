"""Blocks to sentences, sentences to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..rules.structure import NOT_TRANSLATED

#: Tokens and sentences that a chunk holds; pairs carried into the next.
CHUNK_TOKENS = 1400
CHUNK_SEGMENTS = 14
CARRIED = 3


def build_segments(blocks: DataFrame) -> DataFrame:
    """doc_id, seg_idx, block_id, block_ord, kind, page_no, source, passthrough.

    blocks: doc_id, block_ord, block_id, kind, page_no, source_text. A sentence
    without Indic script passes through if its document has any Gujarati.
    """
    gujarati = F.max(X.is_gujarati("source_text")).over(Window.partitionBy("doc_id"))  # of all blocks; the order below needs the same exchange
    some = blocks.withColumn("has_gujarati", gujarati).filter(~F.col("kind").isin(NOT_TRANSLATED)).withColumn("source_text", X.trimmed("source_text"))
    some = some.filter("source_text != ''")
    sentences = X.split_sentences("source_text")
    cut = some.select("*", F.when(F.size(sentences) > 0, sentences).otherwise(F.array("source_text")).alias("s"))
    rows = cut.select("doc_id", "block_id", "block_ord", "kind", "page_no", "has_gujarati", F.posexplode("s").alias("pos", "source"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_ord", "pos")) - 1
    rows = rows.withColumn("seg_idx", idx)
    passthrough = ~F.col("source").rlike(X.INDIC) & F.col("has_gujarati")
    return rows.withColumn("passthrough", passthrough).drop("has_gujarati", "pos")


def packed(sizes: Column, most_tokens: int = CHUNK_TOKENS, most_items: int = CHUNK_SEGMENTS) -> Column:
    """Chunk number of each of an array of sizes, filled greedily in order; what is too large stands alone."""
    start = F.struct(
        F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")
    )

    def add(s: Column, size: Column) -> Column:
        new = (s["n"] > 0) & ((s["sum"] + size > most_tokens) | (s["n"] >= most_items))
        chunk = F.when(new, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(
            F.array_append(s["out"], chunk).alias("out"),
            chunk.alias("chunk"),
            F.when(new, size).otherwise(s["sum"] + size).cast("long").alias("sum"),
            F.when(new, F.lit(1)).otherwise(s["n"] + 1).alias("n"),
        )

    return F.aggregate(sizes, start, add, lambda s: s["out"])


def chunk_segments(segments: DataFrame, size_col: str, order_col: str = "seg_idx", id_col: str = "doc_id",
                   most_tokens: int = CHUNK_TOKENS, most_items: int = CHUNK_SEGMENTS) -> DataFrame:
    """Adds chunk_id. Which chunk a segment falls in depends on all before it in its document, so one
    document's sizes are folded together; only they and the order travel."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(size_col).cast("long").alias("t"))))
    docs = segments.groupBy(id_col).agg(items.alias("items"))
    chunks = packed(F.transform("items", lambda i: i["t"]), most_tokens, most_items)
    rows = docs.withColumn("chunks", chunks).select(id_col, F.explode(F.arrays_zip("items", "chunks")).alias("z"))
    keyed = rows.select(id_col, F.col("z.items.o").alias(order_col), F.col("z.chunks").alias("chunk_id"))
    return segments.join(keyed, [id_col, order_col])


def carried_context(segments: DataFrame, pairs: int = CARRIED) -> DataFrame:
    """doc_id, chunk_id, context: the last pairs (source, target) of the chunk before, in order."""
    last = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy(F.desc("seg_idx")))
    tail = segments.withColumn("_r", last).filter(F.col("_r") <= pairs)
    tail = tail.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "source", "target"))).alias("t"))
    before = F.lag("t").over(Window.partitionBy("doc_id").orderBy("chunk_id"))
    return tail.withColumn("context", F.coalesce(before, F.array().cast(tail.schema["t"].dataType))).drop("t")


def name_hints(segments: DataFrame, most: int = 40) -> DataFrame:
    """doc_id, name, n: runs of capitalised words seen twice or of eight letters and more, the commonest."""
    found = F.regexp_extract_all(F.col("source"), F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){0,2})(?![A-Za-z0-9_])"), F.lit(1))
    names = segments.filter("kind != 'seal_note'").select("doc_id", F.explode(found).alias("name"))
    counts = names.groupBy("doc_id", "name").agg(F.count("*").alias("n")).filter("n >= 2 or length(name) >= 8")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "name"))
    return counts.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def with_omissions(requested: DataFrame, answered: DataFrame) -> DataFrame:
    """One row per requested segment: its answer, the last resort where there is none or an empty one."""
    a = answered.select("doc_id", "seg_idx", F.col("target").alias("_t")).dropDuplicates(["doc_id", "seg_idx"])
    out = requested.join(a, ["doc_id", "seg_idx"], "left")
    missing = F.col("_t").isNull() | (X.trimmed("_t") == "")
    return out.withColumns({
        "omitted": missing,
        "target": F.when(missing, X.last_resort_english("source")).otherwise(F.col("_t")),
    }).drop("_t")


def locked_over(segments: DataFrame, locks: DataFrame) -> DataFrame:
    """Targets a reviewer has locked win over any other. locks: doc_id, seg_idx, locked_target."""
    out = segments.join(locks.select("doc_id", "seg_idx", "locked_target"), ["doc_id", "seg_idx"], "left")
    return out.withColumns({
        "locked": F.col("locked_target").isNotNull(), "target": F.coalesce("locked_target", "target"),
    }).drop("locked_target")
