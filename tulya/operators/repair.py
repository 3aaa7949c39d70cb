"""Second tries: which segments are asked for again, and which answers are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .control import WEIGHTS, assess, can_repeat, target_flags
from .segments import CHUNK_SEGMENTS, CHUNK_TOKENS, chunk_segments

#: Chunks asked again, at least and after a failure of many; residue that is asked again; segments to such a chunk.
LEAST_CHUNKS, MOST_CHUNKS = 8, 32
RESIDUE_ABOVE, RESIDUE_CHUNK = 0.15, 3


def retry_limits(tokens: int = CHUNK_TOKENS, items: int = CHUNK_SEGMENTS) -> tuple[int, int]:
    """Tokens and segments of a chunk that is asked again: half as many."""
    return max(200, tokens // 2), max(1, items // 2)


def _chunked(segments: DataFrame, cap: Column, tokens: int, half: int) -> DataFrame:
    sized = segments.withColumn("_tokens", X.estimate_tokens("source"))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return chunk_segments(sized, "_tokens", most_tokens=tokens, most_items=half).withColumn("_n", n).filter(F.col("chunk_id") < cap).drop("_n", "_tokens")


def failed_retry(segments: DataFrame, tokens: int = CHUNK_TOKENS, items: int = CHUNK_SEGMENTS) -> DataFrame:
    """Segments of failed chunks (doc_id, seg_idx, source) in smaller chunks; the more have failed, the more are asked.

    tokens and items are the limits of the chunks that failed.
    """
    less, half = retry_limits(tokens, items)
    wanted = F.ceil(F.col("_n") / half)
    return _chunked(segments, F.least(F.lit(MOST_CHUNKS), F.greatest(F.lit(LEAST_CHUNKS), wanted)), less, half)


def empty_retry(segments: DataFrame, failed: DataFrame | None = None, tokens: int = CHUNK_TOKENS, items: int = CHUNK_SEGMENTS) -> DataFrame:
    """Empty segments in smaller chunks, of documents of which at most half came back empty.

    segments: doc_id, seg_idx, source, target, of all that was to be translated. Those of failed chunks don't count.
    """
    rows = segments if failed is None else segments.join(failed.select("doc_id", "seg_idx", F.lit(True).alias("_failed")), ["doc_id", "seg_idx"], "left")
    empty = F.coalesce(F.col("target"), F.lit("")) == ""
    if failed is not None:
        empty = empty & F.col("_failed").isNull()
    doc = Window.partitionBy("doc_id")
    rows = rows.withColumns({"_empty": empty, "_all": F.count("*").over(doc), "_bad": F.count_if(empty).over(doc)})
    some = rows.filter("_empty and _bad <= _all / 2").select("doc_id", "seg_idx", "source")
    return _chunked(some, F.lit(LEAST_CHUNKS), *retry_limits(tokens, items))


def residue_retry(segments: DataFrame, asked: DataFrame | None = None, tokens: int = CHUNK_TOKENS, items: int = CHUNK_SEGMENTS) -> DataFrame:
    """Segments whose English still holds much Indic script, in small chunks, but for those already asked again."""
    some = segments.filter((F.coalesce(F.col("target"), F.lit("")) != "") & (X.indic_ratio("target") > RESIDUE_ABOVE))
    if asked is not None:
        some = some.join(asked.select("doc_id", "seg_idx"), ["doc_id", "seg_idx"], "left_anti")
    less, half = retry_limits(tokens, items)
    return _chunked(some.select("doc_id", "seg_idx", "source"), F.lit(LEAST_CHUNKS), less, min(RESIDUE_CHUNK, half))


def stopped_after(chunks: DataFrame, in_a_row: int = 2) -> DataFrame:
    """Results of retried chunks (doc_id, chunk_id, failed) as far as a run that stops after so many failures in a row gets."""
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    run = [F.coalesce(F.lag("failed", i).over(w), F.lit(False)) for i in range(in_a_row)]
    all_failed = F.lit(True)
    for f in run:
        all_failed = all_failed & f
    ended = F.max(F.when(F.col("_end"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return chunks.withColumn("_end", all_failed).withColumn("_ended", F.coalesce(ended, F.lit(0))).filter("_ended = 0").drop("_end", "_ended")


def replaced(segments: DataFrame, answers: DataFrame) -> DataFrame:
    """Segments with the answers that aren't empty in the place of what was there. answers: doc_id, seg_idx, target."""
    new = answers.filter("target is not null and target != ''").groupBy("doc_id", "seg_idx").agg(F.max("target").alias("_new"))
    out = segments.join(new, ["doc_id", "seg_idx"], "left")
    return out.withColumns({"replaced": F.col("_new").isNotNull(), "target": F.coalesce("_new", "target")}).drop("_new")


def placed_answers(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, seg_idx, candidate, by_id: answers of each batch of the repair queue, put to its segments.

    queue: doc_id, batch, place, seg_idx. answers: doc_id, batch, pos, id, target. If
    every id of a batch's answers was asked for, they go by id; else by position,
    for the numbers may have been shifted. Blank answers are none.
    """
    by = ["doc_id", "batch"]
    asked = queue.select(*by, "seg_idx", (F.row_number().over(Window.partitionBy(*by).orderBy("place")) - 1).alias("_nth"))
    given = answers.select(*by, "id", "target", (F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1).alias("_pos"))
    known = given.join(asked.select(*by, F.col("seg_idx").alias("id"), F.lit(1).alias("_known")), [*by, "id"], "left")
    matched = known.groupBy(*by).agg((F.count("_known") == F.count("*")).alias("by_id"))
    given = given.join(matched, by)
    at = given.select(*by, "by_id", F.when(F.col("by_id"), F.col("id")).otherwise(F.col("_pos")).alias("_key"), X.trimmed("target").alias("candidate"))
    joined = asked.join(at, by)
    fits = F.when(F.col("by_id"), F.col("_key") == F.col("seg_idx")).otherwise(F.col("_key") == F.col("_nth"))
    return joined.filter(fits & (F.col("candidate") != "")).select("doc_id", "seg_idx", "candidate", "by_id")


def adopted(segments: DataFrame, placed: DataFrame) -> DataFrame:
    """Segments with the candidates that weigh less than what was there, taken one after the other.

    segments: doc_id, seg_idx, source, target. Both texts are weighed as assess has it.
    Candidates of a document come in the order of the repair queue, the heaviest
    segment first, and whether one says what another segment says already is asked of
    the document as the candidates before it have left it: a fold over a document's
    candidates, of which the queue has at most MOST_REPAIRS, that carries the texts put
    in and taken out so far. A null or blank candidate is none. Of several for one
    segment the first in code-point order counts.
    """
    weighed = assess(segments).select("doc_id", "seg_idx", "source", "target", "weight", X.target_key(F.coalesce("target", F.lit(""))).alias("key"))
    given = placed.filter(F.trim("candidate") != "").groupBy("doc_id", "seg_idx").agg(F.min("candidate").alias("candidate"))
    tried = weighed.join(given, ["doc_id", "seg_idx"])
    flags = target_flags(F.col("source"), F.col("candidate"), F.lit(False))
    fixed = X.normalize_whitespace(X.restore_clause_label(F.col("candidate"), F.col("source")))
    tried = tried.select(
        "doc_id", "seg_idx", "weight", "key", fixed.alias("fixed"), X.target_key(fixed).alias("new"), X.target_key(X.trimmed("candidate")).alias("asked"),
        F.aggregate(flags, F.lit(0), lambda a, f: a + f["weight"]).alias("after"), can_repeat(X.target_key(X.trimmed("candidate"))).alias("can_repeat"),
    )
    present = weighed.groupBy("doc_id", F.col("key").alias("asked")).agg(F.count("*").cast("int").alias("n"))
    tried = tried.join(present, ["doc_id", "asked"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = F.struct((-F.col("weight")).alias("rank"), "seg_idx", "weight", "key", "new", "asked", "after", "can_repeat", "n", "fixed")
    by_doc = tried.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("tried"))
    move = "array<struct<old:string,new:string,seg_idx:{},fixed:string>>".format(segments.schema["seg_idx"].dataType.simpleString())

    def step(moved: Column, c: Column) -> Column:
        came = F.size(F.filter(moved, lambda m: m["new"] == c["asked"]))
        went = F.size(F.filter(moved, lambda m: m["old"] == c["asked"]))
        others = c["n"] + came - went - F.when(c["key"] == c["asked"], 1).otherwise(0)
        after = c["after"] + F.when(c["can_repeat"] & (others > 0), WEIGHTS["duplicate"]).otherwise(0)
        row = F.struct(c["key"].alias("old"), c["new"].alias("new"), c["seg_idx"].alias("seg_idx"), c["fixed"].alias("fixed"))
        return F.when(after < c["weight"], F.array_append(moved, row)).otherwise(moved)

    taken = by_doc.select("doc_id", F.explode(F.aggregate("tried", F.array().cast(move), step)).alias("m"))
    taken = taken.select("doc_id", "m.seg_idx", F.col("m.fixed").alias("_new"))
    out = weighed.join(taken, ["doc_id", "seg_idx"], "left")
    return out.select("doc_id", "seg_idx", "source", F.coalesce("_new", "target").alias("target"), F.col("_new").isNotNull().alias("replaced"))
