"""A translation asked for, asked for again where it failed, and brought to an end.

Every pass asks for a small frontier: what failed, what came back empty, what a second
opinion is wanted on, what still holds source script. Answers are patches that are
written once; a segment's text is its last patch. A provider takes requests
(doc_id, chunk_id, seg_idx, source) and returns (doc_id, chunk_id, seg_idx, target) for
those that it answers; a chunk of which it answers under half has failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import kept
from . import control, repair
from .segments import CHUNK_SEGMENTS, CHUNK_TOKENS, chunk_segments

Provider = Callable[[DataFrame], DataFrame]
KEY = ["doc_id", "seg_idx"]


def _asked(requests: DataFrame, ask: Provider, what: str) -> tuple[DataFrame, DataFrame]:
    """Answers of the chunks that didn't fail, and (doc_id, chunk_id, failed) of all; both written."""
    requests = kept(requests.select("doc_id", "chunk_id", "seg_idx", "source"), f"{what}-asked")
    raw = ask(requests).select("doc_id", "chunk_id", "seg_idx", X.trimmed("target").alias("target")).filter("target is not null")
    known = requests.select("doc_id", "chunk_id", "seg_idx")
    answers = kept(raw.join(known, ["doc_id", "chunk_id", "seg_idx"], "left_semi"), f"{what}-answers")
    chunks = control.accepted_chunks(requests, answers).select("doc_id", "chunk_id", "failed")
    return answers, kept(chunks, f"{what}-chunks")


def _good(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    return answers.join(chunks.filter("not failed"), ["doc_id", "chunk_id"], "left_semi").select(*KEY, "target")


def _patched(out: DataFrame, patch: DataFrame) -> DataFrame:
    new = patch.groupBy(*KEY).agg(F.min("target").alias("_new"))
    return out.join(new, KEY, "left").withColumn("target", F.coalesce("_new", "target")).drop("_new")


def first_pass(segments: DataFrame, ask: Provider, tokens: int, items: int) -> tuple[DataFrame, DataFrame]:
    """Segments with their targets ('' where there is none), and those of failed chunks."""
    sized = segments.withColumn("_tokens", X.estimate_tokens("source"))
    requests = kept(chunk_segments(sized, "_tokens", most_tokens=tokens, most_items=items), "first")
    answers, chunks = _asked(requests, ask, "first")
    out = _patched(segments.withColumn("target", F.lit("")), _good(answers, chunks))
    failed = requests.join(chunks.filter("failed"), ["doc_id", "chunk_id"], "left_semi").select(*KEY, "source")
    return out, failed


def second_opinion(out: DataFrame, ask: Provider, *, most: int = control.MOST_REPAIRS) -> tuple[DataFrame, DataFrame]:
    """Segments after the stronger provider's answers, and the keys of those that it answered.

    Documents that came back more than half empty aren't asked. A batch that fails ends
    its document's pass. Answers are placed by repair.placed_answers and taken by
    repair.adopted, in order.
    """
    doc = Window.partitionBy("doc_id")
    blank = F.coalesce(X.trimmed("target"), F.lit("")) == ""
    usable = out.withColumns({"_bad": F.count_if(blank).over(doc), "_all": F.count("*").over(doc)}).filter("_bad <= _all / 2").drop("_bad", "_all")
    usable = kept(usable.select(*KEY, "source", "target"), "usable")
    queue = control.repair_queue(control.assess(usable), most=most).select("doc_id", "batch", "place", "seg_idx", "source")
    queue = kept(queue, "queue")
    # A request's id is its segment's number; an answer may come back with other numbers, so it keeps its place.
    raw = kept(ask(queue.withColumnRenamed("batch", "chunk_id")).withColumnRenamed("chunk_id", "batch"), "opinions")
    counted = queue.groupBy("doc_id", "batch").agg(F.count("*").alias("n"))
    some = raw.filter(X.trimmed("target") != "").groupBy("doc_id", "batch").agg(F.count("*").alias("got"))
    chunks = counted.join(some, ["doc_id", "batch"], "left").select("doc_id", F.col("batch").alias("chunk_id"), F.col("got").isNull().alias("failed"))
    reached = repair.stopped_after(chunks, 1).filter("not failed").select("doc_id", F.col("chunk_id").alias("batch"))
    placed = kept(repair.placed_answers(queue, raw.join(reached, ["doc_id", "batch"], "left_semi")), "placed")
    taken = kept(repair.adopted(usable, placed).filter("replaced").select(*KEY, "target"), "adopted")
    return _patched(out, taken), placed.select(*KEY)


def translated(
    segments: DataFrame,
    ask: Provider,
    ask_again: Provider | None = None,
    ask_stronger: Provider | None = None,
    *,
    tokens: int = CHUNK_TOKENS,
    items: int = CHUNK_SEGMENTS,
) -> DataFrame:
    """doc_id, seg_idx, source, target, state: every segment once, with an English text.

    segments: doc_id, seg_idx, source of what is to be translated. In order: the first
    pass; failed chunks in halves, until two in a row fail; empty segments of documents
    that aren't mostly empty; the second opinion; segments that still hold much source
    script and weren't part of it. What is left of that script is stripped, and a
    segment without a text gets what its source holds in Latin script, or a marker.
    state: translated, stripped (script was taken out), filled. Every pass is bounded by
    the caps of ``repair`` a document, and every document ends after these five.
    """
    again = ask_again or ask
    segments = segments.select(*KEY, "source")
    out, failed = first_pass(segments, ask, tokens, items)
    failed = kept(failed, "failed")
    if not failed.isEmpty():
        answers, chunks = _asked(repair.failed_retry(failed, tokens, items), again, "again")
        reached = repair.stopped_after(chunks)
        out = _patched(out, kept(_good(answers, reached).filter("target <> ''"), "again-taken"))
    empty = repair.empty_retry(out, failed, tokens, items)
    answers, chunks = _asked(empty, again, "empty")
    out = _patched(out, kept(_good(answers, chunks).filter("target <> ''"), "empty-taken"))
    asked = None
    if ask_stronger is not None:
        out, asked = second_opinion(out, ask_stronger)
    answers, chunks = _asked(repair.residue_retry(out, asked, tokens, items), again, "residue")
    better = out.join(_good(answers, chunks).filter("target <> ''").withColumnRenamed("target", "_new"), KEY)
    better = better.filter(X.indic_ratio("_new") < X.indic_ratio("target")).select(*KEY, F.col("_new").alias("target"))
    out = _patched(out, kept(better, "residue-taken"))
    mixed, none = X.indic_ratio("target") > 0, X.trimmed("target") == ""
    text = F.when(none, X.last_resort_english("source")).otherwise(X.strip_residue("target"))
    state = F.when(none, "filled").when(mixed, "stripped").otherwise("translated")
    return out.select(*KEY, "source", text.alias("target"), state.alias("state"))
