"""What models answer, read leniently: JSON among prose, several schemas, pairs under audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

_FENCED = r"(?is)```(?:json)?\s*(.*?)```"
_PAIR = (
    r"(?s)###\s*\[([0-9]+)\]\s*GUJARATI:\s*(.*?)\s*ENGLISH:\s*(.*?)"
    r"(?=\s*###\s*\[|\s*GLOSSARY IN PLAY|\s*##|$)"
)


def loose_json(raw: Column) -> Column:
    """The JSON in a reply: what a code fence holds, the whole, the outermost braces or brackets; null if none parses."""
    whole = X.trimmed(F.coalesce(raw, F.lit("")))
    fenced = F.when(whole.rlike(_FENCED), X.trimmed(F.regexp_extract(whole, _FENCED, 1)))

    def outermost(opening: str, closing: str) -> Column:
        first = F.instr(whole, opening)
        last = F.length(whole) - F.instr(F.reverse(whole), closing) + 1
        found = (first > 0) & F.contains(whole, F.lit(closing)) & (last > first)
        return F.when(found, F.substr(whole, first, last - first + 1))

    def valid(c: Column) -> Column:
        return F.when((c != "") & F.try_parse_json(c).isNotNull(), c)

    return F.coalesce(*(valid(c) for c in (fenced, whole, outermost("{", "}"), outermost("[", "]"))))


def reply_targets(replies: DataFrame, raw_col: str, keys: list[str]) -> DataFrame:
    """keys, id, target, confidence, notes: a row per segment that a reply answers.

    ``segments`` may be an array or an object keyed by id. A segment's id is its
    id, its index, or its key (in an array its place); of text the first run of
    digits counts. The text is in target, text or translation, else empty. Of
    several answers for one id the last counts. Null, blank or broken replies give
    no rows.
    """
    v = F.try_parse_json(loose_json(F.col(raw_col)))
    listed = F.try_variant_get(v, "$.segments", "array<variant>")
    keyed = F.try_variant_get(v, "$.segments", "map<string,variant>")
    entry = lambda key, x: F.struct(key.cast("string").alias("key"), x.alias("s"))
    entries = F.coalesce(
        F.transform(listed, lambda x, i: entry(i, x)), F.transform(F.map_entries(keyed), lambda e: entry(e["key"], e["value"]))
    )
    rows = replies.select(*keys, F.posexplode(entries).alias("pos", "e")).select(*keys, "pos", F.col("e.key").alias("key"), F.col("e.s").alias("s"))
    field = lambda name, kind="string": F.try_variant_get("s", f"$.{name}", kind)
    given = F.coalesce(field("id"), field("index"), F.when(F.col("key").rlike("^[0-9]+$"), F.col("key")))
    rows = rows.select(
        *keys, "pos", F.regexp_extract(given, "[0-9]+", 0).alias("digits"),
        F.coalesce(field("target"), field("text"), field("translation"), F.lit("")).alias("target"),
        field("confidence", "double").alias("confidence"), field("notes", "array<string>").alias("notes"),
    ).filter("digits != ''")
    last = F.max_by(F.struct("target", "confidence", "notes"), "pos").alias("r")
    return rows.groupBy(*keys, F.col("digits").cast("long").alias("id")).agg(last).select(*keys, "id", "r.*")


def judge_pair(number: Column, source: Column, target: Column, hints: Column | None = None) -> Column:
    """A pair as the judge is shown it."""
    shown = F.concat(F.lit("### ["), number.cast("string"), F.lit("]\nGUJARATI: "), source, F.lit("\n\nENGLISH: "), target)
    if hints is None:
        return shown
    asked = F.concat(F.lit("\n\nGLOSSARY IN PLAY: "), F.array_join(hints, "; "))
    return F.concat(shown, F.when(F.size(hints) > 0, asked).otherwise(F.lit("")))


def judge_pairs(prompt: Column) -> Column:
    """array of struct(id, source, target): the pairs that a prompt shows."""
    parts = [F.regexp_extract_all(prompt, F.lit(_PAIR), F.lit(i)) for i in (1, 2, 3)]
    rows = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("id", "source", "target"), strict=True)))
    return F.transform(rows, lambda r: F.struct(r["id"].cast("long").alias("id"), X.trimmed(r["source"]).alias("source"), X.trimmed(r["target"]).alias("target")))


def reconciled(verdicts: DataFrame, asked: DataFrame, keys: list[str], total_col: str = "n_blocks") -> DataFrame:
    """Verdicts with the block they are about; those about none go.

    verdicts: keys, batch, id and more; asked: keys, batch, place (from 0 in the
    batch), block_idx, and the number of the document's blocks. An id smaller than
    its batch is a place, for models number batches anew; another one is a block.
    """
    by = [*keys, "batch"]
    sizes = asked.groupBy(*by).agg(
        F.count("*").alias("_n"), F.max(total_col).alias("_total"), F.map_from_entries(F.collect_list(F.struct("place", "block_idx"))).alias("_at")
    )
    out = verdicts.join(sizes, by)
    place = F.try_element_at("_at", F.col("id").cast(asked.schema["place"].dataType))
    block = F.when((F.col("id") >= 0) & (F.col("id") < F.col("_n")), place).otherwise(F.col("id"))
    out = out.withColumn("block_idx", block).filter("block_idx >= 0 and block_idx < _total")
    return out.drop("_n", "_total", "_at")
