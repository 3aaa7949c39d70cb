"""Repeated passages by hashing lines and the pieces that long lines fall into.

Units are normalised (A-Z as a-z, blanks folded) and digested. Digests are grouped
over all documents; the occurrence of the smallest rank stays and the others are
repeats. What goes is reported with its place in the text as it was, so the cut can
be made, checked and undone.

A line of up to WINDOW words is one unit. A longer line is cut where its own words
say so: of the hashes of any WINDOW words in a row the smallest starts a unit (the
last of equals). So a passage falls into the same units wherever in a line it
stands, but for the pieces at its two ends: of a passage of n words inside a line at
least n - 2 * WINDOW + 1 are whole units.

Repeats one after the other are a passage; those of too few words stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import bitmap_table, free, maybe_in, texts, written

#: Words of a unit, at most.
WINDOW = 12
#: How a text falls into lines: a cut holds so many line feeds at least.
UNITS = {"line": 1, "paragraph": 2}


def starts_of_units(hashes: np.ndarray, first_of_line: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words start a unit: those that start a line, and the smallest of any window words of one line."""
    n = len(hashes)
    starts = first_of_line.copy()
    if n < window:
        return starts
    line = np.cumsum(first_of_line)
    # Compared as pairs (hash, -place), by a running minimum over the window's words.
    best, where = hashes[: n - window + 1].copy(), np.arange(n - window + 1)
    for j in range(1, window):
        other = hashes[j : n - window + 1 + j]
        less = other <= best
        best = np.where(less, other, best)
        where = np.where(less, np.arange(j, n - window + 1 + j), where)
    inside = line[: n - window + 1] == line[window - 1 :]
    starts[where[inside]] = True
    return starts


_ROWS = "doc_id {id}, text_key long, unit_no int, start long, n_chars int, words int, digest long"


def _units(breaks: int):
    """Rows of _ROWS of batches of (text, doc_id, text_key)."""
    feed = np.uint8(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, off in K.pieces(batch.column(0)):
                w = K.Words(data, off, K.BLANK_WORDS)
                if not len(w.starts):
                    continue
                hashes = w.hashes()
                new_row = np.concatenate([[True], w.row[1:] != w.row[:-1]])
                feeds = np.concatenate([[0], np.cumsum(data == feed)])
                between = feeds[w.starts[1:]] - feeds[w.ends[:-1]]
                line = new_row | np.concatenate([[True], between >= breaks])
                begins = np.flatnonzero(starts_of_units(hashes, line))
                ends = np.append(begins[1:], len(hashes))  # the first word after each unit
                nth = np.arange(len(hashes)) - np.repeat(begins, ends - begins)
                parts = K.mix(hashes + (nth + 1).astype(np.uint64) * K._BASE)
                digest = K.mix(np.add.reduceat(parts, begins) + (ends - begins).astype(np.uint64))
                # A unit reaches to the next of its line, the last one to its last word.
                last = np.append(line, True)[ends]
                stop = np.where(last, w.ends[ends - 1], np.append(w.starts, 0)[ends])
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                rows = w.row[begins]
                start = chars[w.starts[begins]] - chars[off[rows]]
                fresh = np.flatnonzero(new_row[begins])
                unit_no = np.arange(len(begins)) - np.repeat(fresh, np.diff(np.append(fresh, len(begins))))
                taken = pa.array(rows + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(taken), batch.column(2).take(taken), pa.array(unit_no.astype(np.int32)),
                     pa.array(start.astype(np.int64)), pa.array((chars[stop] - chars[w.starts[begins]]).astype(np.int32)),
                     pa.array((ends - begins).astype(np.int32)), pa.array(digest.view(np.int64))],
                    ["doc_id", "text_key", "unit_no", "start", "n_chars", "words", "digest"])

    return run


def repeated_passages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", least_words: int = 50
) -> DataFrame:
    """doc_id, text_key, unit_no, start, n_chars, words, passage_words, kept_doc_id, kept_start: units to remove.

    start and n_chars are in characters of the text as given (from 0). Of equal
    units that of the smallest (doc_id, text_key, unit_no) is kept, nulls first.
    Repeats one after the other are a passage. As the ends of a passage of
    least_words words needn't be whole units, passages whose whole units have
    least_words - 2 * WINDOW + 1 words go; with less than 2 * WINDOW every repeated
    unit does. Texts may be of any length. Null and blank texts have no units; rows
    with the same id and text are one document; other columns are not looked at; an
    empty table gives an empty result. Digests have 64 bits, so units that differ
    meet about once in 10**19 pairs.
    """
    floor = max(1, least_words - 2 * WINDOW + 1)
    kind = docs.schema[id_col].dataType.simpleString()
    body = texts(docs, id_col, text_col).select("text", "doc_id", F.xxhash64("text").alias("text_key"))
    rows = written(body.mapInArrow(_units(UNITS[unit]), _ROWS.format(id=kind)), "units")
    place = F.struct("doc_id", "text_key", "unit_no", "start")
    firsts = (
        rows.groupBy("digest")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("of"), "first")
    )
    firsts = written(firsts, "firsts")  # a join of its own, whose largest keys Spark can split
    bits = bitmap_table(firsts.select(F.col("of").alias("key")))
    again = maybe_in(rows, "digest", bits).join(firsts, F.col("digest") == F.col("of")).filter(~place.eqNullSafe(F.col("first")))
    doc = Window.partitionBy("doc_id", "text_key")
    # Rows with the same id and text repeat their units.
    again = again.withColumn("before", F.lag("unit_no").over(doc.orderBy("unit_no")))
    again = again.filter("before is null or before != unit_no")
    run = F.col("unit_no") - F.row_number().over(doc.orderBy("unit_no"))
    in_run = Window.partitionBy("doc_id", "text_key", "run")
    found = (
        again.withColumn("run", run)
        .withColumn("passage_words", F.sum("words").over(in_run))
        .filter(F.col("passage_words") >= floor)
        .select(
            "doc_id", "text_key", "unit_no", "start", "n_chars", "words", "passage_words",
            F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"),
        )
    )
    found = written(found, "passages")
    free(rows, firsts, bits[0])
    return found


def without(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, text, pieces: texts without the passages; pieces are the (start, n_chars) that stay."""
    body = texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    gone = passages.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "n_chars"))).alias("gone")
    )
    gone = gone.toDF("g_id", "g_key", "gone")
    same = (F.col("text_key") == F.col("g_key")) & F.col("doc_id").eqNullSafe(F.col("g_id"))
    whole = F.expr("if(gone is null, array(), gone)")
    joined = body.join(gone, same, "left").withColumn("gone", whole)
    froms = "concat(array(0L), transform(gone, g -> g.start + g.n_chars))"
    tos = "concat(transform(gone, g -> g.start), array(cast(char_length(text) as bigint)))"
    pieces = F.expr(
        f"filter(zip_with({froms}, {tos}, (a, b) -> named_struct('start', a, 'n_chars', b - a)), p -> p.n_chars > 0)"
    )
    left = "array_join(transform(pieces, p -> substring(text, cast(p.start + 1 as int), cast(p.n_chars as int))), '')"
    return joined.withColumn("pieces", pieces).select(
        "doc_id", "text_key", F.when(F.size("gone") == 0, F.col("text")).otherwise(F.expr(left)).alias("text"), "pieces"
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "unit_no", "start", "n_chars", "words", "passage_words", "kept_doc_id", "kept_start")
