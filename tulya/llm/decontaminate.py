"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of word shingles. A document holds a window only if
it holds all of its shingles, so by the prefix principle (overlap threshold 1)
one shingle of each window, the rarest, must be joined and no other. Rarity is
the shingle's count over all documents. A joined shingle fixes where the window
would start; windows that would begin before the text's first word or end after
its last are dropped by position and length, the others are compared word for
word over the item-sized window.

Both scans test shingles against a bitmap whose size has a fixed ceiling, so
what is broadcast doesn't grow with the data; false hits go in the exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import bitmap, session, texts, written

_WINDOWS = "item_id long, window_text string, n long, at int, shingle long"
_HITS = "doc_id long, text_key long, n_words long, at long, shingle long, first long, near string"


def _words(text: str) -> list[str]:
    data = K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    w = K.Words(data, np.array([0, len(data)]), K.PLAIN_WORDS)
    return [bytes(data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]


def _item_windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("item_id", "window_text", "n", "at", "shingle")}
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _words(text)
                if item is None or not words:
                    continue
                n = min(window, len(words))
                for i in range(len(words) - n + 1):
                    joined = " ".join(words[i : i + n])
                    data = np.frombuffer(joined.encode(), np.uint8)
                    w = K.Words(data, np.array([0, len(data)]), K.PLAIN_WORDS)
                    for at, h in zip(*K.shingles(w, w.hashes(), min(shingle, n)), strict=True):
                        for k, v in zip(out, (item, joined, n, int(at), int(h.astype(np.int64))), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["item_id"], pa.int64()), pa.array(out["window_text"], pa.string()), pa.array(out["n"], pa.int64()),
                 pa.array(out["at"], pa.int32()), pa.array(out["shingle"], pa.int64())], list(out))

    return run


def _hits(column: pa.Array, bits: np.ndarray, lengths: list[int], shingle: int):
    """For each piece: first row, words, and word index and hash of shingles that the bitmap has."""
    for start, _, data, off in K.pieces(column):
        w = K.Words(data, off, K.PLAIN_WORDS)
        hashes = w.hashes()
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for k in sorted({min(shingle, n) for n in lengths}):
            at, keys = K.shingles(w, hashes, k)
            ok = K.bitmap_has(bits, keys)
            found[0].append(at[ok])
            found[1].append(keys[ok])
        yield start, w, np.concatenate(found[0]), np.concatenate(found[1])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """(report, spans) of benchmark windows found in documents.

    report: doc_id, text_key, n_words, n_hit, item_ids (array of strings, sorted).
    spans: doc_id, text_key, item_id, start (word index), n (words).

    A null text has no words and no hits. Rows with the same id and text are one
    document; rows with the same id and other texts are reported one by one
    (text_key tells them apart). Null ids are kept. Items with a null id or
    without words match nothing; repeated items count once. An empty benchmark
    leaves every document clean; empty documents give an empty report.
    """
    spark: SparkSession = session(docs)
    items = texts(benchmark, item_col, item_text_col)
    windows = written(
        items.select("doc_id", "text").mapInArrow(_item_windows(window, shingle), _WINDOWS).distinct(), "windows"
    )
    body = texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    keys = windows.select(F.col("shingle").alias("key")).distinct()
    lengths = [r[0] for r in windows.select("n").distinct().collect()]  # at most `window` values
    bits = spark.sparkContext.broadcast(bitmap(keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, found in _hits(batch.column(0), bits.value, lengths, shingle):
                key, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"]
                )

    seen = (
        body.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("seen"))
    )
    # The rarest shingle of each window; ties go to the smaller hash and the earlier place.
    ranked = windows.join(seen, "shingle", "left").select(
        "window_text", "n", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "at").alias("rank")
    )
    prefix = written(
        ranked.groupBy("window_text", "n")
        .agg(F.min("rank").alias("rank"))
        .select("window_text", "n", F.col("rank.shingle").alias("shingle"), F.col("rank.at").alias("at")),
        "prefix",
    )
    keys = prefix.select(F.col("shingle").alias("key")).distinct()
    rare = spark.sparkContext.broadcast(bitmap(keys))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_keys = batch.column(0), batch.column(2)
            for start, w, at, found in _hits(batch.column(1), rare.value, lengths, shingle):
                rows = w.row[at]
                first = np.maximum(w.first[rows], at - (window - 1))
                last = np.minimum(w.first[rows + 1], at + window)
                near = [
                    " ".join(bytes(w.data[w.starts[i] : w.ends[i]]).decode() for i in range(a, b))
                    for a, b in zip(first, last, strict=True)
                ]
                n = len(w.off) - 1
                base = pa.array(np.arange(start, start + n))
                take = pa.concat_arrays([base, pa.array(start + rows)])
                counts = w.counts()
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take),
                        text_keys.take(take),
                        pa.array(np.concatenate([counts, counts[rows]]).astype(np.int64)),
                        pa.concat_arrays([none, pa.array((at - w.first[rows]).astype(np.int64))]),
                        pa.concat_arrays([none, pa.array(found.view(np.int64))]),
                        pa.concat_arrays([none, pa.array((first - w.first[rows]).astype(np.int64))]),
                        pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(near, pa.string())]),
                    ],
                    ["doc_id", "text_key", "n_words", "at", "shingle", "first", "near"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    scanned = written(body.mapInArrow(scan, _HITS.replace("doc_id long", f"doc_id {kind}")), "hits")
    start = F.col("h.at") - F.col("w.at")
    spans = (
        scanned.filter("shingle is not null")
        .alias("h")
        .join(prefix.alias("w"), F.col("h.shingle") == F.col("w.shingle"))
        .filter((start >= 0) & (start + F.col("w.n") <= F.col("h.n_words")))  # by position and length
        .filter(
            F.expr("array_join(slice(split(h.near, ' '), cast(h.at - w.at - h.first + 1 as int), cast(w.n as int)), ' ')")
            == F.col("w.window_text")
        )
        .select("h.doc_id", "h.text_key", "h.n_words", "w.window_text", start.alias("start"), "w.n")
        .distinct()
    )
    spans = written(spans, "spans")
    ordered = Window.partitionBy("doc_id", "text_key").orderBy("start", "n")
    until = F.max(F.col("start") + F.col("n")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    hit = (
        spans.select("doc_id", "text_key", "n_words", "start", "n")
        .distinct()
        .withColumn("until", F.coalesce(until, F.lit(0)))
        .select(
            "doc_id", "text_key", "n_words",
            F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "until")).cast("long").alias("hit"),
            F.lit(None).cast("string").alias("item"),
        )
    )
    of_items = windows.select("window_text", "item_id").distinct()
    named = (
        spans.select("doc_id", "text_key", "n_words", "window_text")
        .distinct()
        .join(of_items, "window_text")
        .select("doc_id", "text_key", "n_words", F.lit(0).cast("long").alias("hit"), F.col("item_id").cast("string").alias("item"))
    )
    base = scanned.filter("shingle is null").select(
        "doc_id", "text_key", "n_words", F.lit(0).cast("long").alias("hit"), F.lit(None).cast("string").alias("item")
    )
    report = (
        base.unionByName(hit)
        .unionByName(named)
        .groupBy("doc_id", "text_key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.sum("hit").alias("n_hit"),
            F.array_sort(F.collect_set("item")).alias("item_ids"),
        )
    )
    found = spans.join(of_items, "window_text").select("doc_id", "text_key", "item_id", "start", "n")
    return report, found


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = decontaminate(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return report.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window, with all their columns."""
    report, _ = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = report.filter("n_hit > 0").select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key"))
    on = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_key"])
    return docs.join(bad, on, "left_anti")
