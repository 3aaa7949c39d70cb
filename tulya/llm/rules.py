"""Quality rules as statistics, and an isolation forest over them.

The rules' counts are taken from whole texts. A forest of random splits, each
tree grown on its own few hundred documents as the method has it, isolates odd
documents after few splits. The anomaly score above which a document goes is
calibrated on all labelled rows: it is where low and good quality part best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import session, texts, written

TREES = 128
#: Documents that a tree is grown on; the method's own sample size.
TREE_ROWS = 256
#: Ranges of the score in which labelled rows are counted.
BINS = 1000

_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_STARTS = np.ones(256, dtype=np.int64)  # the first byte of a character
_STARTS[0x80:0xC0] = 0

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lines long, n_types long"
FEATURES = 8


def _dup_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; lines with a word."""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines)), len(lines)


def _repeat_words(words: list[bytes], hashes: np.ndarray, width: int = 5) -> int:
    """Words inside windows found twice or more. Hashes propose the windows, words decide."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    key = hashes[:n].copy()
    for j in range(1, width):
        key = K.mix(key) + hashes[j : n + j]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return 0
    seen: dict[tuple, int] = {}
    windows = [tuple(words[i : i + width]) for i in at]
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    at = at[[seen[x] > 1 for x in windows]]
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _STATS.split(", ")]
    for batch in batches:
        for start, end, data, off in K.pieces(batch.column(1)):
            w = K.Words(data, off, K.BLANK_WORDS, lower=False)
            hashes = w.hashes()
            inside = K.BLANK_WORDS[data].astype(np.int64)
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[off])  # noqa: B023, E731
            out = np.zeros((end - start, len(names)), dtype=np.int64)
            out[:, 0] = w.counts()
            out[:, 1] = total(_STARTS[data] * inside)
            out[:, 2] = total(_SYMBOLS[data])
            out[:, 5] = total(_UPPER[data])
            raw = data.tobytes()
            for i in range(end - start):
                text = raw[off[i] : off[i + 1]]
                out[i, 3], out[i, 6] = _dup_lines(text)
                part = hashes[w.first[i] : w.first[i + 1]]
                out[i, 4] = _repeat_words(text.split(), part)
                out[i, 7] = len(set(part.tolist()))
            ids = batch.column(0)[start:end]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(out[:, j]) for j in range(len(names)))], ["doc_id", *names])


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of the counts, so that documents of any length compare."""
    words = np.maximum(stats["n_words"], 1).astype(np.float64)
    chars = np.maximum(stats["word_chars"], 1).astype(np.float64)
    lines = np.maximum(stats["n_lines"], 1).astype(np.float64)
    return np.column_stack([
        np.log1p(stats["n_words"]),
        stats["word_chars"] / words,
        stats["n_symbols"] / words,
        stats["n_symbols"] / chars,
        stats["n_dup_lines"] / lines,
        stats["n_repeat_words"] / words,
        stats["n_upper"] / chars,
        # Heaps' law makes this share fall with length; the power takes most of that out.
        stats["n_types"] / words**0.85,
    ])


def path_norm(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), cut, left child (right is the next), path length at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.size = max(1, min(tree_rows, len(rows)))
        limit = int(np.ceil(np.log2(max(2, self.size))))
        feature, cut, left, path, self.roots = [], [], [], [], []

        def node() -> int:
            for x, v in ((feature, -1), (cut, 0.0), (left, 0), (path, 0.0)):
                x.append(v)
            return len(feature) - 1

        def grow(at: int, own: np.ndarray, depth: int) -> None:
            spread = np.flatnonzero(own.min(axis=0) < own.max(axis=0)) if len(own) > 1 else np.zeros(0, int)
            if depth >= limit or not len(spread):
                path[at] = depth + float(path_norm(len(own)))
                return
            f = int(rng.choice(spread))
            c = float(rng.uniform(own[:, f].min(), own[:, f].max()))
            feature[at], cut[at], left[at] = f, c, node()
            node()
            below = own[:, f] <= c
            grow(left[at], own[below], depth + 1)
            grow(left[at] + 1, own[~below], depth + 1)

        for _ in range(trees if len(rows) else 0):
            self.roots.append(node())
            grow(self.roots[-1], rows[rng.choice(len(rows), self.size, replace=False)], 0)
        self.feature, self.cut = np.array(feature, np.int64), np.array(cut)
        self.left, self.path = np.array(left, np.int64), np.array(path)

    @classmethod
    def of(cls, fields: dict) -> Forest:
        forest = cls.__new__(cls)
        vars(forest).update(fields)
        return forest

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 is odd, under a half is usual. 0 without trees."""
        if not self.roots or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                f = self.feature[at]
                go = np.flatnonzero(f >= 0)
                if not len(go):
                    break
                at[go] = self.left[at[go]] + (rows[go, f[go]] > self.cut[at[go]])
            total += self.path[at]
        return 2.0 ** (-total / len(self.roots) / max(float(path_norm(self.size)), 1e-9))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float | None:
    """The score above which documents go: the largest rise of (bad that go - good that go).

    Arguments are counts by bin of the score. Without rows of both kinds there is none.
    """
    if not good.sum() or not bad.sum():
        return None
    over = lambda c: np.cumsum(c[::-1])[::-1] / c.sum()
    gain = over(bad) - over(good)
    i = int(np.argmax(gain))
    return i / len(good) if gain[i] > 0 else None


def rule_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    quality_col: str = "quality",
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """doc_id, the counts, score, base_failed, kept: a row per row of docs.

    Words end at blanks; a null text has none. The forest is grown on at most
    trees * tree_rows documents that pass the base rules (the method's own
    sample, spread over all documents by a hash); the scores of all labelled rows
    count for the threshold. Labels with a null id or quality, and those whose
    document is missing, don't count; without both kinds of labels nothing but the
    base rules rejects. Rows with a null id are judged, not matched with labels.
    Empty documents give an empty result.
    """
    spark: SparkSession = session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    body = texts(docs, id_col, text_col).select("doc_id", "text")
    stats = body.mapInArrow(_measure, f"doc_id {kind}, {_STATS}")
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    stats = written(stats.withColumn("base_failed", failed), "stats")
    names = [c.split()[0] for c in _STATS.split(", ")]

    most = trees * tree_rows
    passed = stats.filter("not base_failed")
    n = passed.count()
    by = F.xxhash64("doc_id", *names)
    some = passed.filter(F.pmod(by, F.lit(1 << 20)) < F.lit(int(min(1.0, 1.2 * most / max(n, 1)) * (1 << 20)) + 1))
    rows = some.orderBy(by).limit(most).select(*names).toArrow()
    forest = Forest(features({c: rows[c].to_numpy() for c in names}), trees, tree_rows)
    grown = spark.sparkContext.broadcast(vars(forest))  # data only: executors may lack the class

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: batch.column(batch.schema.names.index(c)).to_numpy() for c in names}
            score = Forest.of(grown.value).scores(features(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    scored = written(stats.mapInArrow(judge, f"doc_id {kind}, {_STATS}, base_failed boolean, score double"), "scored")
    marks = labels.select(labels[label_id_col].alias("l_id"), labels[quality_col].alias("quality")).dropna()
    bins = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")
    counted = (
        scored.filter("not base_failed")
        .join(marks, F.col("doc_id") == F.col("l_id"))
        .groupBy(bins, (F.col("quality") > 0).alias("good"))
        .count()
        .collect()
    )  # 2 * BINS rows at most
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in counted:
        (good if r["good"] else bad)[r["bin"]] = r["count"]
    cut = best_cut(good, bad)
    kept = ~F.col("base_failed") if cut is None else ~F.col("base_failed") & (F.col("score") < F.lit(cut))
    return scored.withColumn("kept", kept)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rule_verdicts(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
