"""Documents scored by masked pseudo-likelihood.

A small network sees two words on either side of a masked one and predicts it by
a two-level softmax, so its probabilities add up to one over the symbols. Symbols
are the commonest words of all documents and 64 hashed classes of rarer ones. A
word of a class has the class's probability times its own share of the class, from
counts of every word of all documents; so probabilities add up to one over the
whole vocabulary, which grows with the documents. Shares of the next commonest
words are at hand, those of the others are joined by word. The network is trained in numpy on every word of every document: in rounds, each on
another part of the documents; in a round every task starts from the same weights
and trains on its own rows, and the weights are averaged by words seen. The sums
of the averages are of integers, so their order doesn't matter. A document's
score is the sum of the log-probabilities of its words, each masked in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import session, texts, written

CLASSES = 32
SYMBOLS = CLASSES * CLASSES
RARE = 64
#: Words seen on either side; dimensions of an embedding and of the hidden layer.
SIDE = 2
WIDTH = 16
HIDDEN = 32
ROUNDS = 3
BATCH = 4096
RATE = 0.08
#: At most so many counts are broadcast; rarer words' are joined.
AT_HAND = 1 << 16
#: Weights are summed as multiples of this, times thousands of words.
GRAIN = 2.0**-20

_SHAPES = {
    "embed": (SYMBOLS + 1, WIDTH),
    "mix": (2 * SIDE * WIDTH, HIDDEN),
    "mix_bias": (HIDDEN,),
    "classes": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "words": (CLASSES, HIDDEN, CLASSES),
    "word_bias": (CLASSES, CLASSES),
}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


class Net:
    """The weights as views of one flat array."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in _SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, seed: int = 1) -> Net:
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(SIZE, np.float32))
        for name in ("embed", "mix", "classes", "words"):
            w = getattr(net, name)
            w[...] = rng.normal(0, 1 / np.sqrt(w.shape[-2] if name != "embed" else WIDTH), w.shape)
        return net

    def log_probs(self, around: np.ndarray, word: np.ndarray, grad: Net | None = None) -> np.ndarray:
        """Log-probability of each word given the symbols around it; adds the gradient of minus their mean."""
        n = len(word)
        x = self.embed[around].reshape(n, -1)
        h = np.tanh(x @ self.mix + self.mix_bias)
        group, inner = word // CLASSES, word % CLASSES
        out, back = _softmax(h @ self.classes + self.class_bias, group, grad is not None)
        if grad is not None:
            back /= n
            grad.classes += h.T @ back
            grad.class_bias += back.sum(axis=0)
            dh = back @ self.classes.T
        order = np.argsort(group.astype(np.int8), kind="stable")
        ends = np.searchsorted(group[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            own = order[ends[c] : ends[c + 1]]
            if not len(own):
                continue
            part = h[own]
            logs, back = _softmax(part @ self.words[c] + self.word_bias[c], inner[own], grad is not None)
            out[own] += logs
            if grad is not None:
                back /= n
                grad.words[c] += part.T @ back
                grad.word_bias[c] += back.sum(axis=0)
                dh[own] += back @ self.words[c].T
        if grad is not None:
            dh *= 1 - h * h
            grad.mix += x.T @ dh
            grad.mix_bias += dh.sum(axis=0)
            dx = (dh @ self.mix.T).reshape(-1, WIDTH)
            flat = around.ravel()
            order = np.argsort(flat.astype(np.int16), kind="stable")
            first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
            grad.embed[flat[order][first]] += np.add.reduceat(dx[order], first, axis=0)
        return out


_ONES = np.ones(CLASSES, np.float32)


def _softmax(logits: np.ndarray, target: np.ndarray, grad: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of the targets, and for a gradient probabilities less one at the target.

    Logits are held within 40 of zero instead of moved by their largest.
    """
    np.clip(logits, -40, 40, out=logits)
    at = np.arange(len(target)) * CLASSES + target
    picked = logits.ravel()[at]
    p = np.exp(logits, out=logits)
    total = p @ _ONES
    if grad:
        p /= total[:, None]
        p.ravel()[at] -= 1
    return picked - np.log(total), p if grad else None


def _symbols(column: pa.Array, known: np.ndarray, places: np.ndarray):
    """First row, symbols, row bounds, the symbols around each and hashes, of runs of rows."""
    for start, _, data, off in K.pieces(column):
        w = K.Words(data, off, K.BLANK_WORDS)
        hashes = w.hashes()
        rare = (SYMBOLS - RARE + hashes % np.uint64(RARE)).astype(np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            word = np.where(known[at] == hashes, places[at], rare)
        else:
            word = rare
        n = len(word)
        around = np.full((n, 2 * SIDE), SYMBOLS, np.int64)  # beyond a text's ends
        for j, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            a, b = max(0, -step), min(n, n - step)
            if a < b:
                here = w.row[a:b] == w.row[a + step : b + step]
                around[a:b, j][here] = word[a + step : b + step][here]
        yield start, word, w.first, around, hashes


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = [K.Words(data, off, K.BLANK_WORDS).hashes() for _, _, data, off in K.pieces(batch.column(0))]
        key, n = np.unique(np.concatenate([*every, np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def _train(weights, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(weights.value.copy())
        grad, seen = Net(np.zeros(SIZE, np.float32)), np.full(SIZE, 1e-6, np.float32)
        known, places = vocabulary.value
        words, rng = 0, np.random.default_rng(9)
        for batch in batches:
            for _, word, _, around, _ in _symbols(batch.column(0), known, places):
                order = rng.permutation(len(word))
                for at in range(0, len(word), BATCH):
                    own = order[at : at + BATCH]
                    grad.flat[:] = 0
                    net.log_probs(around[own], word[own], grad)
                    seen += grad.flat * grad.flat
                    net.flat -= RATE * grad.flat / np.sqrt(seen)
                words += len(word)
        if words:
            share = max(1, round(words / 1000))
            fixed = np.round(np.clip(net.flat, -60, 60).astype(np.float64) / GRAIN).astype(np.int64) * share
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, SIZE, dtype=np.int32)), pa.array(np.concatenate([[share], fixed]))], ["place", "total"]
            )

    return run


def _score(weights, vocabulary, at_hand):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(weights.value)
        known, places = vocabulary.value
        counted, shares, totals = at_hand.value
        for batch in batches:
            for start, word, first, around, hashes in _symbols(batch.column(0), known, places):
                logs = np.zeros(len(word) + 1)
                for at in range(0, len(word), 4 * BATCH):
                    logs[at : min(at + 4 * BATCH, len(word))] = net.log_probs(around[at : at + 4 * BATCH], word[at : at + 4 * BATCH])
                in_class = np.flatnonzero(word >= SYMBOLS - RARE)
                own = hashes[in_class]
                found = np.minimum(np.searchsorted(counted, own), len(counted) - 1) if len(counted) else np.zeros(len(own), np.int64)
                has = counted[found] == own if len(counted) else np.zeros(len(own), bool)
                logs[in_class[has]] += shares[found[has]]
                far = in_class[~has]  # the numerator is to be joined
                logs[far] -= totals[word[far] - (SYMBOLS - RARE)]
                n = np.diff(first)
                total = np.where(n > 0, np.add.reduceat(logs, np.minimum(first[:-1], len(word))), 0.0)
                rows = slice(start, start + len(n))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(far, first).astype(np.int32)), pa.array(hashes[far].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(c[rows] for c in batch.columns[1:]), pa.array(n.astype(np.int64)), pa.array(total), lists],
                    [*batch.schema.names[1:], "n_words", "log_prob", "far"],
                )

    return run


def word_counts(body: DataFrame) -> DataFrame:
    """word (its hash), n: how often each word occurs in all texts."""
    counts = body.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counts, "words")


def vocabulary_of(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (in order) and symbols of the commonest words."""
    top = counts.orderBy(F.desc("n"), "word").limit(SYMBOLS - RARE).collect()
    known = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], order.astype(np.int64)


def shares_of(counts: DataFrame, known: np.ndarray, most: int = AT_HAND) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Hashes (in order) and log-shares of their classes, of words that occur more often than the number returned; log of each class's words.

    The number is the least for which at most ``most`` words occur more often.
    """
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toArrow()  # a row per count
    n, words = sizes["n"].to_numpy(), sizes["words"].to_numpy()
    past = np.flatnonzero(np.cumsum(words) > most)
    bound = int(n[past[0]]) if len(past) else 0
    some = counts.filter(F.col("n") > bound).toArrow()
    hashes, n = some["word"].to_numpy().view(np.uint64), some["n"].to_numpy()
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    total = np.zeros(RARE, np.int64)
    per_class = counts.groupBy(F.expr(f"cast(word & {RARE - 1} as int)").alias("class")).agg(F.sum("n").alias("n")).toArrow()
    total[per_class["class"].to_numpy()] = per_class["n"].to_numpy()
    whole = counts.filter(F.col("word").isin([int(x) for x in known.view(np.int64)])).toArrow()  # symbols of their own
    place = (whole["word"].to_numpy().view(np.uint64) % np.uint64(RARE)).astype(np.int64)
    np.subtract.at(total, place, whole["n"].to_numpy())
    logs = np.log(np.maximum(total, 1))
    return (hashes, np.log(n) - logs[(hashes % np.uint64(RARE)).astype(np.int64)], logs), bound


def pseudo_likelihood(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, at_hand: int = AT_HAND
) -> DataFrame:
    """doc_id, n_words, log_prob: a row per row of docs.

    Words end at blanks, A-Z count as a-z. log_prob is the sum of natural
    log-probabilities of the words themselves, 0 for a null or blank text. All documents are
    trained on, once, in the round that a hash of their text names. Ids may be
    null or repeated. An empty table gives an empty result.
    """
    spark: SparkSession = session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    body = texts(docs, id_col, text_col).select("text", "doc_id")
    counts = word_counts(body)
    vocabulary = vocabulary_of(counts)
    shares, bound = shares_of(counts, vocabulary[0], at_hand)
    vocabulary, shares = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(shares)
    flat = Net.fresh().flat
    for r in range(rounds):
        own = body.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).select("text")
        weights = spark.sparkContext.broadcast(flat)
        sums = own.mapInArrow(_train(weights, vocabulary), "place int, total long")
        sums = sums.groupBy("place").agg(F.sum("total").alias("total")).toArrow().sort_by("place")  # SIZE + 1 rows
        if len(sums):
            total = sums["total"].to_numpy()
            flat = (total[1:] * GRAIN / total[0]).astype(np.float32)
    weights = spark.sparkContext.broadcast(flat)
    body = body.select("text", "doc_id", F.xxhash64("text").alias("text_key"))
    scored = body.mapInArrow(
        _score(weights, vocabulary, shares),
        f"doc_id {kind}, text_key long, n_words long, log_prob double, far array<long>",
    )
    scored = written(scored, "scored")
    # What rarer words lack is a sum over a text's words, so equal texts need it once.
    far = scored.filter(F.size("far") > 0).select("text_key", "far").dropDuplicates(["text_key"])
    rare = counts.filter(F.col("n") <= bound).select(F.col("word").alias("far_word"), "n")
    far = far.select("text_key", F.explode("far").alias("word")).join(rare, F.col("word") == F.col("far_word"))
    grains = F.round(F.log("n") / GRAIN).cast("long")  # integers, so their order doesn't matter
    far = far.groupBy("text_key").agg(F.sum(grains).alias("grains")).withColumnRenamed("text_key", "far_key")
    out = scored.drop("far").join(far, F.col("text_key") == F.col("far_key"), "left")
    log_prob = F.col("log_prob") + F.coalesce("grains", F.lit(0)) * F.lit(GRAIN)
    return out.select("doc_id", "n_words", log_prob.alias("log_prob"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return out.select("doc_id", "n_words", F.round("log_prob", 6).alias("log_prob"), F.round(mean, 6).alias("mean_log_prob"))
