"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model is of character n-grams (order 4) over all characters of trusted text;
characters that it lacks share one further symbol at the lowest order. Counts of
trusted documents are kept as tables sharded by n-gram, and so are the orders
below, totals by context and probabilities. Documents meet them by joins: in
blocks of some megabytes each gives its distinct n-grams, these are joined with
the model, and a block's texts are scored with what comes back. Nothing of the
model is gathered but four numbers an order. Each language has a cut of its own:
a quantile of the perplexities of its trusted documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import bitmap_table, free, maybe_in, session, tidy, written

ORDER = 4
#: Stands before and after a text; U+FDD0 is no character. In a text it is read as U+FFFD, and so is U+0000.
EDGE = 0xFDD0
#: Bytes of text scored together, unless one text alone has more; n-grams handled at a time.
BLOCK = 8 << 20
CHUNK = 1 << 22
#: Parts that blocks are scored in, one after the other: so much less of their shuffle is on disk at a time.
PARTS = 8
#: Perplexities that a language's cut lies above, as a share of its trusted documents.
QUANTILE = 0.97


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about BLOCK bytes of their first column."""
    held, size = [], 0
    for batch in batches:
        ends = K.buffers(batch.column(0))[1] + 16 * np.arange(batch.num_rows + 1)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(ends, ends[at] + BLOCK - size, side="right")) - 1
            if end <= at and not held:
                end = at + 1
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(ends[end] - ends[at])
                at = end
            if at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Grams:
    """The n-grams that end at each character of each text and at its end, as numbers of this block.

    ORDER - 1 edges stand before a text, one after it. Runs of blanks are one space.
    """

    def __init__(self, column: pa.Array):
        data, off = K.buffers(column)
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
        symbols = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        symbols[(symbols >= 0x09) & (symbols <= 0x0D)] = 0x20
        symbols[(symbols == 0) | (symbols == EDGE)] = 0xFFFD
        keep = np.ones(len(symbols), dtype=bool)
        keep[1:] = (symbols[1:] != 0x20) | (symbols[:-1] != 0x20)
        keep[first[:-1][first[:-1] < len(symbols)]] = True
        left = np.concatenate([[0], np.cumsum(keep)])[first]
        symbols = symbols[keep]
        n = len(first) - 1
        framed = np.full(len(symbols) + ORDER * n, EDGE, np.uint32)
        framed[np.arange(len(symbols)) + ORDER - 1 + ORDER * np.repeat(np.arange(n), np.diff(left))] = symbols
        #: N-grams of each text, and whether one that starts at a place lies in one text.
        self.counts = np.diff(left) + 1
        self.inside = np.ones(len(framed) - ORDER + 1, dtype=bool)
        after = np.cumsum(np.diff(left) + ORDER)[:-1]
        for i in range(1, ORDER):
            self.inside[after - i] = False
        self.alphabet = np.unique(framed)
        self.base = len(self.alphabet)
        codes = np.zeros(int(self.alphabet[-1]) + 1, np.int64)
        codes[self.alphabet] = np.arange(self.base)
        self.codes = codes[framed]
        self.pairs = None
        if self.base**ORDER >= 1 << 63:  # numbers of pairs instead, of which there are fewer than places
            both = self.codes[:-1] * self.base + self.codes[1:]
            self.pairs = np.unique(both)
            self.codes = np.searchsorted(self.pairs, both)

    def numbers(self) -> Iterator[np.ndarray]:
        """One number for each n-gram, in order of place, by chunks; n-grams differ if and only if their numbers do."""
        for at in range(0, len(self.inside), CHUNK):
            end = min(at + CHUNK, len(self.inside))
            if self.pairs is not None:
                number = self.codes[at:end] * len(self.pairs) + self.codes[at + 2 : end + 2]
            else:
                number = self.codes[at:end].copy()
                for i in range(1, ORDER):
                    number *= self.base
                    number += self.codes[at + i : end + i]
            yield number[self.inside[at:end]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct numbers in ascending order, and how often each occurs."""
        parts = [np.unique(number, return_counts=True) for number in self.numbers()]
        some, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return some, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def strings(self, numbers: np.ndarray) -> pa.Array:
        if self.pairs is not None:
            halves = [self.pairs[numbers // len(self.pairs)], self.pairs[numbers % len(self.pairs)]]
            codes = [c for half in halves for c in (half // self.base, half % self.base)]
        else:
            codes = [numbers // self.base ** (ORDER - 1 - i) % self.base for i in range(ORDER)]
        points = np.ascontiguousarray(self.alphabet[np.stack(codes, axis=1)].astype("<u4"))
        return pa.array(points.view(f"<U{ORDER}").ravel(), pa.string())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        grams = Grams(block.column(0))
        some, n = grams.distinct()
        yield pa.RecordBatch.from_arrays([grams.strings(some), pa.array(n)], ["gram", "n"])


def _packed(block: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(block)
    return sink.getvalue().to_pybytes()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts under random names, which are theirs once this has been written."""
    for block in _blocks(batches):
        name = uuid.uuid4().int >> 65
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([_packed(block)], pa.binary())], ["block", "packed"])


def _unpacked(packed: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks().to_batches()[0]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            grams = Grams(_unpacked(packed).column(0))
            some, _ = grams.distinct()
            for at in range(0, len(some), 50_000):
                part = some[at : at + 50_000]
                place = np.arange(at, at + len(part), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), name)), pa.array(place), grams.strings(part)], ["block", "place", "gram"]
                )


def _score(texts: pa.Table, logs: pa.Table) -> pa.Table:
    """The texts of one block, scored with the log-probabilities of its n-grams."""
    block = _unpacked(texts["packed"][0])
    grams = Grams(block.column(0))
    some, _ = grams.distinct()
    own = np.empty(len(some))
    own[logs["place"].to_numpy()] = logs["log"].to_numpy()
    ends = np.cumsum(grams.counts)
    total, at = np.zeros(len(ends)), 0
    for number in grams.numbers():
        value = own[np.searchsorted(some, number)]
        row = int(np.searchsorted(ends, at, side="right"))
        last = int(np.searchsorted(ends, at + len(value), side="left"))
        starts = np.concatenate([[0], ends[row:last] - at])
        if len(value):
            total[row : last + 1] += np.add.reduceat(value, starts)
        at += len(value)
    return pa.Table.from_arrays(
        [*block.columns[1:], pa.array(grams.counts.astype(np.int64)), pa.array(2.0 ** (-total / grams.counts))],
        [*block.schema.names[1:], "n_symbols", "perplexity"],
    )


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D for counts of 1, 2 and 3 or more, by Chen and Goodman's estimates; kept between a twentieth of the count and the count, so
    something is always left for what wasn't seen."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), start=1):
        d.append(min(max(k - (k + 1) * y * b / a, 0.05 * k), float(k)) if a else k * 0.5)
    return d


def kneser_ney(counts: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """From (gram, n), the counts of ORDER symbols: a function from distinct grams to (gram, p), p(last | the others).

    The highest order uses counts, lower ones the number of distinct symbols seen
    before, each interpolated with the next lower; the lowest with a uniform choice
    of the symbols seen and one for all others.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        levels[k] = written(shorter, f"order{k}")
    cuts = {}
    for k, level in levels.items():
        with tidy(session(counts)):
            cuts[k] = discounts(*level.agg(*(F.count_if(F.col("n") == i) for i in range(1, 5))).first())
    with tidy(session(counts)):
        symbols = levels[1].count() + 1

    def cells(k: int) -> DataFrame:
        d1, d2, d3 = cuts[k]
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        return levels[k].select(F.col("gram").alias("cell"), F.greatest(F.col("n") - cut, F.lit(0.0)).alias("left"))

    def contexts(k: int) -> DataFrame:
        few = [F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") > 2)]
        saved = sum((F.lit(d) * n for d, n in zip(cuts[k], few, strict=True)), F.lit(0.0))
        total = F.sum("n")
        return levels[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(total.alias("total"), (saved / total).alias("saved"))

    def probabilities(grams: DataFrame) -> DataFrame:
        lower = None
        for k in range(1, ORDER + 1):
            own = grams.select("gram") if k == ORDER else grams.select(F.substring("gram", ORDER - k + 1, k).alias("gram")).distinct()
            own = own.join(cells(k), F.col("gram") == F.col("cell"), "left")
            own = own.join(contexts(k), F.substring("gram", 1, k - 1) == F.col("context"), "left")
            if lower is None:
                own = own.withColumn("below", F.lit(1.0 / symbols))
            else:
                own = own.join(lower, F.substring("gram", 2, k - 1) == F.col("suffix"))
            p = F.coalesce(F.col("left") / F.col("total"), F.lit(0.0)) + F.coalesce("saved", F.lit(1.0)) * F.col("below")
            lower = own.select(F.col("gram").alias("suffix"), p.alias("below"))
        return lower.select(F.col("suffix").alias("gram"), F.col("below").alias("p"))

    return probabilities


def _held_back(id_col: str) -> F.Column:
    """One trusted document in five sets the cuts and isn't counted, for the model flatters what it has counted."""
    return F.pmod(F.xxhash64(id_col), F.lit(5)) == 0


def perplexity_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_id_col: str = "doc_id",
    quality_col: str = "quality",
    quantile: float = QUANTILE,
) -> DataFrame:
    """doc_id, lang, trusted, n_symbols, perplexity, cut, kept: a row per row of docs.

    Trusted are documents labelled with a quality above 0. Four in five of them
    are counted, the others (all, in a language that has none of these) give their
    language's cut, a quantile of their perplexities. A document is kept if its
    perplexity isn't above the cut; a null language is one of its own. A language without trusted documents takes the quantile over all trusted
    ones; without any, all is kept. An empty or null text holds its end only.
    Documents labelled more than once are trusted if one label says so. Rows with
    a null id are never trusted. An empty table gives an empty result. Texts of any
    length are read whole, a very long one as a block of its own. Other columns of
    docs and labels are left out, whatever their names. The texts are written once, in
    blocks, so docs may give its rows in any order.
    """
    spark: SparkSession = session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    body = docs.select(docs[text_col].alias("text"), docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"))
    good = labels.filter(labels[quality_col] > 0).select(labels[label_id_col].alias("good_id")).dropna().distinct()
    good = written(good, "trusted")
    # The bitmap keeps most other texts out of the join, which then is exact.
    counted = good.filter(~_held_back("good_id"))
    keys = bitmap_table(counted.select(F.xxhash64("good_id").alias("key")))
    near = maybe_in(body.select("text", "doc_id", F.xxhash64("doc_id").alias("key")), "key", keys)
    source = near.join(counted, F.col("doc_id") == F.col("good_id"), "left_semi").select("text")
    source = written(source, "source")

    counts = source.mapInArrow(_count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    model = kneser_ney(written(counts, "counts"))
    free(source)
    # Written once, so both uses below have the same blocks, however docs gives its rows.
    part = F.pmod("block", F.lit(PARTS)).cast("int").alias("part")
    blocks = written(body.mapInArrow(_pack, "block long, packed binary").select("block", "packed", part), "blocks", "part")
    own = written(blocks.select("block", "packed").mapInArrow(_distinct, "block long, place int, gram string"), "grams")
    seen = written(own.select("gram").distinct(), "seen")
    # Written before its join, so that Spark can split the commonest n-grams, which every block has.
    logs = written(model(seen).select("gram", F.log2("p").alias("log")), "logs")
    logs = written(own.join(logs, "gram").select("block", "place", "log", part), "block-logs", "part")
    free(own, seen)
    # Texts are shuffled to their probabilities a part at a time, and a part's shuffle goes before the next.
    done = []
    for i in range(PARTS):
        texts_, own_logs = (df.filter(F.col("part") == i).drop("part").groupBy("block") for df in (blocks, logs))
        scores = texts_.cogroup(own_logs).applyInArrow(_score, f"doc_id {kind}, lang string, n_symbols long, perplexity double")
        done.append(written(scores, "scored"))
    scored = functools.reduce(DataFrame.union, done)
    free(logs, blocks)
    trusted = scored.join(good, F.col("doc_id") == F.col("good_id"), "left").withColumn("trusted", F.col("good_id").isNotNull())
    trusted = written(trusted.drop("good_id"), "judged")
    q = F.expr(f"percentile_approx(perplexity, {quantile}, 100000)")
    held, lang = trusted.filter(F.col("trusted") & _held_back("doc_id")), F.col("lang")
    of_lang = held.groupBy(lang.alias("l")).agg(q.alias("own"))
    of_counted = trusted.filter("trusted").groupBy(lang.alias("m")).agg(q.alias("counted"))
    of_all = trusted.filter("trusted").agg(q.alias("every"))
    out = trusted.join(of_lang, lang.eqNullSafe(F.col("l")), "left").join(of_counted, lang.eqNullSafe(F.col("m")), "left")
    out = out.crossJoin(F.broadcast(of_all)).withColumn("cut", F.coalesce("own", "counted", "every"))  # one row
    kept = F.col("cut").isNull() | (F.col("perplexity") <= F.col("cut"))
    return out.select("doc_id", "lang", "trusted", "n_symbols", "perplexity", "cut", kept.alias("kept"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity_verdicts(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )
    return out.select("doc_id", "n_symbols", "perplexity", "cut", "kept")
