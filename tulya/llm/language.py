"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character 1- to 3-grams of the lower-cased text,
hashed to 2**16 places. Document frequencies come from every document that may be
learned from; the weights are fitted on a bounded sample of labelled rows, spread
over all of them by a hash and evenly over languages, by follow-the-regularised-
leader with elastic-net penalties, whose L1 part leaves most weights at zero. One
temperature, fitted on sampled rows that the fit didn't see, makes the scores
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import session, texts, written

PLACES = 1 << 16
ORDERS = (1, 2, 3)
#: Rows that the weights are fitted on, at most; a quarter of them only sets the temperature.
TRAIN_ROWS = 2400
#: Characters worked on at a time; a longer text is a piece of its own.
_PIECE = 1 << 20
#: Label of texts that have no letter.
UNKNOWN = "und"


def _pieces(values: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, code points and offsets of runs of lower-cased texts."""
    at = 0
    while at < len(values):
        some, size, start = [], 0, at
        while at < len(values) and (not some or size < _PIECE):
            some.append((values[at] or "").lower())
            size += len(some[-1])
            at += 1
        joined = "".join(some).encode("utf-32-le", "surrogatepass")
        yield start, np.frombuffer(joined, np.uint32), np.cumsum([0, *(len(x) for x in some)])


def _places(chars: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of the texts, text by text, and each text's first (one more than texts).

    A text ends in as many blanks as the longest n-gram has characters. N-grams
    start at its characters and at the first of these blanks, so none reaches the
    next text: a text's n-grams depend on nothing else.
    """
    n, pad = len(off) - 1, max(ORDERS)
    size = np.diff(off)
    starts = np.concatenate([[0], np.cumsum(size + pad)])
    framed = np.full(starts[-1] + pad, 32, np.uint64)
    framed[np.arange(len(chars)) + pad * np.repeat(np.arange(n), size)] = chars
    first = np.concatenate([[0], np.cumsum(size + 1)])
    at = np.arange(first[-1]) + (pad - 1) * np.repeat(np.arange(n), size + 1)
    out = np.empty((len(at), len(ORDERS)), np.int64)
    for j, order in enumerate(ORDERS):
        key = np.full(starts[-1], order, np.uint64)
        for i in range(order):
            key = (key ^ framed[i : i + starts[-1]]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out[:, j] = ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48))[at]
    return out.ravel(), first * len(ORDERS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(PLACES + 1, np.int64)  # the last counts documents
    last = np.zeros(PLACES, np.int64)
    for batch in batches:
        for _, chars, off in _pieces(batch.column(0).to_pylist()):
            places, first = _places(chars, off)
            for i in range(len(off) - 1):
                own = places[first[i] : first[i + 1]]
                count = np.arange(len(own))
                last[own] = count
                total[own[last[own] == count]] += 1  # each place once
            total[-1] += len(off) - 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "n"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, chars, off in _pieces(batch.column(1).to_pylist()):
            places, first = _places(chars, off)
            for i in range(len(off) - 1):
                own, n = np.unique(places[first[i] : first[i + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start + i : start + i + 1], pa.array([own.astype(np.int32)], pa.list_(pa.int32())),
                     pa.array([(n / n.sum()).astype(np.float32)], pa.list_(pa.float32()))],
                    ["lang", "places", "shares"])


class Model:
    """Languages, idf-weighted coefficients (places x languages), bias and temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def logits(self, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bias plus the mean coefficient of each text's n-grams: TF is a share, so the sum is a mean."""
        n = np.diff(first)
        out = np.zeros((len(n), len(self.langs)))
        for c in range(len(self.langs)):
            out[:, c] = np.add.reduceat(self.weights[:, c][places], first[:-1]) / n
        return out + self.bias

    def chances(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(
    rows: list[tuple[int, np.ndarray, np.ndarray]],
    n_langs: int,
    idf: np.ndarray,
    *,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-3,
    epochs: int = 3,
    seed: int = 11,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates over (label, places, shares); weights and bias.

    Features are an n-gram's share of its text times its idf times SCALE.
    """
    z = np.zeros((PLACES + 1, n_langs))
    n = np.zeros((PLACES + 1, n_langs))

    def weights(own: np.ndarray) -> np.ndarray:
        zs = z[own]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[own])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, places, shares = rows[i]
            own = np.append(places, PLACES)
            x = np.append(shares * idf[places] * SCALE, 1.0)
            w = weights(own)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p
            squared = g * g
            sigma = (np.sqrt(n[own] + squared) - np.sqrt(n[own])) / alpha
            z[own] += g - sigma * w
            n[own] += squared
    every = weights(np.arange(PLACES + 1))
    return every[:-1], every[-1]


#: Shares of n-grams are small numbers; this brings TF-IDF values near one.
SCALE = 50.0


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least mean negative log-likelihood, by golden-section search on its log."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(
    labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS
) -> Model | None:
    """A model of the rows' languages; None if no row has a language.

    Rows without a language or text don't count. Document frequencies are of all
    others; at most train_rows of them give the weights: of each language those of
    the smallest hashes, an equal number where there are so many. Rows alike in text
    and language are one there, so a large group of copies can't fill the sample.
    """
    rows = labelled.select(labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).dropna()
    different = F.approx_count_distinct(F.xxhash64("text"))
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(different.alias("n")).collect()}
    if not per_lang:
        return None
    langs = sorted(per_lang)
    found = rows.select("text").mapInArrow(_frequencies, "place long, n long")
    found = found.groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # PLACES + 1 rows at most
    df = np.zeros(PLACES + 1)
    df[found["place"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    each = max(1, train_rows // len(langs))
    share = F.create_map(*(x for k, n in per_lang.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * each / n)))))
    by = F.xxhash64("text")
    span = 1 << 30
    some = rows.filter(F.pmod(by, F.lit(span)) < F.element_at(share, F.col("lang")) * span)
    # About twice what is needed, and a bounded number of rows but for copies, which fold into one.
    some = some.dropDuplicates(["text", "lang"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(by, "text"))
    some = some.withColumn("rank", rank).filter(F.col("rank") <= each).drop("rank")
    sample = written(some, "train").mapInArrow(
        lambda batches: _counts(pa.RecordBatch.from_arrays([b.column(1), b.column(0)], ["lang", "text"]) for b in batches),
        "lang string, places array<int>, shares array<float>",
    )
    sample = sample.toArrow()
    data = [
        (langs.index(label), np.asarray(p), np.asarray(s, dtype=np.float64))
        for label, p, s in zip(sample["lang"].to_pylist(), _lists(sample["places"]), _lists(sample["shares"]), strict=True)
    ]
    data.sort(key=lambda r: (len(r[1]), r[0], r[1].tobytes(), r[2].tobytes()))
    order = np.random.default_rng(3).permutation(len(data))
    held = [data[i] for i in order[: len(data) // 4]]
    weights, bias = fit([data[i] for i in order[len(data) // 4 :]], len(langs), idf)
    model = Model(langs, (weights * idf[:, None] * SCALE).astype(np.float32), bias)
    if held:
        first = np.concatenate([[0], np.cumsum([len(p) for _, p, _ in held])])
        every, shares = np.concatenate([p for _, p, _ in held]), np.concatenate([s for _, _, s in held])
        logits = np.add.reduceat(model.weights[every] * shares[:, None], first[:-1], axis=0) + bias
        model.temperature = temperature(logits, np.array([label for label, _, _ in held]))
    return model


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        off, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    return out


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*model.value) if model.value else None
        for batch in batches:
            values = batch.column(0).to_pylist()
            for start, chars, off in _pieces(values):
                n = len(off) - 1
                names, score = [UNKNOWN] * n, np.zeros(n)
                if known:
                    places, first = _places(chars, off)
                    p = known.chances(known.logits(places, first))
                    best = p.argmax(axis=1)
                    for i in range(n):
                        text = values[start + i]
                        if text and any(map(str.isalpha, text)):
                            names[i], score[i] = known.langs[best[i]], p[i, best[i]]
                rest = [c[start : start + n] for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(names), pa.array(score)], [*batch.schema.names[1:], "lang_pred", "score"]
                )

    return run


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, lang_pred, score: a row per row of docs.

    `und` with score 0 where the text is null or has no letter, or nothing could
    be learned; else the likeliest language and its calibrated probability. With
    one language learned its score is 1. Only the text is looked at. An empty
    table gives an empty result.
    """
    spark = session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = (model.langs, model.weights, model.bias, model.temperature) if model else None
    shared = spark.sparkContext.broadcast(plain)  # data only: executors may lack the class
    body = texts(docs, id_col, text_col).select("text", "doc_id", F.xxhash64("text").alias("text_key"))
    return body.mapInArrow(_predict(shared), f"doc_id {kind}, text_key long, lang_pred string, score double")


def held_out(id_col: str) -> F.Column:
    """Documents never learned from: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out("doc_id")))
    out = identify(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Documents whose language is told with at least that probability, with all their columns."""
    model = train(docs.filter(~held_out("doc_id")))
    told = identify(docs, model).filter(F.col("score") >= least).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = docs["doc_id"].eqNullSafe(told["_id"]) & (F.xxhash64(docs["text"]) == told["_key"])
    return docs.join(told, same, "left_semi")
