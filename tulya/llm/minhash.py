"""Near-duplicate documents by b-bit MinHash.

Each document gets 128 minima over its word shingles. Bands of minima propose
candidates; of each minimum only the low two bits are kept, packed into four
longs, and the bits that two signatures share give a collision-corrected
estimate of their similarity. Pairs that survive it are confirmed on full sets.

Groups of copies never become pairs of their members. Equal sets fold into one
class first. In each band bucket every class is paired with the bucket's
smallest id only, which joins the usual group. Buckets that still hold classes of
several components go through an exact prefix-filtered join between components:
a class whose rarest shingles nobody shares has no partner and costs no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import bitmap, components, free, session, texts, written

MINIMA = 128
BITS = 2

_rng = np.random.default_rng(77)
_A = _rng.integers(0, 2**63, MINIMA, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.int64).astype(np.uint64)

_SIGNED = "doc_id long, n long, set_a long, set_b long, bands array<long>, bits array<long>"


def rows_per_band(similarity: float, miss: float = 1e-6) -> int:
    """The most selective band width that overlooks a pair at the threshold at most so often."""
    fits = [r for r in range(1, 9) if (1 - similarity**r) ** (MINIMA // r) <= miss]
    return max(fits, default=1)


def least_estimate(similarity: float, deviations: float = 5.0) -> float:
    """An estimate below this is that many standard deviations under the threshold."""
    chance = 0.5**BITS
    equal = chance + (1 - chance) * similarity
    return similarity - deviations * math.sqrt(equal * (1 - equal) / MINIMA) / (1 - chance)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row of a piece, and each row's distinct shingle hashes in order."""
    for start, _, data, off in K.pieces(column):
        w = K.Words(data, off, K.BLANK_WORDS)
        hashes = w.hashes()
        at, keys = K.shingles(w, hashes, k)
        cut = np.searchsorted(at, w.first)
        out = []
        for i, n in enumerate(w.counts()):
            if n >= k:
                part = np.sort(keys[cut[i] : cut[i + 1]])
                out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
            elif n:
                whole = K.Words(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), K.BLANK_WORDS)
                out.append(K.shingles(whole, whole.hashes(), int(n))[1])
            else:
                out.append(keys[:0])
        yield start, out


def _longs(values: np.ndarray) -> pa.Array:
    """A two-dimensional array as lists of longs."""
    n, width = values.shape
    flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), flat)


def _sign(k: int, per_band: int):
    bands = MINIMA // per_band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, sets in _sets(batch.column(1), k):
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                minima = np.zeros((len(sets), MINIMA), np.uint64)
                digest = np.zeros((2, len(sets)), np.uint64)
                if len(some):
                    every = np.concatenate([sets[i] for i in some])
                    at = np.cumsum(n[some]) - n[some]
                    for j in range(MINIMA):
                        minima[some, j] = np.minimum.reduceat(every * _A[j] + _B[j], at)
                    digest[0, some] = np.bitwise_xor.reduceat(K.mix(every + _B[0]), at)
                    digest[1, some] = np.add.reduceat(K.mix(every + _B[1]), at)
                keys = np.zeros((len(sets), bands), np.uint64)
                for j in range(bands):
                    key = np.full(len(sets), j + 1, np.uint64)
                    for r in range(per_band):
                        key = K.mix(key * _A[0] + minima[:, j * per_band + r])
                    keys[:, j] = key
                low = minima & np.uint64(2**BITS - 1)
                packed = np.zeros((len(sets), MINIMA * BITS // 64), np.uint64)
                for j in range(MINIMA):
                    packed[:, j * BITS // 64] |= low[:, j] << np.uint64(j * BITS % 64)
                rows = slice(start, start + len(sets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(n.astype(np.int64)), pa.array(digest[0].view(np.int64)),
                     pa.array(digest[1].view(np.int64)), _longs(keys), _longs(packed)],
                    ["doc_id", "n", "set_a", "set_b", "bands", "bits"])

    return run


def _full_sets(k: int, wanted):
    """Sets of the rows whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = batch.column(2).to_numpy().view(np.uint64)
            rows = np.flatnonzero(K.bitmap_has(wanted.value, hashed))
            batch = batch.take(pa.array(rows))
            for start, sets in _sets(batch.column(1), k):
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                ends = np.cumsum([0, *(len(s) for s in sets)])
                digest = [np.zeros(len(sets), np.uint64) for _ in range(2)]
                for i, s in enumerate(sets):
                    if len(s):
                        digest[0][i] = np.bitwise_xor.reduce(K.mix(s + _B[0]))
                        digest[1][i] = np.add.reduce(K.mix(s + _B[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start : start + len(sets)], pa.array(digest[0].view(np.int64)),
                     pa.array(digest[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    ["id", "a", "b", "items"])

    return run


def _equal_bits(x: str, y: str) -> str:
    """SQL: how many packed minima two signatures share."""
    longs = MINIMA * BITS // 64
    differ = " + ".join(
        f"bit_count((({x}[{i}] ^ {y}[{i}]) | shiftrightunsigned({x}[{i}] ^ {y}[{i}], 1)) & 6148914691236517205L)"
        for i in range(longs)
    )
    return f"({MINIMA} - ({differ}))"


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) of class ids those whose sets are similar enough; estimates come first."""
    chance = 0.5**BITS
    least = math.ceil(MINIMA * (chance + (1 - chance) * least_estimate(percent / 100)))
    small = reps.select("rep", "n", "bits")
    near = (
        pairs.join(small.toDF("x", "nx", "bx"), "x")
        .join(small.toDF("y", "ny", "by"), "y")
        .filter(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
        .filter(f"{_equal_bits('bx', 'by')} >= {least}")
        .select("x", "y", "nx", "ny")
    )
    return (
        near.join(sets.toDF("x", "sx"), "x")
        .join(sets.toDF("y", "sy"), "y")
        .withColumn("both", F.size(F.array_intersect("sx", "sy")))
        .filter(f"100 * both >= {percent} * (nx + ny - both)")
        .select("x", "y")
    )


def _between(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of classes in different components that the prefix filter can't rule out.

    Only buckets of three or more classes can hold a pair not yet compared. In
    the order of rarity a set of n shingles needs a shared one among its first
    n - ceil(percent of n) + 1, and two sets need enough left behind the place
    where they meet. Shingles that one class alone has come first and are shared
    with nobody, so they are counted and not joined.
    """
    placed = members.join(roots, members["rep"] == roots["node"], "left").select(
        "key", "rep", F.coalesce("root", "rep").alias("comp")
    )
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"))
    mixed = mixed.filter("lo != hi and c > 2").select("key")
    left = placed.join(mixed, "key", "left_semi").select("rep", "comp").distinct()
    rows = left.join(sets.toDF("rep", "items"), "rep").select("rep", "comp", F.size("items").alias("n"), "items")
    rows = written(rows, "left")
    tokens = rows.select("rep", "comp", "n", F.explode("items").alias("token"))
    # Written, so that the join is one of its own, whose largest keys Spark can split; likewise below.
    shared = written(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    order = F.array_sort(F.collect_list(F.struct("df", "token")))
    prefix = (
        tokens.join(shared, "token")
        .groupBy("rep", "comp", "n")
        .agg(order.alias("in_order"))
        .withColumn("alone", F.col("n") - F.size("in_order"))
        .withColumn("keep", F.expr(f"cast(n - ceil({percent} * n / 100.0) + 1 - alone as int)"))
        .filter("keep > 0")
        .select("rep", "comp", "n", "alone", F.posexplode(F.expr("slice(in_order, 1, keep)")).alias("pos", "t"))
        .select("rep", "comp", "n", (F.col("alone") + F.col("pos")).alias("pos"), F.col("t.token").alias("token"))
    )
    prefix = written(prefix, "prefix")
    by_comp = prefix.groupBy("token", "comp").agg(F.count("*").alias("c"))
    major = (
        by_comp.groupBy("token")
        .agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps"))
        .filter("comps > 1")
        .select("token", F.col("m.comp").alias("major"))
    )
    major = written(major, "major")
    in_mixed = written(prefix.join(major, "token"), "mixed")
    x = in_mixed.filter("comp != major").toDF("token", "x", "cx", "nx", "px", "major")
    y = in_mixed.drop("major").toDF("token", "y", "cy", "ny", "py")
    out = (
        x.join(y, "token")
        .filter("cx != cy and (cy = major or x < y)")
        .filter(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
        .filter(f"least(nx - px, ny - py) * {100 + percent} >= {percent} * (nx + ny)")
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct()
    )
    out = written(out, "between")
    free(rows, shared, prefix, major, in_mixed)
    return out


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of docs.

    Words end at blanks and A-Z count as a-z. A document's set holds its distinct
    shingles of so many words; with fewer words the whole text is the one shingle.
    Documents are linked if 100 * intersection >= percent * union. component_id is
    the smallest id that links reach, itself included.

    Null or blank texts have no shingles, are linked with nothing and are
    components of their own. Rows with equal ids are one node with several sets.
    Rows with a null id are linked with nothing; their component is null. Ids must
    be integers. An empty table gives an empty result.
    """
    spark: SparkSession = session(docs)
    body = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(body.mapInArrow(_sign(shingle, rows_per_band(percent / 100)), _SIGNED), "signed")
    reps = written(
        signed.filter("n > 0 and doc_id is not null")
        .groupBy("set_a", "set_b")
        .agg(F.min(F.struct("doc_id", "n", "bands", "bits")).alias("r"))
        .select("set_a", "set_b", F.col("r.doc_id").alias("rep"), "r.n", "r.bands", "r.bits"),
        "reps",
    )
    keys = reps.select(F.explode("bands").alias("key"), "rep")
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).filter("hub != top")
    hubs = written(hubs, "hubs")
    members = written(keys.join(hubs.select("key", "hub"), "key"), "members")
    in_pairs = members.select(F.xxhash64("rep").alias("key"), F.col("rep").alias("wanted")).distinct()
    wanted = spark.sparkContext.broadcast(bitmap(in_pairs.select("key")))
    found = body.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id"))
    found = found.mapInArrow(_full_sets(shingle, wanted), "id long, a long, b long, items array<long>")
    same = (F.col("id") == F.col("rep")) & (F.col("a") == F.col("set_a")) & (F.col("b") == F.col("set_b"))
    sets = found.join(reps.join(in_pairs, F.col("rep") == F.col("wanted"), "left_semi"), same, "left_semi")
    sets = written(sets.select("id", "items"), "sets")

    star = members.filter("rep != hub").select(F.col("rep").alias("x"), F.col("hub").alias("y")).distinct()
    first = components(_confirmed(star, reps, sets, percent), "x", "y")
    rest = written(_confirmed(_between(members, first, sets, percent), reps, sets, percent), "rest")
    roots = first
    if not rest.isEmpty():
        comp_of = first.withColumnRenamed("node", "n")
        ends = (
            rest.join(comp_of.toDF("x", "rx"), "x", "left")
            .join(comp_of.toDF("y", "ry"), "y", "left")
            .select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"))
        )
        second = components(ends, "x", "y")
        both = first.toDF("node", "mid").join(second.toDF("mid", "top"), "mid", "left")
        roots = both.select("node", F.coalesce("top", "mid").alias("root")).union(
            second.join(first, "node", "left_anti").select("node", "root")
        )
        roots = written(roots.groupBy("node").agg(F.min("root").alias("root")), "roots")
    free(hubs, members, sets, rest)
    classes = reps.select("set_a", "set_b", "rep").join(roots, F.col("rep") == F.col("node"), "left")
    classes = classes.select("set_a", "set_b", F.coalesce("root", "rep").alias("root"))
    in_class = signed.filter("n > 0 and doc_id is not null").select("doc_id", "n", "set_a", "set_b")
    linked = in_class.join(classes, ["set_a", "set_b"]).select("doc_id", "n", "root")
    alone = signed.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("root"))
    return linked.union(alone).toDF("doc_id", "n_shingles", "component_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, shingle=3, percent=85)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id, with all their columns.

    Rows of one id are one document here; those that repeat it word for word go.
    """
    groups = near_duplicates(docs)
    gone = groups.filter("component_id != doc_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti").dropDuplicates(docs.columns)
