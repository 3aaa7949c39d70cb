"""Mixing sources to target weights by Pareto order sampling.

A document is due copies in proportion to its measure, which grows with its size up
to twice that of a document of its source's mean size, and at most `most` copies;
the rate is such that the words of these copies are the source's target. The whole
part is certain; the fraction is the inclusion probability p of one copy more.
Documents are ranked by Q = U/(1-U) : p/(1-p) with U a hash of the id, and the
smallest Q are taken until the source's words reach what its target still lacks: a
sample of fixed size, measured in words, with unequal probabilities. The last place
goes to the document, of those not taken, whose size fits the remainder best.

The cut in the order is found without sorting a source: words are summed over
4096 ranges of the rank, then over 4096 parts of the range in which the cut
falls, and only the documents of that part are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, written

PARTS = 4096
_SIZE = r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"


def targets(sizes: Sequence[tuple], weights: Sequence[float], most: float, total: float | None = None) -> list[float]:
    """Words due from each (source, size): weighted shares of the total, none above most times its size.

    What a source can't give is shared again by weight among those that can. A
    source without words is due none; if all are full the total isn't reached.
    """
    if total is None:
        total = sum(s for _, s in sizes)
    share = {i: float(weights[i % len(weights)]) for i, (_, s) in enumerate(sizes) if s}
    out = [0.0] * len(sizes)
    left = float(total)
    while share:
        unit = left / sum(share.values())
        full = [i for i, w in share.items() if w * unit > most * sizes[i][1]]
        if not full:
            for i, w in share.items():
                out[i] = w * unit
            break
        for i in full:
            out[i] = float(most * sizes[i][1])
            left -= out[i]
            del share[i]
    return out


#: A document's measure, in 65536ths of that of one of its source's mean size: 2 s / (s + mean).
MEASURE = "if(size = 0, 0, greatest(1, cast(floor(131072D * size * n / (cast(size as double) * n + source_size)) as bigint)))"
BINS = 512


def _rates(measured: DataFrame, most: float) -> DataFrame:
    """(r_src, rate): copies due for a measure of one, such that the words of least(most, rate * m) are the target.

    The documents at the most are found by ranges of the measure. All sums are of
    integers, so reruns give the same rates.
    """
    width = (2 << 16) // BINS
    sums = measured.filter("size > 0").groupBy("src", "target", F.expr(f"cast(m div {width} as int)").alias("bin")).agg(
        F.sum(F.col("size").cast("decimal(38,0)")).alias("s"), F.sum(F.expr("cast(size as decimal(19,0)) * cast(m as decimal(19,0))")).alias("t")
    )
    whole = Window.partitionBy("src")
    above = whole.orderBy(F.desc("bin"))
    run = above.rowsBetween(Window.unboundedPreceding, -1)
    tried = sums.select(
        "src", "target", "bin",
        F.coalesce(F.sum("s").over(run), F.lit(0)).cast("double").alias("at_most"),
        (F.sum("t").over(whole) - F.coalesce(F.sum("t").over(run), F.lit(0))).cast("double").alias("below"),
    )
    # Documents of higher ranges are at the most, those of this one and lower are not.
    rate = F.expr(f"(target - {most} * at_most) / below")
    fits = tried.withColumn("rate", rate).filter(f"rate * ((bin + 1) * {width}) <= {most} or bin = 0")
    best = fits.groupBy("src").agg(F.max(F.struct("bin", "rate")).alias("b"))
    return best.select(F.col("src").alias("r_src"), F.expr("b.rate").alias("rate"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3,
    seed: int = 7,
) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, copies: a row per row of docs.

    Sources are ordered by code point, null last; weights repeat along them. A
    null text has size 0; documents of size 0 are given the whole copies of their
    source and no other. Rows alike in id, source and text are one in the order and
    are taken together. A null id has a rank as any other. The number of sources
    is taken to fit the driver; one row each is gathered. An empty table gives an
    empty result, and reruns give the same copies.
    """
    spark: SparkSession = session(docs)
    body = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), docs[text_col].alias("text"))
    u = f"(shiftrightunsigned(xxhash64({seed}, cast(doc_id as string), text_key), 11) + 0.5D) / 9007199254740992D"
    body = body.withColumn("text_key", F.xxhash64("text"))
    sized = written(
        body.select("doc_id", "source", "text_key", F.expr(f"cast(coalesce({_SIZE}, 0) as bigint)").alias("size"), F.expr(u).alias("u")),
        "sizes",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n")).collect()
    sums = sorted(((r["source"], r["size"], r["n"]) for r in sums), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    due = targets([r[:2] for r in sums], weights, most)
    plan = spark.createDataFrame(
        [(*r, t) for r, t in zip(sums, due, strict=True)], "src string, source_size long, n long, target double"
    )
    measured = sized.join(plan, F.col("source").eqNullSafe(F.col("src"))).withColumn("m", F.expr(MEASURE))
    rates = written(_rates(measured, most), "rates")
    ranked = measured.join(rates, F.col("src").eqNullSafe(F.col("r_src")), "left").withColumn(
        "due", F.expr(f"case when target >= {most} * source_size then {most} else least({most}, greatest(0, coalesce(rate * m, 0))) end")
    )
    ranked = ranked.withColumn("due", F.expr("if(size = 0, if(source_size = 0, 0, target / source_size), cast(due as double))"))
    ranked = ranked.withColumn("whole", F.floor(F.col("due") + 1e-9)).withColumn(
        "p", F.expr("if(due - whole < 1e-9, 0, due - whole)")
    )
    certain = ranked.groupBy("src", "target").agg(F.sum(F.col("whole") * F.col("size")).alias("w"))
    certain = written(certain.select(F.col("src").alias("l_src"), F.expr("greatest(0, target - w)").alias("lacks")), "lacks")
    ranked = ranked.join(certain, F.col("src").eqNullSafe(F.col("l_src")), "left").drop("l_src", "r_src", "rate")
    # q is Q / (1 + Q), which has the same order and lies between 0 and 1.
    ranked = ranked.withColumn("q", F.expr("u * (1 - p) / (u * (1 - p) + p * (1 - u))"))
    can = ranked.filter("size > 0 and lacks > 0 and p > 0").withColumns(
        {"part": F.floor(F.col("q") * PARTS), "sub": F.floor(F.col("q") * PARTS * PARTS) % PARTS}
    )

    def cut(df: DataFrame, by: str, before: str) -> DataFrame:
        """src and the part in which the running words pass what is lacking, with the words before it."""
        sums = df.groupBy("src", by, "lacks").agg(F.sum("size").alias("w"), F.max(F.expr(before)).alias("base"))
        run = Window.partitionBy("src").orderBy(by)
        sums = sums.withColumn("upto", F.col("base") + F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        at = sums.filter("upto > lacks").groupBy("src").agg(F.min(F.struct(by, F.expr("upto - w").alias("before"))).alias("c"))
        return at.select(F.col("src").alias("c_src"), F.col(f"c.{by}").alias(f"c_{by}"), F.col("c.before").alias(f"{by}_before"))

    first = written(cut(can, "part", "0.0D"), "cut")
    same = F.col("src").eqNullSafe(F.col("c_src"))
    in_part = can.join(first, same & (F.col("part") == F.col("c_part"))).drop("c_src")
    second = written(cut(in_part, "sub", "part_before"), "cut")
    in_sub = in_part.join(second, same & (F.col("sub") == F.col("c_sub"))).drop("c_src")
    order = Window.partitionBy("src").orderBy("q", "doc_id", "text_key")
    upto = F.col("sub_before") + F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, 0))
    over = in_sub.withColumn("upto", upto).filter("upto > lacks").groupBy("src").agg(
        F.min(F.struct("q", "doc_id", "text_key", F.expr("upto - size").alias("before"))).alias("c")
    )
    over = written(
        over.select(F.col("src").alias("o_src"), F.col("c.q").alias("o_q"), F.struct("c.doc_id", "c.text_key").alias("o_id"), F.col("c.before").alias("o_before")),
        "over",
    )
    # With no cut the words of all that can be taken don't pass what is lacking: all are taken.
    taken = F.expr("o_src_seen is null or q < o_q or (q = o_q and struct(doc_id, text_key) < o_id)")
    over = over.withColumn("o_src_seen", F.lit(True))
    held = can.join(over, F.col("src").eqNullSafe(F.col("o_src")), "left").withColumn("in", taken)
    fits = (
        held.filter("not in and abs(lacks - o_before - size) < lacks - o_before")
        .groupBy("src")
        .agg(F.min(F.struct(F.expr("abs(lacks - o_before - size)").alias("gap"), "q", "doc_id", "text_key")).alias("f"))
        .select(F.col("src").alias("f_src"), F.col("f.q").alias("f_q"), F.struct("f.doc_id", "f.text_key").alias("f_id"))
    )
    fits = written(fits, "fits")
    done = (
        ranked.join(over, F.col("src").eqNullSafe(F.col("o_src")), "left")
        .join(fits, F.col("src").eqNullSafe(F.col("f_src")), "left")
        .withColumn("extra", F.col("p").__gt__(0) & (F.col("lacks") > 0) & (F.col("size") > 0) & (taken | F.expr("coalesce(q = f_q and struct(doc_id, text_key) <=> f_id, false)")))
    )
    copies = (F.col("whole") + F.when(F.col("extra"), 1).otherwise(0)).cast("long")
    return done.select("doc_id", "text_key", "source", "size", "source_size", "target", copies.alias("copies"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with its columns and copy (from 1)."""
    shares = mix(docs).filter("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("source").alias("_source"), F.col("copies").alias("_copies")
    ).distinct()
    same = (
        (F.xxhash64(docs["text"]) == shares["_key"])
        & docs["doc_id"].eqNullSafe(shares["_id"])
        & docs["source"].eqNullSafe(shares["_source"])
    )
    out = docs.join(shares, same).select(*(docs[c] for c in docs.columns), F.explode(F.expr("sequence(1, _copies)")).alias("copy"))
    return out
