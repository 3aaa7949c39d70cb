"""Session and storage helpers shared by the operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is unset a
    local session gets a temporary folder; any other one has to set it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tulya-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A folder not used before, removed when the application ends."""
    path = f"{shared_dir(spark)}/tulya-{what}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: With this, shuffle files go as soon as the query that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """For queries whose results are taken at once: their shuffle files are of no more use and go with them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again; by its last column, if that is named, so that a filter on it reads a part.

    Lineage ends there, so a lost executor costs its running tasks only.
    """
    spark = session(df)
    path = new_path(spark, what)
    out = df.write.option("compression", "zstd")
    with tidy(spark):
        (out.partitionBy(by) if by else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where written tables lie, for free().
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def free(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read any more."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            remove(session(table), path)


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The named columns as doc_id, text and more; whatever else the table has can't clash."""
    return docs.select(
        docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *(docs[c].alias(c) for c in more)
    )


#: At most so many bits of a bitmap are broadcast (16 MB), however many keys there are.
MOST_BITS = 1 << 27
LEAST_BITS = 1 << 20


def _bits_for(keys: DataFrame) -> int:
    with tidy(session(keys)):
        size, n = LEAST_BITS, keys.count()
    while size < 64 * n and size < MOST_BITS:
        size *= 2
    return size


def bitmap(keys: DataFrame):
    """The long column ``key`` as a bitmap of at least 64 bits a key, up to a fixed ceiling.

    A key's low bits are its place, so keys should be hashes. A test against the
    bitmap may be wrongly true, never wrongly false; an exact join has to follow.
    """
    import numpy as np

    size = _bits_for(keys)
    cell, bit = f"shiftrightunsigned(key & {size - 1}L, 6)", "shiftleft(1L, cast(key & 63L as int))"
    with tidy(session(keys)):
        rows = keys.groupBy(F.expr(cell).alias("cell")).agg(F.bit_or(F.expr(bit)).alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[rows["cell"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


#: Bits in one row of a bitmap table: 512 longs.
_ROW_BITS = 32768


def bitmap_table(keys: DataFrame) -> tuple[DataFrame, int]:
    """The column ``key`` as rows (cell, bits) of 512 longs; at most 16 MB in all."""
    size = _bits_for(keys)
    place = f"(key & {size - 1}L)"
    words = keys.groupBy(F.expr(f"cast({place} div {_ROW_BITS} as int)").alias("cell"), F.expr(f"cast({place} % {_ROW_BITS} div 64 as int)").alias("i"))
    words = words.agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 63L as int)))").alias("word"))
    in_row = _ROW_BITS // 64
    none = session(keys).range(size // 64).select(F.expr(f"cast(id div {in_row} as int)"), F.expr(f"cast(id % {in_row} as int)"), F.lit(0).cast("long"))
    every = words.union(none).groupBy("cell", "i").agg(F.bit_or("word").alias("word"))
    rows = every.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("bits"))
    return written(rows.select("cell", F.col("bits.word").alias("bits")), "bitmap"), size


def maybe_in(df: DataFrame, column: str, bitmap: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose key may be in the bitmap. Its size has a ceiling, so it is broadcast."""
    rows, size = bitmap
    place = f"({column} & {size - 1}L)"
    return (
        df.join(F.broadcast(rows), F.expr(f"cast({place} div {_ROW_BITS} as int)") == F.col("cell"))
        .filter(f"(shiftrightunsigned(bits[cast({place} % {_ROW_BITS} div 64 as int)], cast({column} & 63L as int)) & 1L) = 1L")
        .select(*df.columns)
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): connected components, the root being the smallest id.

    Alternating large-star and small-star rounds: each is two joins and two
    aggregations over the edges, and their number grows with the logarithm of
    the longest path. Every round is written, so none is computed twice. Nodes
    without an edge are left out; nulls are ignored.
    """
    now = written(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    state = None
    while True:
        with tidy(session(now)):
            print_of = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if print_of == state or not print_of[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = print_of
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        free(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(least).distinct(), "small")
        free(large)
