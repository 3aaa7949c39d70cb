"""Tables of a document, replaced as a whole; logs, appended."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import kept as scratch_kept


#: Parts that a table of documents is divided into.
BUCKETS = 64


def _bucket(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, path: str):
    """The file system, the folder of manifests, and the numbers there are."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName()) for f in files.listStatus(folder)] if files.exists(folder) else []
    return files, folder, sorted(found)


def _current(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The number of the last version (0 for none) and its folder for each bucket."""
    _, folder, numbers = _manifests(spark, path)
    if not numbers:
        return 0, {}
    lines = spark.read.text(f"{path}/_manifest/{numbers[-1]}").collect()  # a line a bucket
    return numbers[-1], dict(line["value"].split("\t") for line in lines)


def replace_documents(df: DataFrame, path: str, id_col: str = "doc_id", buckets: int = BUCKETS, removed: DataFrame | None = None) -> int:
    """All rows of the documents in df take the place of those that the table at path has of them; the new version's number.

    A table is a list of folders, one for each bucket of ids. The buckets that df or
    ``removed`` (ids of documents to be left out) touches are read, the old rows of
    these documents taken out by an anti-join, the new ones added and the whole written
    to a new folder. The list of folders is written last, under the next number: until
    then, and if the write fails, readers have the old table. Of two writers at once the
    second fails on the number. Rows with a null id replace each other. Every version
    has the columns of the first.
    """
    spark = df.sparkSession
    number, folders = _current(spark, path)
    new = df.withColumn("bucket", _bucket(id_col, buckets))
    gone = new.select("bucket", F.col(id_col).alias("_gone"))
    if removed is not None:
        gone = gone.union(removed.select(_bucket(id_col, buckets), F.col(id_col)))
    gone = scratch_kept(gone.distinct(), "gone")
    touched = sorted(r["bucket"] for r in gone.select("bucket").distinct().collect())  # at most as many as buckets
    before = [folders[str(b)] for b in touched if str(b) in folders]
    out = new
    if before:
        old = spark.read.schema(df.schema).parquet(*before).withColumn("bucket", _bucket(id_col, buckets))
        left = old.join(gone.select("_gone"), old[id_col].eqNullSafe(F.col("_gone")), "left_anti")
        out = left.select(*new.columns).union(new)
    version = f"{path}/data/{uuid.uuid4().hex}"
    out.repartition("bucket").write.partitionBy("bucket").parquet(version)
    files, folder, _ = _manifests(spark, path)
    made = spark._jvm.org.apache.hadoop.fs.Path
    listed = folders | {str(b): f"{version}/bucket={b}" for b in touched}
    listed = {b: where for b, where in listed.items() if files.exists(made(where))}
    # Written beside the manifests and renamed in one step, so no reader sees half of it.
    lines = spark.createDataFrame([(f"{b}\t{where}",) for b, where in sorted(listed.items())], "value string")
    lines.coalesce(1).write.text(f"{version}-list")
    files.mkdirs(folder)
    goal = made(f"{path}/_manifest/{number + 1}")
    if files.exists(goal) or not files.rename(made(f"{version}-list"), goal):
        raise RuntimeError(f"version {number + 1} of {path} was written by another")
    return number + 1


def documents(spark: SparkSession, path: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """A table of replace_documents, as it is or as a version had it; an empty one if there is none."""
    _, _, numbers = _manifests(spark, path)
    number = version or (numbers[-1] if numbers else 0)
    folders = [r["value"].split("\t")[1] for r in spark.read.text(f"{path}/_manifest/{number}").collect()] if number else []
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by order. An upsert is an append read through this."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def block_targets(segments: DataFrame) -> DataFrame:
    """doc_id, block_id, target, state: targets of a block's segments in order, joined; failed without any."""
    some = F.filter(
        F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.trim(F.coalesce("target", F.lit(""))).alias("t")))), lambda s: s["t"]),
        lambda t: t != "",
    )
    out = segments.groupBy("doc_id", "block_id").agg(F.array_join(some, " ").alias("target"))
    return out.withColumn("state", F.when(F.col("target") == "", "failed").otherwise("ai"))


def item_lines(items: Column) -> Column:
    """Report items (struct t, text, items, rows) as lines of a text file."""
    def lines(i: Column) -> Column:
        return (
            F.when(i["t"].isin("h1", "h2"), F.array(F.lit(""), F.upper(i["text"]), F.lit("")))
            .when(i["t"] == "bullets", F.transform(i["items"], lambda b: F.concat(F.lit("  - "), b)))
            .when(i["t"].isin("table", "borders"), F.transform(i["rows"], lambda r: F.array_join(r, " | ")))
            .when(i["t"] == "page", F.array(F.lit("\f")))
            .otherwise(F.array(i["text"]))
        )

    return F.flatten(F.transform(items, lines))


def write_text(df: DataFrame, lines_col: str, path: str) -> None:
    """One document a row: its lines to text files."""
    df.select(F.array_join(lines_col, "\n").alias("value")).write.mode("overwrite").text(path)


def to_report_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
