"""Views over the test tables that give the operators pairs of texts, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A small dictionary for tables without Gujarati: source, target, category, preserved, alternatives, aliases.
SEEDED = [
    ("the", "tha (definite article)", "general", False, ["thes"], []),
    ("of", "oft", "general", False, [], []),
    ("que", "kwe", "general", True, ["qua (a variant)"], []),
    ("der", "dher", "party", False, ["dar"], []),
    ("under", "hunder", "procedure", False, [], []),
]

#: A dictionary for the Gujarati side of bitext.
SEEDED_GUJARATI = [("રકમ", "amount (sum)", "general", False, ["sum"], [])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows on all cores, where a table lies in fewer parts than there are; a table of many parts is left as it is.

    Work on a text takes far longer than to move it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def with_commas(digits: Column) -> Column:
    from ..functions.text import indian_group

    return indian_group(digits)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with block_ord: the place of a line in its order (line numbers repeat)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").withColumn("block_ord", (F.row_number().over(w) - 1).cast("int"))


def bitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, block_ord, source_text, target_text: an amount and a date, put wrong in five ways by line number."""
    li = numbered(spark, sf_dir)
    amount = F.floor("l_extendedprice").cast("long")
    iso, long = F.date_format("l_shipdate", "yyyy-MM-dd"), F.date_format("l_shipdate", "d MMMM yyyy")
    k = F.col("l_linenumber") % 5
    shown = F.when(k == 0, (amount + 1000).cast("string")).when(k == 2, with_commas(amount.cast("string"))).otherwise(amount.cast("string"))
    full = F.concat(F.lit("An amount of Rs. "), shown, F.lit(" dated "), long)
    target = F.when(k == 1, F.concat(F.lit("An amount of Rs. "), shown)).when(k == 4, F.lit("")).when(k == 3, F.concat(full, F.lit(" ref 77"))).otherwise(full)
    return li.select(
        F.col("l_orderkey").alias("doc_id"), "block_ord",
        F.concat(F.lit("રકમ રૂ. "), amount.cast("string"), F.lit(" તા. "), iso).alias("source_text"), target.alias("target_text"),
    )


BITEXT = """
numbered as (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_shipdate, l_partkey,
  l_suppkey, l_quantity) - 1 as int) as block_ord from lineitem),
li as (select l_orderkey as doc_id, block_ord, cast(floor(l_extendedprice) as bigint) as amount,
  l_linenumber % 5 as k, l_shipdate as d from numbered),
lg as (select *, cast(amount as varchar) as a, length(cast(amount as varchar)) as n from li),
lc as (select *, case when n <= 3 then a when n <= 5 then a[1:n-3] || ',' || a[n-2:n]
  else a[1:n-5] || ',' || a[n-4:n-3] || ',' || a[n-2:n] end as grouped from lg),
ls as (select *, case k when 0 then cast(amount + 1000 as varchar) when 2 then grouped else a end as shown,
  strftime(d, '%-d %B %Y') as longd from lc),
bitext as (select doc_id, block_ord, amount, k, shown, d, 'રકમ રૂ. ' || a || ' તા. ' || strftime(d, '%Y-%m-%d') as source_text,
  case k when 1 then 'An amount of Rs. ' || shown when 4 then ''
    when 3 then 'An amount of Rs. ' || shown || ' dated ' || longd || ' ref 77'
    else 'An amount of Rs. ' || shown || ' dated ' || longd end as target_text from ls)
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, block_ord, source_text, target_text: what a user says and what the assistant answers."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    t = t.filter("role = 'user' and next_role = 'assistant'")
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_ord"), F.col("text").alias("source_text"), F.col("answer").alias("target_text"))


TURNS = """
turns as (select conv_id as doc_id, cast(turn as int) as block_ord, text as source_text, answer as target_text from (
  select *, lead(role) over w as next_role, lead(text) over w as answer from conversations
  window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant')
"""
