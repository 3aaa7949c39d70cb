"""Meaning-level review: an offline judge, a cascade of two, and their verdicts as findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Batch sizes of the fast and the strong judge; below this confidence the strong one is asked.
FAST_BATCH, BATCH, CONFIDENT = 12, 8, 0.86
SUBSTANTIVE = ["Amounts", "Dates", "Legal references", "Names", "Coverage"]

_ISSUE = "array<struct<code:string,severity:string,detail:string>>"


def offline_verdict(source: Column, target: Column) -> Column:
    """struct(faithful, issues, confidence) from emptiness, script and length."""
    texts = F.struct(X.trimmed(F.coalesce(source, F.lit(""))).alias("s"), X.trimmed(F.coalesce(target, F.lit(""))).alias("t"))
    told = lambda issues: F.struct(
        (~F.exists(issues, lambda i: i["severity"].isin("critical", "major"))).alias("faithful"), issues.alias("issues"), F.lit(0.4).alias("confidence")
    )
    # Bound, so that neither the texts nor the issues are worked out again wherever they are used.
    return X.let(texts, lambda x: X.let(_issues(x["s"], x["t"]), told))


def _issues(s: Column, t: Column) -> Column:
    ratio = F.when(F.length(s) == 0, F.lit(1.0)).otherwise(F.length(t) / F.length(s))
    percent = F.floor(ratio * 100 + 0.5).cast("string")
    issue = lambda code, severity, detail: F.array(
        F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail"))
    )
    return (
        F.when(t == "", issue("OMISSION", "critical", F.lit("The English segment is empty.")))
        .when(X.indic_ratio(t) > 0.1, issue("DRIFT", "major", F.lit("The English segment still contains Gujarati.")))
        .when(ratio < 0.35, issue("OMISSION", "major", F.concat(F.lit("English is "), percent, F.lit("% the length of its source."))))
        .when(ratio > 2.6, issue("ADDITION", "minor", F.concat(F.lit("English is "), percent, F.lit("% the length of its source."))))
        .otherwise(F.array().cast(_ISSUE))
    )


def batches(df: DataFrame, size: int, doc_col: str = "doc_id", order_col: str = "block_ord", first: Column | None = None) -> DataFrame:
    """Adds batch: blocks by priority, then in order, so many to the batch."""
    order = [F.desc(first), order_col] if first is not None else [order_col]
    rank = F.row_number().over(Window.partitionBy(doc_col).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(rank / size).cast("int"))


def must_judge(findings: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Blocks with a critical finding, or a major one about data."""
    serious = (F.col("severity") == "critical") | ((F.col("severity") == "major") & F.col("category").isin(SUBSTANTIVE))
    return findings.filter("block_ord is not null").filter(serious).select(doc_col, "block_ord").distinct()


def escalated(fast: DataFrame, must: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """doc, block_ord, priority: blocks for the strong judge: without a verdict, unfaithful, unsure, or asked for."""
    asked = must.select(doc_col, "block_ord", F.lit(True).alias("priority"))
    out = fast.join(asked, [doc_col, "block_ord"], "left").withColumn("priority", F.coalesce("priority", F.lit(False)))
    unsure = F.col("faithful").isNull() | ~F.col("faithful") | (F.col("confidence") < CONFIDENT)
    return out.filter(unsure | F.col("priority")).select(doc_col, "block_ord", "priority")


def overruled(fast: DataFrame, strong: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """The strong judge's verdict where there is one."""
    s = strong.select(doc_col, "block_ord", F.struct("faithful", "issues", "confidence").alias("_s"))
    out = fast.join(s, [doc_col, "block_ord"], "left")
    pick = lambda c: F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c)
    return out.select(doc_col, "block_ord", *(pick(c) for c in ("faithful", "issues", "confidence")), F.when(F.col("_s").isNotNull(), "strong").otherwise("fast").alias("tier"))


def parsed_verdicts(replies: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Verdicts of model replies: JSON in a fence, as a whole, or from the first brace to the last.

    Segments are a list or an object by id; ids may be numbers or text; a missing
    confidence is 0.6, others are held between 0 and 1.
    """
    raw = F.col(text_col)
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    body = F.coalesce(*(F.try_parse_json(F.when(c != "", c)) for c in (fenced, raw, braces)))
    listed = F.try_variant_get(body, "$.segments", "array<variant>")
    keyed = F.try_variant_get(body, "$.segments", "map<string,variant>")
    rows = F.coalesce(
        F.transform(listed, lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$.index", "string"), F.try_variant_get(v, "$.id", "string")).alias("id"), v.alias("v"))),
        F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("v"))),
    )
    out = replies.select(*keep, F.explode(rows).alias("r"))
    confidence = F.try_variant_get("r.v", "$.confidence", "double")
    return out.select(
        *keep, F.regexp_extract("r.id", r"([0-9]+)", 1).try_cast("int").alias("idx"),
        F.coalesce(F.try_variant_get("r.v", "$.faithful", "boolean"), F.lit(True)).alias("faithful"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.6)))).alias("confidence"),
        F.coalesce(*(F.try_variant_get("r.v", p, "string") for p in ("$.target", "$.text", "$.translation"))).alias("target"),
        F.try_variant_get("r.v", "$.issues", _ISSUE).alias("issues"),
    ).filter("idx is not null")


def judge_findings(verdicts: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """A finding per issue: semantic.<code>; an unknown severity is major."""
    rows = verdicts.select(doc_col, "block_ord", F.explode("issues").alias("i"))
    known = F.col("i.severity").isin("critical", "major", "minor", "info")
    return rows.select(
        doc_col, "block_ord", F.concat(F.lit("semantic."), F.lower("i.code")).alias("check"),
        F.lit("Semantic fidelity").alias("category"), F.when(known, F.col("i.severity")).otherwise("major").alias("severity"),
        F.col("i.detail").alias("title"), F.lit("").alias("source_excerpt"), F.lit("").alias("target_excerpt"),
    )


def judge_coverage(blocks: DataFrame, verdicts: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """doc, blocks_total, blocks_judged, available, complete, faithful."""
    v = verdicts.select(doc_col, "block_ord", "faithful").dropDuplicates([doc_col, "block_ord"])
    return judged(blocks.select(doc_col, "block_ord").join(v, [doc_col, "block_ord"], "left"), doc_col)


def judged(blocks: DataFrame, doc_col: str = "doc_id", *more: Column) -> DataFrame:
    """judge_coverage of blocks that have their verdict's faithful in their row; more: further aggregates."""
    out = blocks.groupBy(doc_col).agg(
        F.count("*").alias("blocks_total"), F.count("faithful").alias("blocks_judged"), F.coalesce(F.bool_and("faithful"), F.lit(True)).alias("faithful"), *more
    )
    return out.withColumns({"available": F.col("blocks_judged") > 0, "complete": F.col("blocks_judged") == F.col("blocks_total")})
