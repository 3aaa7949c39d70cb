"""Reads of stored tables: lists, lookups, counts, and what a service would answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .english import normalize_target
from .lookups import effective_type
from .score import severity_rank

#: Confidence under which a scanned page is reviewed, and a document's mean under which it is warned of.
REVIEW_BELOW, WARN_BELOW = 0.8, 0.72
#: Rows of the activity log that are shown.
RECENT = 25


def document_list(docs: DataFrame, created: str = "created_at", tie: str = "doc_id") -> DataFrame:
    """All documents, the newest first."""
    return docs.orderBy(F.desc(created), tie)


def document(docs: DataFrame, doc_id: object, id_col: str = "doc_id") -> DataFrame:
    """One document's rows; the condition reaches the scan."""
    return docs.filter(F.col(id_col) == F.lit(doc_id))


def blocks_in_order(blocks: DataFrame) -> DataFrame:
    """Blocks with their place in the document, and the English put right as on every read."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_ord")) - 1
    confidence = F.col("page_confidence") if "page_confidence" in blocks.columns else F.lit(None).cast("double")
    fixed = normalize_target(F.col("target_text"), F.col("source_text"), confidence)
    return blocks.withColumns({"place": place, "target_text": fixed})


def page_confidences(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, page_confidence: of each page the first that is known, by order of blocks."""
    known = blocks.filter("page_confidence is not null")
    return known.groupBy("doc_id", "page_no").agg(F.min_by("page_confidence", "block_ord").alias("page_confidence"))


def stored_translation(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, seg_idx, block_id, source, target, confidence, locked.

    A document without segments falls back to its blocks, one segment each. The
    confidence of a segment's page decides what its English is put right by.
    """
    own = segments.join(page_confidences(blocks), ["doc_id", "page_no"], "left")
    own = own.select(
        "doc_id", "seg_idx", "block_id", "source",
        normalize_target(F.col("target"), F.col("source"), F.col("page_confidence")).alias("target"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("locked", F.lit(False)).alias("locked"),
    )
    bare = blocks.join(segments.select("doc_id").distinct(), "doc_id", "left_anti")
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_ord")) - 1
    rest = bare.select(
        "doc_id", idx.alias("seg_idx"), "block_id", F.col("source_text").alias("source"),
        normalize_target(F.col("target_text"), F.col("source_text"), F.lit(None).cast("double")).alias("target"),
        F.lit(1.0).alias("confidence"), F.lit(False).alias("locked"),
    )
    return own.unionByName(rest)


def findings_in_order(findings: DataFrame, *tie: str) -> DataFrame:
    """Findings with place: the most severe first."""
    order = Window.partitionBy("doc_id").orderBy(severity_rank(F.col("severity")), *tie)
    return findings.withColumn("place", F.row_number().over(order))


def datums_in_order(datums: DataFrame, *tie: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("page_no", *tie)
    return datums.withColumn("place", F.row_number().over(order))


def mean_confidence(pages: DataFrame) -> DataFrame:
    """doc_id, mean_ocr of the pages that have a confidence, and whether that is a reason to warn."""
    out = pages.groupBy("doc_id").agg(F.avg("confidence").alias("mean_ocr"))
    return out.withColumn("warned", F.coalesce(F.col("mean_ocr") < WARN_BELOW, F.lit(False)))


def to_review(kind: Column, confidence: Column) -> Column:
    """Whether a page has to be looked at: scanned and read with little confidence."""
    return (kind == "scanned") & (F.coalesce(confidence, F.lit(1.0)) < REVIEW_BELOW)


def open_jobs(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.filter(F.col(status).isin("queued", "running"))


def queue_positions(jobs: DataFrame, status: str, ts: str, tie: str) -> DataFrame:
    """Queued jobs with position (from 1) and what a client is told.

    The queue is one; its places come from counts by day and a rank within the
    day, so no task sorts the whole of it.
    """
    queued = jobs.filter(F.col(status) == "queued").withColumn("_day", F.to_date(ts))
    days = queued.groupBy("_day").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(F.col("_day").alias("_d"), ahead.alias("_ahead"))  # a row a day
    rank = F.row_number().over(Window.partitionBy("_day").orderBy(ts, tie))
    out = queued.join(days, F.col("_day") == F.col("_d")).withColumn("position", (F.col("_ahead") + rank).cast("long"))
    detail = F.when(F.col("position") == 1, "Queued — next in line").otherwise(F.format_string("Queued — %d ahead", F.col("position") - 1))
    return out.withColumn("detail", detail).drop("_day", "_d", "_ahead")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n: a row per table."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def recent_activity(log: DataFrame, ts: str, tie: str, most: int = RECENT) -> DataFrame:
    """The last rows of a log, the newest first."""
    return log.orderBy(F.desc(ts), F.desc(tie)).limit(most)


def parsed_report(reports: DataFrame, body_col: str, schema: str) -> DataFrame:
    """Stored reports as structs; null where the JSON is broken."""
    parsed = F.when(F.try_parse_json(body_col).isNotNull(), F.from_json(body_col, schema))
    return reports.withColumn("report", parsed)


def document_types(docs: DataFrame, declared: str, detected: str) -> DataFrame:
    return docs.withColumn("type", effective_type(F.col(declared), F.col(detected)))


def run_counts(findings: DataFrame) -> DataFrame:
    """doc_id, counts: what a verification run leaves in its log, as JSON."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    out = findings.groupBy("doc_id").agg(n("critical"), n("major"), n("minor"), n("info"), F.count("*").alias("total"))
    return out.select("doc_id", F.to_json(F.struct("critical", "major", "minor", "info", "total")).alias("counts"))


def datum_counts(matched: DataFrame) -> DataFrame:
    """doc_id, n_agreed, n_changed, n_missing, n_added of facts as match_datums has them."""
    source = F.col("side") == "s"
    n = lambda cond: F.count_if(cond)
    return matched.groupBy("doc_id").agg(
        n(source & F.col("status").isin("agreed", "repeated")).alias("n_agreed"),
        n(source & (F.col("status") == "changed")).alias("n_changed"),
        n(source & F.col("status").isin("missing", "silent")).alias("n_missing"),
        n(F.col("status") == "added").alias("n_added"),
    )


def document_summary(docs: DataFrame, jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """A row per document: its columns, its last job's status, and its open findings by severity."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    counted = findings.groupBy("doc_id").agg(n("critical"), n("major"), n("minor"))
    last = jobs.groupBy("doc_id").agg(F.max_by("status", F.struct("created_at", "job_id")).alias("job_status"))
    out = docs.join(last, "doc_id", "left").join(counted, "doc_id", "left")
    return out.fillna(0, ["n_critical", "n_major", "n_minor"])


def without_prefix(block_id: Column, doc_id: Column) -> Column:
    """A block's own id, without the document's in front."""
    prefix = F.concat(doc_id.cast("string"), F.lit(":"))
    return F.when(F.startswith(block_id, prefix), F.substr(block_id, F.length(prefix) + 1)).otherwise(block_id)


def health(jobs: DataFrame, status: str = "status") -> DataFrame:
    """ok, n_open: one row."""
    return open_jobs(jobs, status).agg(F.count("*").alias("n_open")).select(F.lit(True).alias("ok"), "n_open")


def finding_ids(findings: DataFrame, place: str = "block_ord") -> DataFrame:
    """Adds id: the same for the same finding in every run, and another for each finding of a document.

    It names document, check, place and title; of findings alike in all of these the
    number among them too.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "check", place, "title")]
    key = F.md5(F.concat_ws("|", *parts).cast("binary"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("check")) - 1
    out = findings.withColumn("_key", key).withColumn("_nth", nth)
    return out.withColumn("id", F.concat(F.lit("f"), F.substring("_key", 1, 15), F.when(F.col("_nth") > 0, F.concat(F.lit("-"), F.col("_nth"))).otherwise(""))).drop("_key", "_nth")


def document_view(
    docs: DataFrame, jobs: DataFrame, timings: DataFrame, segments: DataFrame, findings: DataFrame, reports: DataFrame | None = None
) -> DataFrame:
    """A row per document with all that a reader of it is shown.

    Besides the columns of docs: job (the last one's id and status), timings in order of
    started_at, segments in order of seg_idx, findings from critical to info and then in
    order of place, their numbers by severity, block and segment counts, and report, if
    reports (doc_id, body) are given. Lists are of one document each; what a document
    lacks is an empty list or null. Give docs filtered to what is asked for: the other
    tables are then read for these documents only.
    """
    def listed(df: DataFrame, order: list[Column], columns: list[str], name: str) -> DataFrame:
        keyed = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*columns).alias("v"))
        rows = df.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(keyed)).alias("l"))
        return rows.select("doc_id", F.transform("l", lambda s: s["v"]).alias(name))

    parts = [
        jobs.groupBy("doc_id").agg(F.max_by(F.struct("job_id", "status"), F.struct("created_at", "job_id")).alias("job")),
        listed(timings, [F.col("started_at"), F.col("stage")], ["stage", "started_at"], "timings"),
        listed(segments, [F.col("seg_idx")], ["seg_idx", "source", "target"], "segments"),
        listed(findings, [severity_rank(F.col("severity")), F.col("block_ord"), F.col("check")], ["id", "check", "severity", "block_ord"], "findings"),
    ]
    out = docs
    for part in parts + ([] if reports is None else [reports.select("doc_id", F.col("body").alias("report"))]):
        out = out.join(part, "doc_id", "left")
    for name in ("timings", "segments", "findings"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))

    def of(severity: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["severity"] == severity))

    counts = F.create_map(*(x for s in ("critical", "major", "minor", "info") for x in (F.lit(s), of(s))))
    return out.withColumns({"n_segments": F.size("segments"), "by_severity": counts})
