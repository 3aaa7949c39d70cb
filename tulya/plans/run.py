"""A batch of documents from their pages to scores and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import datums, facts, judge, offline, report, score, segments, structure, terms, verify
from ..operators.english import normalize_target
from ..operators.lookups import described
from ..operators.store import REVIEW_BELOW
from ..sources.writers import block_targets

KEYS = ["doc_id", "block_ord"]
_FINDING = [*KEYS, "check", "category", "severity", "title"]


def run(
    pages: DataFrame,
    glossary: DataFrame,
    *,
    translate: Callable[[DataFrame], DataFrame] | None = None,
    locks: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df,
) -> dict[str, DataFrame]:
    """Tables documents, blocks, segments and those of verified() of a batch, in the order of a single run.

    pages: doc_id, page_no, kind, text, confidence. A document that its preflight blocks
    isn't translated: documents (doc_id, warnings, ok) tells which and why, and nothing
    after that has rows of it. translate adds target to segments (the offline renderer
    does by default; passes.translated with a provider is another); what is locked isn't
    asked for. A segment's English is put right by the confidence of its page. keep
    writes a table, by its name, and reads it again, so that none is worked out twice and
    plans stay small (scratch.kept does; without it the plan of the reports is too large
    for more than a look). Documents never wait for each other: all steps are joins and
    aggregations by document.
    """
    every = keep(structure.detect_structure(pages), "blocks")
    documents = keep(structure.preflight(facts.document_text(every)).select("doc_id", "warnings", "ok"), "documents")
    blocks = every.join(documents.filter("ok").select("doc_id"), "doc_id", "left_semi")
    if translate is None:
        heads = {r["surface"]: r["head"] for r in glossary.select("surface", "head").distinct().collect()}
        translate = lambda df: offline.rendered(df, heads)
    asked = segments.build_segments(blocks)
    open_ = asked.filter("not passthrough")
    if locks is not None:
        open_ = open_.join(locks.select("doc_id", "seg_idx"), ["doc_id", "seg_idx"], "left_anti")
    answered = translate(open_).select("doc_id", "seg_idx", "target")
    through = asked.filter("passthrough").select("doc_id", "seg_idx", F.col("source").alias("target"))
    done = segments.with_omissions(asked, answered.unionByName(through))
    if locks is not None:
        done = segments.locked_over(done, locks)
    seen = pages.groupBy("doc_id", "page_no").agg(F.min("confidence").alias("page_confidence"))
    of_page = blocks.select(*KEYS, "page_no").join(seen, ["doc_id", "page_no"], "left").select(*KEYS, "page_confidence")
    done = done.join(of_page, KEYS, "left")
    done = done.withColumn("target", normalize_target(F.col("target"), F.col("source"), F.col("page_confidence"))).drop("page_confidence")
    done = keep(done, "segments")
    out = verified(blocks, done, documents, glossary, pages=pages, keep=keep)
    return {"documents": documents, "blocks": every, "segments": done} | out


def verified(
    blocks: DataFrame,
    done: DataFrame,
    documents: DataFrame,
    glossary: DataFrame,
    *,
    pages: DataFrame | None = None,
    reports: bool = True,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df,
) -> dict[str, DataFrame]:
    """Tables datums, findings, verdicts, checks and scores of stored blocks and segments; with reports, reports and narratives too.

    blocks: doc_id, block_ord, kind, source_text; done, their segments: doc_id, seg_idx,
    block_ord, source, target; documents: doc_id and the warnings of the preflight;
    pages: doc_id, page_no, confidence, if they were read by OCR. A document is checked
    again this way as it is checked in a run.
    """
    confidence, low = None, None
    if pages is not None:
        read = pages.filter("confidence is not null")
        confidence = read.groupBy("doc_id").agg(F.avg("confidence").alias("mean_ocr"))
        low = report.page_ranges(read.filter(F.col("confidence") < REVIEW_BELOW).select("doc_id", "page_no"))
    rolled = block_targets(done.select("doc_id", F.col("block_ord").alias("block_id"), "seg_idx", "target"))
    rolled = rolled.select("doc_id", F.col("block_id").alias("block_ord"), F.col("target").alias("target_text"))
    # A block without any segment is one without English, not one to leave out.
    plain = blocks.filter(~F.col("kind").isin(structure.R.NOT_TRANSLATED)).drop("target_text")
    pairs = keep(plain.join(rolled, KEYS, "left").withColumn("target_text", F.coalesce("target_text", F.lit(""))), "pairs")
    matched = datums.matched_datums(pairs.withColumn("target_blank", X.trimmed("target_text") == ""), KEYS, context=True)
    matched = keep(matched, "datums")
    glossary = keep(glossary, "glossary")
    scan = terms.term_scan(pairs, glossary, "source_text")
    plan = keep(terms.term_plan(scan, glossary), "terms")
    verdict = pairs.withColumn("v", judge.offline_verdict(F.col("source_text"), F.col("target_text")))
    verdict = keep(verdict.select(*KEYS, "v.faithful", "v.issues", "v.confidence"), "verdicts")
    told = lambda c: F.transform(F.array_sort(F.collect_list(F.when(X.trimmed(c) != "", F.struct("seg_idx", F.col(c).alias("x"))))), lambda s: s["x"])
    sides = done.groupBy("doc_id").agg(told("source").alias("s"), told("target").alias("t"))
    aligned = keep(verify.align(sides, "s", "t"), "aligned")
    parts = [
        datums.datum_findings(matched, KEYS),
        terms.term_findings(terms.term_compliance(plan, pairs), terms.term_consistency(plan, pairs)),
        verify.structure_findings(pairs, done),
        verify.alignment_findings(aligned),
        judge.judge_findings(verdict),
    ]
    findings = parts[0].select(*_FINDING)
    for p in parts[1:]:
        findings = findings.unionByName(p.select(*_FINDING))
    findings = keep(findings, "findings")

    counts = matched.filter("side = 's'").groupBy("doc_id").agg(F.count("*").alias("n_datums"))
    used = plan.groupBy("doc_id").agg(F.sum("cnt").alias("n_terms"))
    judged = judge.judge_coverage(pairs, verdict).withColumn("n_verdicts", F.col("blocks_judged"))
    base = verify.coverage(pairs).withColumnRenamed("ratio", "coverage")
    known = [counts, used, judged, score.penalties(findings), done.groupBy("doc_id").agg(F.count("*").alias("n_segments"))]
    for part in known + ([] if confidence is None else [confidence]):
        base = base.join(part, "doc_id", "left")
    if confidence is None:
        base = base.withColumn("mean_ocr", F.lit(None).cast("double"))
    scores = keep(score.gate_reasons(score.score(base)), "scores")
    checked = score.check_counts(matched, findings, documents, aligned)
    checks = keep(score.mechanical_checks(scores.join(checked, "doc_id", "left")), "checks")
    kinds = described(structure.doc_type(facts.document_text(blocks)), "type").select("doc_id", "type", "label", "register")
    out = {"datums": matched, "findings": findings, "verdicts": verdict, "checks": checks, "scores": scores.join(kinds, "doc_id", "left")}
    if not reports:
        return out
    stated = facts.title_facts(pairs)
    entries = facts.mutation_entries(pairs)
    register = findings.withColumn("place", score.severity_rank(F.col("severity")))
    register = register.select("doc_id", F.struct("place", "block_ord", "check", "title").alias("place"), "severity", "title", "check", "category")
    items = report.report_items(
        stated, report.by_section(findings), quotes=report.evidence(report.sentences(pairs)), mutations=entries, register=register,
        checks=checks, scores=scores, low_pages=low,
    )
    critical = findings.filter("severity = 'critical'").groupBy("doc_id", "category").agg(F.count("*").alias("n"))
    return out | {"reports": keep(items, "reports"), "narratives": report.narrative(scores, critical)}
