"""Findings to a score, a grade and a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import values as V

#: Meaning without a judge, source confidence without OCR, bounds of the grades.
UNJUDGED, NO_OCR, GOOD, POOR = 0.55, 0.9, 0.9, 0.7


def severity_weight(c: Column) -> Column:
    out = F.lit(0.0)
    for name, w in V.SEVERITY_WEIGHTS.items():
        out = F.when(c == name, F.lit(w)).otherwise(out)
    return out


def severity_rank(c: Column) -> Column:
    out = F.lit(9)
    for name, r in V.SEVERITY_RANKS.items():
        out = F.when(c == name, F.lit(r)).otherwise(out)
    return out


def penalties(findings: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """doc, n_critical, n_major, n_minor, datum_penalty, term_penalty, semantic_penalty of open findings."""
    open_ones = findings.filter("status = 'open'") if "status" in findings.columns else findings
    w = severity_weight(F.col("severity"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0.0))
    return open_ones.groupBy(doc_col).agg(
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("severity") == "major").alias("n_major"),
        F.count_if(F.col("severity") == "minor").alias("n_minor"),
        total(F.startswith("check", F.lit("datum."))).alias("datum_penalty"),
        total(F.col("category") == "Terminology").alias("term_penalty"),
        total(F.col("category") == "Semantic fidelity").alias("semantic_penalty"),
    )


def with_counted(docs: DataFrame) -> DataFrame:
    """Penalties with those of facts, of which found_critical, found_major and found_minor are counts."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    kinds = ("critical", "major", "minor")
    total = sum((n(f"found_{k}") * V.SEVERITY_WEIGHTS[k] for k in kinds), F.lit(0.0))
    counts = {f"n_{k}": n(f"n_{k}") + n(f"found_{k}") for k in kinds}
    return docs.withColumns(counts | {"datum_penalty": F.coalesce("datum_penalty", F.lit(0.0)) + total}).drop(*(f"found_{k}" for k in kinds))


def score(docs: DataFrame) -> DataFrame:
    """Adds the five components, total, grade and certified_ready.

    docs: penalties, n_datums, n_terms, coverage, n_empty, mean_ocr, and of the judge
    available, complete, faithful, blocks_judged, blocks_total, n_verdicts; nulls
    count as nothing found and no judge.
    """
    n = lambda c, d=0: F.coalesce(F.col(c), F.lit(d))
    one = F.lit(1.0)
    datum = F.when(n("n_datums") == 0, one).otherwise(F.greatest(F.lit(0.0), 1 - n("datum_penalty", 0.0) / F.greatest(one, n("n_datums"))))
    terms = F.when(n("n_terms") == 0, one).otherwise(F.greatest(F.lit(0.0), 1 - n("term_penalty", 0.0) / n("n_terms")))
    available = n("available", False)
    judged = F.when(available, F.least(one, n("blocks_judged") / F.greatest(F.lit(1), n("blocks_total")))).otherwise(F.lit(0.0))
    base = F.when(available, F.greatest(F.lit(0.0), 1 - n("semantic_penalty", 0.0) / F.greatest(F.lit(4.0), n("n_verdicts") / 4))).otherwise(F.lit(UNJUDGED))
    semantic = base * judged + UNJUDGED * (1 - judged)
    parts = {
        "datum_integrity": datum, "terminology": terms, "coverage_score": n("coverage", 1.0), "semantic": semantic,
        "ocr_confidence": n("mean_ocr", NO_OCR),
    }
    out = docs.withColumns(parts)
    weights = dict(zip(parts, V.SCORE_WEIGHTS.values(), strict=True))
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    out = out.withColumn("total", F.greatest(F.lit(0.0), F.least(one, total)))
    grade = (
        F.when((n("n_critical") > 0) | (F.col("total") < POOR), "red")
        .when((n("n_major") == 0) & (F.col("total") >= GOOD), "green")
        .otherwise("yellow")
    )
    ready = (n("n_critical") == 0) & (n("coverage", 1.0) == 1) & (n("n_empty") == 0) & available & n("complete", False) & n("faithful", False)
    out = out.withColumns({"grade": grade, "certified_ready": ready})
    return out.withColumns({c: F.round(c, 3) for c in [*parts, "total"]})


def interpretation(total: Column) -> Column:
    return (
        F.when(total >= GOOD, "The checks that ran passed; this is not a measure of overall accuracy.")
        .when(total >= POOR, "Findings require review before this translation is used.")
        .otherwise("Significant divergence was detected. Do not rely on this translation until it is resolved.")
    )


def gate_reasons(d: DataFrame) -> DataFrame:
    """Adds reasons: why a document isn't certified."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    reasons = F.array(
        F.when(n("n_critical") > 0, F.concat(n("n_critical").cast("string"), F.lit(" critical finding(s)"))),
        F.when(n("n_empty") > 0, F.concat(n("n_empty").cast("string"), F.lit(" block(s) without English"))),
        F.when(~F.coalesce(F.col("available"), F.lit(False)), F.lit("no meaning-level review")),
        F.when(F.coalesce(F.col("available"), F.lit(False)) & ~F.coalesce(F.col("complete"), F.lit(False)), F.lit("review incomplete")),
    )
    return d.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))


#: Warnings of the preflight with which the script isn't confirmed, as with any that blocks.
UNCONFIRMED = ["not_indic", "wrong_script", "legacy_encoding"]
#: What of a fact counts as a difference between the two sides.
DIFFERING = ["changed", "missing", "repeated", "silent", "added"]


def check_counts(matched: DataFrame, findings: DataFrame, preflight: DataFrame, aligned: DataFrame) -> DataFrame:
    """doc_id, n_preflight, script_confirmed, n_compared, n_differing, n_term_findings, n_residue, exact.

    matched comes from match_datums, findings are all of a document, preflight has its
    warnings, aligned comes from verify.align. A document of which one of these has no
    row gets nulls there, which mechanical_checks takes for none.
    """
    seen = matched.filter("side = 's' or status = 'added'").groupBy("doc_id").agg(
        F.count("*").alias("n_compared"), F.count_if(F.col("status").isin(DIFFERING)).alias("n_differing")
    )
    found = findings.groupBy("doc_id").agg(
        F.count_if((F.col("category") == "Terminology") & (F.col("severity") != "info")).alias("n_term_findings"),
        F.count_if(F.col("check") == "structure.untranslated_residue").alias("n_residue"),
        F.count_if(F.col("check").startswith("source.")).alias("_source"),
    )
    doubt = F.exists("warnings", lambda w: (w["severity"] == "block") | w["code"].isin(UNCONFIRMED))
    script = preflight.select("doc_id", F.size("warnings").alias("n_preflight"), (~doubt).alias("_script"))
    out = script.join(seen, "doc_id", "full").join(found, "doc_id", "full").join(aligned.select("doc_id", "exact"), "doc_id", "full")
    confirmed = F.coalesce("_script", F.lit(True)) & (F.coalesce("_source", F.lit(0)) == 0)
    return out.withColumn("script_confirmed", confirmed).drop("_script", "_source")


def mechanical_checks(d: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """doc, check, count, passed: seven rows a document.

    With the columns of check_counts the facts compared count, with those added in the
    translation, and the script has to be confirmed; without them n_datums, n_changed
    and n_preflight are taken.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    counted = "n_compared" in d.columns
    rows = [
        ("Script and encoding preflight", n("n_preflight"), F.col("script_confirmed") if counted else n("n_preflight") == 0),
        ("Data extraction and comparison", n("n_compared" if counted else "n_datums"), n("n_differing" if counted else "n_changed") == 0),
        ("Terminology compliance", n("n_terms"), n("n_term_findings") == 0),
        ("Segment coverage", n("n_blocks"), (n("n_empty") == 0) & (n("n_stunted") == 0)),
        ("Sentence-level alignment", n("n_segments"), F.coalesce(F.col("exact"), F.lit(True))),
        ("Untranslated residue", n("n_residue"), n("n_residue") == 0),
        ("Semantic faithfulness review", n("n_verdicts"), F.coalesce(F.col("available") & F.col("complete") & F.col("faithful"), F.lit(False))),
    ]
    checks = F.array(*(F.struct(F.lit(c).alias("check"), k.alias("count"), p.alias("passed")) for c, k, p in rows))
    return d.select(doc_col, F.explode(checks).alias("c")).select(doc_col, "c.*")


def findings_by_severity(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by, "severity").agg(F.count("*").alias("n"))


def top_critical_categories(findings: DataFrame, most: int = 3) -> DataFrame:
    counts = findings.filter("severity = 'critical'").groupBy("category").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "category").limit(most)
