"""Pages to blocks, and what can be said of a document before it is translated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.jsregex import BLANKS, java
from ..rules import doctypes
from ..rules import structure as R


def dense_pieces(line: Column, most: int = R.DENSE) -> Column:
    """A line as an array of lines of at most about `most` characters.

    Longer ones are cut after sentences and filled up again; without a sentence
    end they are cut by length.
    """
    parts = F.split(line, rf"(?<=[।.])[{BLANKS}]+(?=[઀-૿A-Z0-9\"“])", -1)
    parts = F.filter(F.transform(parts, X.trimmed), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def fill(state: Column, p: Column) -> Column:
        full = F.length(state["buf"]) + 1 + F.length(p) > most
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(X.trimmed(state["buf"])))).otherwise(state["out"]).alias("out"),
            F.when(full | (state["buf"] == ""), p).otherwise(F.concat(state["buf"], F.lit(" "), p)).alias("buf"),
        )

    packed = F.aggregate(parts, start, fill, lambda s: F.concat(s["out"], F.array(X.trimmed(s["buf"]))))
    steps = F.sequence(F.lit(0), F.greatest(F.floor((F.length(line) - 1) / most), F.lit(0)).cast("int"))
    wrapped = F.transform(steps, lambda i: X.trimmed(F.substr(line, i * most + 1, F.lit(most))))
    out = F.when(F.length(line) <= most, F.array(line)).when(F.size(parts) > 1, packed).otherwise(wrapped)
    return F.filter(out, lambda x: x != "")


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, pos, line: a page's lines, long ones cut."""
    raw = F.filter(F.transform(F.split("text", "\n+", -1), X.trimmed), lambda x: x != "")
    lines = F.flatten(F.transform(raw, lambda x: dense_pieces(x)))  # noqa: PLW0108
    keep = [c for c in ("kind", "confidence") if c in pages.columns]
    return pages.select("doc_id", "page_no", *keep, F.posexplode(lines).alias("pos", "line"))


def is_footer(line: Column) -> Column:
    return line.rlike(java(R.FOOTER, True)) & (F.length(line) < R.MOST["footer"])


def line_kind(line: Column, mean_length: Column) -> Column:
    """The kind of a line; the first that fits."""
    n, hit = F.length(line), lambda rx, any_case=False: line.rlike(java(rx, any_case))
    label = F.regexp_extract(line, java(R.CLAUSE, True), 1)
    letters = F.regexp_replace(line, "[^A-Za-z]", "")
    out = F.when(is_footer(line), "footer")
    for kind, rx, any_case in R.HEADINGS:
        out = out.when(hit(rx, any_case) & (n < R.MOST["heading"]), kind)
    return (
        out.when(hit(R.CASE_NUMBER, True) & (n < R.MOST["case_number"]), "case_number")
        .when(hit(R.SEAL, True) & (n < R.MOST["seal_note"]), "seal_note")
        .when(hit(R.SIGNATURE, True) & (n < R.MOST["signature_block"]), "signature_block")
        .when(hit(R.CITATION) & (n < mean_length * 0.8) & (n < R.MOST["citation"]), "citation")
        .when(label != "", F.when(F.contains(label, F.lit(".")), "sub_clause").otherwise("clause"))
        .when(hit(R.LIST_ITEM) & (n < mean_length * 1.5), "list_item")
        .when(hit(R.QUOTE) & (n < R.MOST["quotation"]), "quotation")
        .when((n < R.MOST["heading_2"]) & (letters != "") & (letters == F.upper(letters)) & line.rlike(X.INDIC), "heading_2")
        .otherwise("body")
    )


def detect_structure(pages: DataFrame) -> DataFrame:
    """doc_id, block_ord, block_id, page_no, kind, source_text, clause_label, clause_depth, synthetic.

    Lines in order, one footer with the page's number after every page but the
    first. If a document's first line names a court it stands there twice, as the
    court's name and as what it is as a line. Documents are independent of each
    other; one is put in order at a time.
    """
    lines = page_lines(pages)
    mean = F.avg(F.length("line")).over(Window.partitionBy("doc_id", "page_no"))
    kinds = lines.withColumn("mean", mean).withColumn("kind", line_kind(F.col("line"), F.col("mean")))
    label = X.trimmed(F.regexp_extract("line", java(R.CLAUSE, True), 1))
    in_clause = F.col("kind").isin("clause", "sub_clause")
    body = kinds.select(
        "doc_id", "page_no", "pos", "kind", F.col("line").alias("source_text"),
        F.when(in_clause, label).alias("clause_label"),
        F.when(in_clause, F.size(F.split(label, r"\.", -1))).alias("clause_depth"),
        F.lit(False).alias("synthetic"),
    )
    feet = lines.filter("page_no > 1").select("doc_id", "page_no").distinct()
    feet = feet.select(
        "doc_id", "page_no", F.lit(1 << 30).alias("pos"), F.lit("footer").alias("kind"),
        F.concat(F.lit("— "), F.col("page_no").cast("string"), F.lit(" —")).alias("source_text"),
        F.lit(None).cast("string").alias("clause_label"), F.lit(None).cast("int").alias("clause_depth"),
        F.lit(True).alias("synthetic"),
    )
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "pos"))
    named = F.col("source_text").rlike(java(R.COURT_NAME)) & (F.length("source_text") < R.MOST["court_name"])
    courts = body.withColumn("_first", first).filter(F.col("_first") == 1).filter(named).drop("_first").withColumns({
        "pos": F.lit(-1), "kind": F.lit("court_name"), "clause_label": F.lit(None).cast("string"), "clause_depth": F.lit(None).cast("int"),
    })
    body = body.unionByName(courts)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "pos")) - 1
    out = body.unionByName(feet).withColumn("block_ord", order)
    return out.withColumn("block_id", F.concat(F.lit("b"), (F.col("block_ord") + 1).cast("string"))).drop("pos")


def without_footers(blocks: DataFrame) -> DataFrame:
    return blocks.filter("kind != 'footer'")


def preflight(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds warnings (array of struct code, severity) and ok: none of them blocks."""
    profile, legacy = X.script_profile(text_col), X.legacy_encoding(text_col)
    indic = X.contains_indic(text_col)
    found = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    out = df.withColumns({"_p": profile, "_l": legacy, "_i": indic})
    script_warning = (
        F.when(~F.col("_i"), found("not_indic", "warn"))
        .when(~X.is_gujarati(text_col) & (F.col("_p.script") == "devanagari"), found("wrong_script", "block"))
        .when(F.col("_p.gujarati_ratio") < 0.15, found("low_gujarati", "warn"))
    )
    warnings = F.array(
        F.when(F.col("_l.suspected"), found("legacy_encoding", "block")),
        script_warning,
        F.when((F.col("_p.latin_ratio") > 0.5) & F.col("_i"), found("mixed_script", "info")),
    )
    out = out.withColumn("warnings", F.filter(warnings, lambda w: w.isNotNull()))
    ok = ~F.exists("warnings", lambda w: w["severity"] == "block")
    return out.withColumn("ok", ok).withColumns({"script": F.col("_p.script"), "legacy": F.col("_l")}).drop("_p", "_l", "_i")


def _adds(weight: float):
    def step(total: Column, n: Column) -> Column:
        return total + F.when(n > 0, weight * (1 + F.log2(1 + n) / 4)).otherwise(F.lit(0.0))

    return step


def _counted(text: Column, low: Column, rx: str, any_case: bool) -> Column:
    """How often a text matches; one that lacks what the pattern needs isn't searched."""
    needed = X.has_any(low if any_case else text, doctypes.NEEDS.get(rx, [rx]))
    return F.when(needed, F.regexp_count(text, F.lit(java(rx, any_case)))).otherwise(0)


def doc_type(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, type, confidence, top_score, runner_up: the type whose patterns weigh most.

    A pattern found n times adds weight * (1 + log2(1 + n) / 4). Too close a race of
    low scores is `other_legal`. No join: the rules are expressions. Most texts have
    nothing of most patterns, which a search for plain parts of these tells first.
    """
    scores = []
    # A generator keeps what is worked out from being so again wherever it is used; here the text in lower case.
    df = df.select(F.col(id_col), F.inline(F.array(F.struct(F.col(text_col).alias("_text"), X.any_case(text_col).alias("_low")))))
    for name, weight, patterns in doctypes.RULES:
        counts = F.array(*(_counted(F.col("_text"), F.col("_low"), rx, flags == "i") for rx, flags in patterns))
        scores.append(F.struct(F.aggregate(counts, F.lit(0.0), _adds(weight)).alias("score"), F.lit(-len(scores)).alias("rank"), F.lit(name).alias("name")))
    ranked = df.select(F.col(id_col), F.inline(F.array(F.struct(F.sort_array(F.array(*scores), asc=False).alias("r")))))
    top, second = F.col("r")[0]["score"], F.col("r")[1]["score"]
    margin = F.when(second > 0, (top - second) / top).otherwise(F.lit(1.0))
    other = (margin < 0.18) & (top < 6)
    confidence = F.when(other, F.least(F.lit(0.5), top / 12)).otherwise(F.least(F.lit(0.98), 0.55 + margin * 0.4))
    return ranked.select(
        id_col,
        F.when((top == 0) | other, "other_legal").otherwise(F.col("r")[0]["name"]).alias("type"),
        F.when(top == 0, F.lit(0.0)).otherwise(F.round(confidence, 3)).alias("confidence"),
        F.round(top, 6).alias("top_score"),
        F.when(second > 0, F.col("r")[1]["name"]).alias("runner_up"),
    )
