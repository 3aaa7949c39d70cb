"""Findings to a report: sections, evidence, remarks, items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.jsregex import BLANKS, java
from ..rules import report as R
from .score import severity_rank

LOW_OCR = 0.7


def page_confidence(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, confidence: the worst of a page's blocks."""
    return blocks.filter("page_confidence is not null").groupBy("doc_id", "page_no").agg(F.min("page_confidence").alias("confidence"))


def page_ranges(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page_no") -> DataFrame:
    """id, ranges: page numbers as 15–17, 21."""
    rows = pages.select(id_col, F.col(page_col).cast("long").alias("p")).distinct().withColumn("island", F.col("p") - F.row_number().over(Window.partitionBy(id_col).orderBy("p")))
    runs = rows.groupBy(id_col, "island").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    out = runs.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("r"))
    return out.select(id_col, F.array_join(F.transform("r", lambda r: r["t"]), ", ").alias("ranges"))


def is_ocr_noise(c: Column) -> Column:
    noise = X.count_of(c, "[^A-Za-z0-9" + BLANKS + r".,;:'\"“”()\[\]/&%₹$—–-]")
    return c.rlike(X.INDIC) | c.rlike("[*|]") | (X.count_of(c, "[A-Za-z]") < 12) | (noise / F.greatest(F.length(c), F.lit(1)) > 0.12)


def sentences(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, block_ord, pos, text: English that can be quoted, of pages that could be read."""
    ok = blocks.filter(F.coalesce("page_confidence", F.lit(1.0)) >= LOW_OCR) if "page_confidence" in blocks.columns else blocks
    cut = F.split(X.trimmed(F.regexp_replace("target_text", f"[{BLANKS}]+", " ")), r"(?<=[.;])\s+(?=[A-Z0-9“\"(])", -1)
    rows = ok.select("doc_id", "page_no", "block_ord", F.posexplode(F.transform(cut, X.trimmed)).alias("pos", "text"))
    return rows.filter((F.length("text") >= 12) & ~is_ocr_noise(F.col("text")))


def evidence(quotable: DataFrame, most: int = 2) -> DataFrame:
    """doc_id, topic, place, quote: the first distinct sentences on each topic."""
    hits = F.filter(F.array(*(F.when(F.col("text").rlike(java(rx, True)), F.lit(name)) for name, rx in R.TOPICS)), lambda x: x.isNotNull())
    rows = quotable.select("*", F.explode(hits).alias("topic"))
    first = rows.groupBy("doc_id", "topic", F.substring("text", 1, 120).alias("head")).agg(F.min(F.struct("block_ord", "pos", "page_no", "text")).alias("s"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "topic").orderBy("s"))
    quote = F.concat(F.lit("“"), F.col("s.text"), F.lit("” (page "), F.col("s.page_no").cast("string"), F.lit(")"))
    return first.withColumn("place", rank).filter(F.col("place") <= most).select("doc_id", "topic", "place", quote.alias("quote"))


def sections_of(check: Column, claim: Column) -> Column:
    """Numbers of the report's sections that a finding belongs to."""
    found = F.flatten(F.array(*(F.when(claim.rlike(java(rx, True)), F.array(*map(F.lit, nums))).otherwise(F.array().cast("array<int>")) for rx, nums in R.SECTION_WORDS)))
    general = check.rlike(r"^(terminology|term|structure|coverage|semantic)\.")
    return F.when(general, F.array(F.lit(18))).otherwise(F.array_sort(F.array_distinct(F.concat(found, F.array(F.lit(18))))))


def is_material(check: Column) -> Column:
    return (check == "datum.name_spelling_drift") | ~F.startswith(check, F.lit("datum."))


def by_section(findings: DataFrame) -> DataFrame:
    """doc_id, section, heading, findings: a row per section that has any."""
    claim = F.concat_ws(" ", "title", F.coalesce("detail", F.lit(""))) if "detail" in findings.columns else F.col("title")
    rows = findings.filter(is_material(F.col("check"))).select("doc_id", "check", "severity", "title", F.explode(sections_of(F.col("check"), claim)).alias("section"))
    headings = F.element_at(F.create_map(*(F.lit(x) for kv in R.SECTIONS.items() for x in kv)), F.col("section"))
    ranked = F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("rank"), "title")))
    out = rows.groupBy("doc_id", "section").agg(F.transform(ranked, lambda r: r["title"]).alias("findings"))
    return out.withColumn("heading", headings)


def is_curated(check: Column, severity: Column, title: Column, readable: Column, amounts: Column) -> Column:
    """Remarks on title: missing passages, serious gaps on readable pages, names, and the deed's own amounts."""
    serious = severity.isin("critical", "major")
    numbers = F.transform(F.regexp_extract_all(title, F.lit(r"\d[\d,]*"), F.lit(0)), lambda n: F.regexp_replace(n, ",", ""))
    own = F.filter(F.transform(amounts, lambda a: F.regexp_replace(a, "[^0-9]", "")), lambda a: F.length(a) >= 3)
    return (
        F.when(check.isin("structure.translation_missing", "datum.name_spelling_drift"), F.lit(True))
        .when(check.isin("structure.block_stunted", "semantic.omission", "semantic.scope"), serious & readable)
        .when(check == "terminology.not_present", severity == "critical")
        .when(check.isin("datum.currency_missing", "datum.currency_changed"), serious & readable & F.arrays_overlap(numbers, own))
        .otherwise(F.lit(False))
    )


def humanize(check: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(check, r"^[a-z]+\.", ""), "[._]", " "))


def finding_title(title: Column, check: Column) -> Column:
    clean = X.trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, rf'[“"]\s*{X.GUJARATI}+\s*[”"]', ""), f"{X.GUJARATI}+", "[Gujarati]"), f"[{BLANKS}]+", " "))
    clean = F.regexp_replace(clean, r"^\[Gujarati\]\s*", "")
    return F.when(clean.rlike("[A-Za-z]{3,}"), clean).otherwise(humanize(check))


def present(c: Column) -> Column:
    t = X.trimmed(F.coalesce(c, F.lit("")))
    return (t != "") & ~t.rlike("^[_—–-]+$")


_ITEM = "array<struct<t:string,text:string,items:array<string>,rows:array<array<string>>>>"


def _strings() -> Column:
    return F.array().cast("array<string>")


def _some(*parts: Column) -> Column:
    """The parts that aren't null, as an array."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def _item(t: str, text: Column | str = "", items: Column | None = None, rows: Column | None = None) -> Column:
    return F.struct(
        F.lit(t).alias("t"), (F.lit(text) if isinstance(text, str) else text).alias("text"),
        (items if items is not None else _strings()).alias("items"),
        (rows if rows is not None else F.array().cast("array<array<string>>")).alias("rows"),
    )


def property_sentence(facts: DataFrame) -> Column:
    """The description of the property out of its facts (columns of title_facts; others may be absent)."""
    have = lambda c: F.col(c) if c in facts.columns else F.lit("")
    some = lambda c, text: F.when(present(have(c)), text)
    block = F.when(
        present(have("old_block")),
        F.concat(F.lit("old Block No. "), have("old_block"), F.coalesce(some("new_block", F.concat(F.lit(" (now new Block No. "), have("new_block"), F.lit(")"))), F.lit(""))),
    ).otherwise(some("new_block", F.concat(F.lit("Block No. "), have("new_block"))))
    marks = _some(some("rsn", F.concat(F.lit("Revenue Survey No. "), have("rsn"))), block, some("khata", F.concat(F.lit("Khata No. "), have("khata"))))
    place = _some(*(some(c, F.concat(F.lit(f"{label} "), have(c))) for c, label in (("village", "Village"), ("taluka", "Sub-District"), ("district", "District"))))
    clauses = _some(
        F.when(F.size(marks) > 0, F.concat(F.lit("bearing "), F.array_join(marks, ", "))),
        some("area", F.concat(F.lit("admeasuring "), have("area"))),
        F.when(F.size(place) > 0, F.concat(F.lit("situate at "), F.array_join(place, ", "))),
        F.lit("together with all rights, title and interest therein"),
    )
    kind = F.when(have("non_agricultural").cast("boolean"), "Non-Agricultural immovable property").otherwise("immovable property") if "non_agricultural" in facts.columns else F.lit("immovable property")
    sold = some("consideration", F.concat(F.lit(", and sold for a consideration of "), have("consideration"), F.lit(".")))
    return F.concat(F.lit("All that piece and parcel of "), kind, F.lit(" "), F.array_join(clauses, ", "), F.coalesce(sold, F.lit(".")))


def mutation_gap(facts: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, gap: where the last dated revenue entry is older than the deed, what the report has to say of it.

    facts: doc_id, deed_date, owner; entries: doc_id, entry, dated (both dates dd/mm/yyyy).
    """
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("dd/MM/yyyy")).cast("date")
    dated = entries.withColumn("_day", day("dated")).filter("_day is not null")
    last = dated.groupBy("doc_id").agg(F.max(F.struct("_day", "entry", "dated")).alias("l"))
    out = facts.select("doc_id", "deed_date", "owner").join(last, "doc_id").filter(F.col("l._day") < day("deed_date"))
    owner = F.when(present(F.col("owner")), F.concat(F.lit(" in the name of "), F.col("owner"))).otherwise("")
    text = F.concat(
        F.lit("Note: the latest revenue entry recited is "), entry_text(F.col("l.entry"), F.col("l.dated")), F.lit(", which predates the conveyance dated "),
        F.col("deed_date"), F.lit(". No entry recording that conveyance"), owner,
        F.lit(" is recited; whether the purchaser's name has since been mutated is to be confirmed from the current Record of Rights."),
    )
    return out.select("doc_id", text.alias("gap"))


def entry_text(entry: Column, dated: Column) -> Column:
    return F.concat(F.lit("Mutation Entry No. "), entry, F.when(present(dated), F.concat(F.lit(" dated "), dated)).otherwise(""))


def document_bullets(facts: DataFrame, mutations: Column) -> Column:
    """Documents that the source recites, as an array of sentences."""
    have = lambda c: F.col(c) if c in facts.columns else F.lit("")
    some = lambda c, lead, tail="": F.when(present(have(c)), F.concat(F.lit(lead), have(c), F.lit(tail))).otherwise("")
    record = F.when(
        present(have("rsn")) | present(have("khata")),
        F.concat(F.lit("Certified copy of the Record of Rights (Village Form No. 6 / 7-12)"), some("rsn", " for Survey No. "), some("khata", ", Khata No. "), F.lit(".")),
    )
    paid = _some(F.when(present(have("stamp_duty")), F.concat(F.lit("stamp duty "), have("stamp_duty"))), F.when(present(have("registration_fee")), F.concat(F.lit("registration fee "), have("registration_fee"))))
    ref = F.when(present(have("application_no")), F.concat(F.lit("Application No. "), have("application_no"))).otherwise("as recited in the source")
    receipt = F.when(
        (F.size(paid) > 0) | present(have("application_no")),
        F.concat(F.lit("e-Challan / registration receipt ("), ref, F.lit(")"), F.when(F.size(paid) > 0, F.concat(F.lit(" — "), F.array_join(paid, " and "), F.lit(" paid"))).otherwise(""), F.lit(".")),
    )
    copies = F.transform(mutations, lambda m: F.concat(F.lit("Certified copy of "), m))
    out = F.concat(_some(record), copies, _some(deed_line(facts), receipt))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(R.SAYS["no_documents"])))


def deed_line(facts: DataFrame) -> Column:
    """The instrument under which the owner holds; null if neither is known."""
    owner, no, date = F.col("owner"), F.col("deed_no"), F.col("deed_date")
    dated = F.when(present(date), F.concat(F.lit(" dated "), date)).otherwise("")
    seller = F.when(present(F.col("seller")), F.concat(F.lit(" executed by "), F.col("seller"))).otherwise("") if "seller" in facts.columns else F.lit("")
    favour = F.when(present(owner), F.concat(F.lit(" in favour of "), owner)).otherwise("")
    return F.when(present(no), F.concat(F.lit("Registered instrument No. "), no, dated, seller, favour, F.lit("."))).when(
        present(owner), F.concat(F.lit("The instrument or order by which "), owner, F.lit(" derives title, as recited in the source."))
    )


def report_items(
    facts: DataFrame,
    sections: DataFrame,
    *,
    quotes: DataFrame | None = None,
    mutations: DataFrame | None = None,
    register: DataFrame | None = None,
    checks: DataFrame | None = None,
    scores: DataFrame | None = None,
    low_pages: DataFrame | None = None,
    company: str = "",
) -> DataFrame:
    """doc_id, items: the report as a list of headings, paragraphs, bullets and tables.

    facts come from title_facts, sections from by_section, quotes from evidence,
    mutations (doc_id, pos, entry, dated) from mutation_entries, register (doc_id,
    place, severity, title, check, category) lists all findings, checks come from
    mechanical_checks, scores have total, grade and the judge's columns, low_pages
    come from page_ranges. What is left out is taken to be empty. 22 sections, the
    record of checks and the register of findings, in this order.
    """
    joined = facts

    def gathered(df: DataFrame | None, order: list[str], value: Column, name: str, kind: str = "array<string>") -> None:
        nonlocal joined
        if df is None:
            joined = joined.withColumn(name, F.array().cast(kind))
            return
        rows = df.select("doc_id", F.struct(*order, value.alias("_v")).alias("_s")).groupBy("doc_id").agg(F.array_sort(F.collect_list("_s")).alias("_l"))
        joined = joined.join(rows.select("doc_id", F.transform("_l", lambda s: s["_v"]).alias(name)), "doc_id", "left")
        joined = joined.withColumn(name, F.coalesce(name, F.array().cast(kind)))

    per_doc = sections.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "findings"))).alias("_sections"))
    joined = joined.join(per_doc, "doc_id", "left")
    gathered(mutations, ["pos"], entry_text(F.col("entry"), F.col("dated")) if mutations is not None else F.lit(""), "_mutations")
    if mutations is not None:
        joined = joined.join(mutation_gap(facts, mutations), "doc_id", "left")
    else:
        joined = joined.withColumn("gap", F.lit(None).cast("string"))
    topics = sorted({t for t, _ in R.QUOTING.values()} | {"encumbrance", "agricultural"})
    for topic in topics:
        gathered(None if quotes is None else quotes.filter(F.col("topic") == topic), ["place"], F.col("quote"), f"_q_{topic}")
    entry = F.concat(F.lit("["), F.upper("severity"), F.lit("]  "), F.col("title"), F.lit(" · "), F.col("category"), F.lit(" · "), F.col("check"))
    gathered(register, ["place"], entry if register is not None else F.lit(""), "_register")
    row = F.array(F.col("check"), F.when(F.col("passed"), "PASS").otherwise("FLAG"), F.col("count").cast("string"))
    gathered(checks, ["check"], row if checks is not None else F.lit(""), "_checks", "array<array<string>>")
    if scores is not None:
        shown = F.concat(F.round(F.col("total") * 100, 1).cast("string"), F.lit("% ("), F.upper("grade"), F.lit(")"))
        joined = joined.join(scores.select("doc_id", shown.alias("_indicator")), "doc_id", "left")
    else:
        joined = joined.withColumn("_indicator", F.lit("not computed"))
    if low_pages is not None:
        joined = joined.join(low_pages.select("doc_id", F.col("ranges").alias("_low")), "doc_id", "left")
    else:
        joined = joined.withColumn("_low", F.lit(None).cast("string"))
    joined = joined.withColumn("_property", property_sentence(facts))

    found = lambda n: F.coalesce(F.try_element_at("_sections", F.lit(n)), _strings())
    or_missing = lambda c: F.when(present(c), c).otherwise(R.MISSING)
    or_else = lambda quotes_of, text: F.when(F.size(quotes_of) > 0, quotes_of).otherwise(F.array(F.lit(text)))
    deed = F.concat(F.lit("registered Sale Deed No. "), F.col("deed_no"), F.when(present(F.col("deed_date")), F.concat(F.lit(" dated "), F.col("deed_date"))).otherwise(""))
    has_deed, has_owner, has_remarks = present(F.col("deed_no")), present(F.col("owner")), F.size(found(18)) > 0
    documents = document_bullets(facts, F.col("_mutations"))
    sides = F.map_from_entries(F.transform("boundaries", lambda b: F.struct(b["label"], b["value"])))
    borders = F.array(*(F.array(F.lit(f"Towards {s}"), F.coalesce(F.try_element_at(sides, F.lit(s)), F.lit("Not stated in the source"))) for s in R.SIDES))
    remarks = F.concat(
        F.when(has_remarks, F.array(F.concat(F.size(found(18)).cast("string"), F.lit(" title-relevant remark(s) arise from the automated verification of the English translation. They are recorded here for the Advocate's decision; they are not findings on title itself."))))
        .otherwise(F.array(F.lit(R.SAYS["no_remark"]))),
        _some(F.when(F.col("_low").isNotNull(), F.concat(F.lit("Source page(s) "), F.col("_low"), F.lit(" were read at low OCR confidence. Passages from those pages are summarised rather than quoted, and every fact taken from them must be checked against the original before reliance.")))),
    )
    flow = F.concat(F.transform("_mutations", lambda m: F.concat(F.lit("Revenue record: "), m)), _some(deed_line(facts)))
    certified = F.concat(
        F.lit("THIS IS TO CERTIFY that "), F.col("owner"), F.lit(" is the owner of the property more particularly described in paragraph 3 above, having derived title under "),
        F.when(has_deed, deed).otherwise("the registered instrument recited in this report"),
        F.lit(", and that on the basis of the documents and recitals referred to above the title is clear and marketable and free from encumbrances"),
        F.when(has_remarks, ", subject to the remarks recorded at paragraph 18 and Annexure B being resolved").otherwise(""), F.lit("."),
    )
    uncertified = "THIS IS TO CERTIFY that the owner named in the source is the owner of the property more particularly described in paragraph 3 above, having derived title under the registered instrument recited in this report, subject to the findings recorded at paragraph 18 and Annexure B."
    one = lambda c: F.array(c if isinstance(c, Column) else F.lit(c))
    bodies: dict[int, Column] = {
        1: one(or_missing(F.col("owner"))), 2: one(or_missing(F.col("constitution"))), 3: one(F.col("_property")),
        4: one(F.when(F.size("_mutations") > 0, R.SAYS["mutations"]).otherwise(R.SAYS["no_mutations"])),
        5: one(R.SAYS["documents"]), 7: F.array(F.lit(R.SAYS["flow"]), F.concat(F.lit("The property is described as: "), F.col("_property"))),
        8: F.array(
            F.concat(F.lit("The instrument recited in the source is "), F.when(has_deed, deed).otherwise("described at paragraph 5"), F.lit(", supported by the revenue mutations recorded at paragraph 4.")),
            F.lit(R.SAYS["link"]),
        ),
        14: F.concat(one(R.SAYS["search"]), _some(F.when(F.size("_q_encumbrance") > 0, F.concat(F.lit("The source itself records: "), F.array_join("_q_encumbrance", " "))))),
        15: one(R.SAYS["mortgage"]),
        16: F.concat(_some(F.when(has_deed, F.concat(F.lit("The source records the registration under "), deed, F.lit(".")))), one(R.SAYS["inspection"])),
        17: one(F.when(F.size("_q_agricultural") > 0, F.concat(F.lit("Non-Agricultural land: "), F.get("_q_agricultural", F.lit(0)))).otherwise(R.MISSING)),
        18: remarks, 19: one(R.SAYS["deposit"]),
        20: F.concat(one(F.concat(F.lit("Automated quality indicator: "), F.col("_indicator"), F.lit(" — a review-prioritisation score, not a measure of translation accuracy."))),
                     F.array(*(F.lit(f"Limitation: {x}") for x in R.LIMITATIONS), F.lit(R.SAYS["drafts"]), F.lit(R.SAYS["automated"]))),
        21: one(F.when(has_owner, certified).otherwise(uncertified)),
        22: one(F.concat(F.lit("This is to certify that the property is enforceable under the SARFAESI Act, 2002, subject to the original documents referred to in paragraph 19 being deposited with "), F.lit(company or "the Bank"), F.lit(" together with the registered deed of mortgage."))),
    } | {n: or_else(F.col(f"_q_{topic}"), text) for n, (topic, text) in R.QUOTING.items()}
    bullets = {
        4: F.concat("_mutations", F.filter(F.array("gap"), lambda g: g.isNotNull())), 5: documents, 7: flow, 18: found(18), 19: documents,
    }
    parts = [F.array(_item("p", "(Advocate)"), _item("h1", "TITLE CLEARANCE REPORT"), _item("p", "To,"), _item("p", "The Manager,"), _item("p", company or R.MISSING))]
    for n, heading in R.SECTIONS.items():
        parts.append(F.array(_item("h2", f"{n}.  {heading}:")))
        parts.append(F.transform(bodies[n], lambda b: _item("p", b)))
        if n == 3:
            parts.append(F.array(_item("borders", rows=borders)))
        if n in bullets:
            parts.append(F.when(F.size(bullets[n]) > 0, F.array(_item("bullets", items=bullets[n]))).otherwise(F.array().cast(_ITEM)))
        if n != 18:
            few = F.concat(F.array_join(F.slice(found(n), 1, 4), "; "), F.when(F.size(found(n)) > 4, "; …").otherwise(""))
            line = F.concat(F.lit("Corresponding automated finding(s): "), F.size(found(n)).cast("string"), F.lit(" — "), few, F.lit(". See Annexure B."))
            parts.append(F.when(F.size(found(n)) > 0, F.array(_item("p", line))).otherwise(F.array().cast(_ITEM)))
    numbered = F.transform("_register", lambda r, i: F.concat((i + 1).cast("string"), F.lit(".  "), r))
    parts += [
        F.array(_item("page"), _item("h1", "ANNEXURE A — AUTOMATED VERIFICATION RECORD"), _item("p", R.SAYS["annexure_a"]), _item("table", rows=F.col("_checks")), _item("page")),
        F.array(_item("h1", F.concat(F.lit("ANNEXURE B — FINDINGS REGISTER ("), F.size("_register").cast("string"), F.lit(")"))), _item("p", R.SAYS["annexure_b"])),
        F.when(F.size("_register") > 0, F.transform(numbered, lambda r: _item("p", r))).otherwise(F.array(_item("p", R.SAYS["no_findings"]))),
        F.array(_item("p", "Place: ________________"), _item("p", "Date:  ________________"), _item("p", "Advocate")),
    ]
    return joined.select("doc_id", F.concat(*parts).alias("items"))


def narrative(scores: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """doc_id, summary, focus, limitations, action: what the numbers say, in a fixed form.

    scores: n_critical, n_major, n_minor, n_datums, n_terms, n_blocks, n_segments and
    the judge's columns; categories: doc_id, category, n of critical findings. Nulls
    count as none.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in scores.columns else F.lit(0)
    text = lambda c: n(c).cast("string")
    available, complete = (F.coalesce(F.col(c), F.lit(False)) for c in ("available", "complete"))
    covered = (
        F.when(available & complete, "The meaning-level review covered every block.")
        .when(available, F.concat(F.lit("The meaning-level review covered "), text("blocks_judged"), F.lit(" of "), text("blocks_total"), F.lit(" blocks; the rest rely on deterministic checks.")))
        .otherwise("The meaning-level review did not run, so negation, modality and scope were not assessed.")
    )
    total = (n("n_critical") + n("n_major") + n("n_minor")).cast("string")
    summary = F.concat(
        F.lit("Automated checks compared "), text("n_datums"), F.lit(" data item(s) and "), text("n_terms"), F.lit(" terminology occurrence(s) across "),
        text("n_blocks"), F.lit(" block(s), producing "), text("n_segments"), F.lit(" English segment(s). "), total, F.lit(" finding(s) were raised: "),
        text("n_critical"), F.lit(" critical, "), text("n_major"), F.lit(" major and "), text("n_minor"), F.lit(" minor. "), covered,
    )
    out = scores
    if categories is not None:
        top = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "category")))
        listed = F.transform(F.slice("_t", 1, 3), lambda s: F.concat(F.lit("The "), (-s["m"]).cast("string"), F.lit(" critical "), F.lower(s["category"]), F.lit(" finding(s) listed below.")))
        out = out.join(categories.groupBy("doc_id").agg(top.alias("_t")).select("doc_id", listed.alias("_top")), "doc_id", "left")
    else:
        out = out.withColumn("_top", _strings())
    focus = F.when(n("n_critical") + n("n_major") + n("n_minor") == 0, F.array(F.lit(R.NO_FOCUS))).otherwise(
        F.concat(F.coalesce("_top", _strings()), F.array(*map(F.lit, R.FOCUS)))
    )
    limits = F.array(*map(F.lit, R.LIMITATIONS), F.when(available & complete, R.JUDGED).otherwise(R.NOT_JUDGED))
    action = F.when(n("n_critical") > 0, R.ACTIONS[True]).otherwise(R.ACTIONS[False])
    return out.select("doc_id", summary.alias("summary"), focus.alias("focus"), limits.alias("limitations"), action.alias("action"))


def report_status(final: Column, available: Column, complete: Column, pending: Column | None = None) -> Column:
    """struct(status, semantic_audit): draft or final; complete, partial, skipped, or pending in a draft."""
    audit = F.when(F.coalesce(available, F.lit(False)), F.when(F.coalesce(complete, F.lit(False)), "complete").otherwise("partial")).otherwise("skipped")
    waiting = ~final if pending is None else pending
    return F.struct(F.when(final, "final").otherwise("draft").alias("status"), F.when(waiting, "pending").otherwise(audit).alias("semantic_audit"))
