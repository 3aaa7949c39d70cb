"""Title facts and the letterhead of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.jsregex import BLANKS, java
from ..rules import facts as R
from .datums import spans

MISSING = "____________"


def document_text(blocks: DataFrame, text_col: str = "source_text") -> DataFrame:
    """doc_id, text: blocks in order, one line each, with ASCII digits."""
    ordered = F.array_sort(F.collect_list(F.struct("block_ord", F.coalesce(text_col, F.lit("")).alias("t"))))
    out = blocks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n").alias("text"))
    return out.withColumn("text", X.to_ascii_digits("text"))


def first_of(text: Column, patterns: list[str], any_case: bool = False) -> Column:
    """What the first pattern that matches captures, folded; empty if none does."""
    found = [F.nullif(X.trimmed(F.regexp_replace(F.regexp_extract(text, java(p, any_case), 1), f"[{BLANKS}]+", " ")), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(""))


def deed_date(text: Column) -> Column:
    """dd/mm/yyyy from a written month, the last labelled date, or the last date of this century."""
    day, word, year = (F.regexp_extract(text, java(R.WRITTEN_DATE), i) for i in (1, 2, 3))
    month = F.lit(None).cast("int")
    for rx, n in R.MONTH_STEMS[::-1]:
        month = F.when(word.rlike(rx), F.lit(n)).otherwise(month)
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    written = F.when((day != "") & month.isNotNull(), F.concat_ws("/", pad(day), pad(month), year))

    def last(rx: str) -> Column:
        d, m, y = (F.try_element_at(F.regexp_extract_all(text, F.lit(java(rx)), F.lit(i)), F.lit(-1)) for i in (1, 2, 3))
        return F.when(d.isNotNull(), F.concat_ws("/", pad(d), pad(m), F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)))

    return F.coalesce(written, last(R.LABELLED_DATE), last(R.RECENT_DATE), F.lit(""))


def stamp_duty(text: Column, consideration: Column) -> Column:
    """The smallest amount with its words that isn't the consideration, best one not in lakhs."""
    raw = F.regexp_extract_all(text, F.lit(java(R.AMOUNT_IN_WORDS, True)), F.lit(1))
    words = F.regexp_extract_all(text, F.lit(java(R.AMOUNT_IN_WORDS, True)), F.lit(2))
    pairs = F.zip_with(raw, words, lambda r, w: F.struct(F.regexp_replace(r, ",", "").try_cast("double").alias("n"), r.alias("raw"), w.alias("words")))
    cons = F.regexp_replace(consideration, "[^0-9]", "").try_cast("double")
    other = F.filter(pairs, lambda p: (p["n"] > 0) & (cons.isNull() | (p["n"] != cons)))
    small = F.filter(other, lambda p: ~p["words"].rlike(java(r"\blakh\b", True)))
    return F.coalesce(F.array_min(small)["raw"], F.array_min(other)["raw"], F.nullif(F.regexp_extract(text, java(R.STAMP_GUJARATI), 1), F.lit("")), F.lit(""))


def boundaries(text: Column) -> Column:
    """array of struct(label, value): the first adjoining property in each direction."""
    found = F.transform(spans(text, "|".join(R.DIRECTIONS)), lambda s: F.struct(s["surface"].alias("word"), F.substr(text, s["end"] + 1, F.lit(60)).alias("after")))

    def row(f: Column) -> Column:
        at = F.instr(f["after"], "લાગુ")
        line = X.trimmed(F.regexp_replace(F.regexp_extract(F.substr(f["after"], at + 4, F.lit(60)), r"^([^\r\n]*)", 1), f"[{BLANKS}]+", " "))
        block = F.regexp_extract(line, java(R.BLOCK_NO), 1)
        value = F.when(block != "", F.concat(F.lit("Adjacent Block No. "), block)).otherwise(F.initcap(X.transliterate(line)))
        label = F.lit("West")
        for word, name in R.DIRECTIONS.items():
            label = F.when(f["word"] == word, F.lit(name)).otherwise(label)
        return F.struct(label.alias("label"), F.when((at > 0) & (at <= 31) & (line != ""), value).alias("value"))

    rows = F.filter(F.transform(found, row), lambda r: r["value"].isNotNull())
    firsts = [F.get(F.filter(rows, _is(name)), 0) for name in ("North", "South", "East", "West")]
    return F.filter(F.array(*firsts), lambda r: r.isNotNull())


def _is(name: str):
    def test(r: Column) -> Column:
        return r["label"] == name

    return test


def title_facts(blocks: DataFrame) -> DataFrame:
    """doc_id and the facts of a title document; what isn't stated stays empty."""
    docs = document_text(blocks)
    t = F.col("text")
    amount = X.max_rupee(t)
    money = lambda raw: F.when(raw != "", F.concat(F.lit("Rs. "), X.indian_group(F.regexp_replace(raw, "[^0-9]", "")), F.lit("/-"))).otherwise("")
    name = lambda raw: F.when(raw == "", F.lit(MISSING)).otherwise(F.initcap(X.transliterate(raw)))
    out = docs.withColumn("_amount", F.coalesce(amount, F.lit("")))
    facts = {
        "owner": name(first_of(t, R.OWNER)), "seller": name(first_of(t, R.SELLER)),
        "constitution": F.when(t.rlike(java(R.ENTITY)), "Company / LLP (as recorded in the source)").otherwise("Individual (as recorded in the source)"),
        "village": F.initcap(X.transliterate(first_of(t, R.VILLAGE))),
        "rsn": first_of(t, R.SURVEY), "old_block": first_of(t, R.OLD_BLOCK), "new_block": first_of(t, R.NEW_BLOCK), "khata": first_of(t, R.KHATA),
        "area": F.when(first_of(t, R.AREA) != "", F.concat(first_of(t, R.AREA), F.lit(" Sq. Mtrs"))).otherwise(""),
        "consideration": F.when(F.col("_amount") != "", F.concat(F.lit("Rs. "), F.col("_amount"), F.lit("/-"))).otherwise(""),
        "stamp_duty": money(stamp_duty(t, F.col("_amount"))), "registration_fee": money(first_of(t, R.FEE)),
        "application_no": first_of(t, R.APPLICATION, True), "deed_no": first_of(t, R.DEED_NO, True), "deed_date": deed_date(t),
        "boundaries": boundaries(t),
    }
    return out.withColumns(facts).drop("text", "_amount")


def mutation_entries(blocks: DataFrame, most: int = 12) -> DataFrame:
    """doc_id, pos, entry, dated: the first distinct entries of the record of rights, with a date close behind."""
    docs = document_text(blocks)
    found = F.transform(
        spans(F.col("text"), java(R.NOTE)),
        lambda s: F.struct(F.regexp_extract(s["surface"], java(R.NOTE), 1).alias("raw"), F.substr(F.col("text"), s["end"] + 1, F.lit(90)).alias("tail")),
    )
    rows = docs.select("doc_id", F.posexplode(found).alias("pos", "f"))
    entry = F.regexp_replace(F.regexp_replace("f.raw", "^ર", "2"), "[^0-9]", "")
    rows = rows.select("doc_id", "pos", entry.alias("entry"), F.regexp_extract("f.tail", java(r"\b([0-9]{2}/[0-9]{2}/[0-9]{4})\b"), 1).alias("dated"))
    first = rows.filter("entry != ''").groupBy("doc_id", "entry", "dated").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return first.withColumn("_r", rank).filter(F.col("_r") <= most).select("doc_id", "pos", "entry", F.nullif("dated", F.lit("")).alias("dated"))


# Letterhead


def _words(t: Column) -> Column:
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"[{BLANKS}]+")))


def is_title(t: Column, kind: Column) -> Column:
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    caps = X.count_of(t, "[A-Z]") / F.greatest(F.length(letters), F.lit(1))
    by_text = F.when(X.contains_indic(t), t.rlike(R.TITLE_GUJARATI) & (_words(t) <= 10)).otherwise(
        (F.length(letters) >= 4) & (caps > 0.8) & t.rlike(java(R.TITLE_ENGLISH, True))
    )
    return (kind == "document_title") | (F.length(t).between(4, 95) & (_words(t) <= 12) & by_text)


def corporate_part(t: Column) -> Column:
    """The first part of a line that names a legal person; null without one."""
    parts = F.transform(F.split(t, "[,;·|/]"), lambda p: X.trimmed(F.regexp_replace(X.trimmed(p), "[.,;:]+$", "")))
    good = F.filter(parts, lambda s: F.length(s).between(3, 80) & ~s.rlike(java(R.ROLE_ENGLISH, True)) & ~s.rlike(java(R.ROLE_GUJARATI)) & (s.rlike(java(R.COMPANY_ENGLISH, True)) | s.rlike(R.COMPANY_GUJARATI)))
    return F.regexp_replace(F.get(good, 0), f"[{BLANKS}]+", " ")


def report_pattern(blocks: DataFrame) -> DataFrame:
    """doc_id, letterhead, title, addressee, company, body_start.

    The title is the first line that looks like one, else the first heading among
    the first 13 blocks with nothing but short lines above. The addressee starts
    right below it and goes on while lines look like an address, eight at most.
    """
    w = Window.partitionBy("doc_id").orderBy("block_ord")
    t = X.trimmed("source_text")
    rows = blocks.select("doc_id", "block_ord", "kind", t.alias("t"))
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "is_title": is_title(F.col("t"), F.col("kind"))})
    short = F.length("t").between(1, 95)
    all_short = F.min(F.when(short, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    heading = F.col("kind").isin("heading_1", "heading_2") & F.col("i").between(1, 12)
    rows = rows.withColumns({"short_above": F.coalesce(all_short, F.lit(1)), "heading": heading})
    doc = Window.partitionBy("doc_id")
    direct = F.min(F.when(F.col("is_title"), F.col("i"))).over(doc)
    first_heading = F.min(F.when(F.col("kind").isin("heading_1", "heading_2"), F.col("i"))).over(doc)
    fallback = F.min(F.when(F.col("heading") & (F.col("i") == first_heading) & (F.col("short_above") == 1), F.col("i"))).over(doc)
    rows = rows.withColumn("ti", F.coalesce(direct, fallback))
    n = _words(F.col("t"))
    more = (
        short & ~F.col("kind").isin("document_title", "page_break") & ~F.col("t").rlike("^[-=_*#]+$")
        & ~(F.col("t").rlike(java(R.SECTION_LABEL)) & ~F.col("t").rlike(r"^\d")) & (n <= 7) & ~F.col("t").rlike(java(R.BODY_VERB, True))
        & ~(F.col("t").rlike(java(R.SENTENCE_END)) & (n > 4))
    )
    nth = F.col("i") - F.col("ti")
    fits = F.when(nth == 1, F.col("t").rlike(java(R.ADDRESSEE, True))).when(nth > 8, F.lit(False)).otherwise(more)
    below = F.min(F.when(nth >= 1, F.when(fits, 1).otherwise(0))).over(w)
    rows = rows.withColumn("addressed", (nth >= 1) & (below == 1))
    lines = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("i", "t")))), lambda s: s["t"])
    company = F.struct(F.when(F.col("addressed"), 0).otherwise(1).alias("o"), F.col("i"), corporate_part(F.col("t")).alias("c"))
    named = (F.col("addressed") | ((nth < 0) & (F.col("i") < 12))) & corporate_part(F.col("t")).isNotNull()
    return rows.groupBy("doc_id").agg(
        F.slice(F.filter(lines(nth < 0), lambda x: x != ""), 1, 12).alias("letterhead"),
        F.max(F.when(nth == 0, F.col("t"))).alias("title"),
        lines(F.col("addressed")).alias("addressee"),
        F.min(F.when(named, company))["c"].alias("company"),
        F.coalesce(F.max(F.when(F.col("addressed") | (nth == 0), F.col("i"))) + 1, F.lit(0)).alias("body_start"),
    )


def addressee_lines(addressee: Column, company: Column, override: Column) -> Column:
    """Lines of the addressee with the company replaced, or put in after the last role line."""
    has = F.exists(addressee, lambda x: F.contains(x, F.coalesce(company, F.lit("\u0000"))))
    replaced = F.transform(addressee, lambda x: F.when(F.contains(x, F.coalesce(company, F.lit("\u0000"))), override).otherwise(x))
    roles = F.transform(addressee, lambda x, i: F.when(x.rlike(java(R.ROLE_ENGLISH, True)) | x.rlike(java(R.ROLE_GUJARATI)), i + 2))
    at = F.coalesce(F.array_max(roles), F.size(addressee) + 1)
    inserted = F.array_insert(addressee, at, override)
    none = F.coalesce(override, F.lit("")) == ""
    return F.when(none, addressee).when(F.size(addressee) == 0, F.array(F.lit("To,"), override)).when(has, replaced).otherwise(inserted)
