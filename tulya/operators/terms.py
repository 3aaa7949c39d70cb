"""Terminology: which terms a document uses and whether its translation keeps them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..rules import glossary as G

def term_key(s: str) -> str:
    return re.sub(r"[\s.]+", "", re.sub("[‌‍]", "", s)).lower()


def literal_candidates(target: str) -> list[str]:
    """Phrases of two words and more, from the head and the gloss, that tell a literal rendering; longest first."""
    head = target.split(" (")[0]
    gloss = re.search(r"\(([^()]+)\)", target)
    out = {}
    for part in [head, *([gloss[1]] if gloss else [])]:
        words = part.split()
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                phrase = " ".join(words[i:j])
                if not all(w.lower() in G.STOP_WORDS for w in words[i:j]) and phrase.lower() not in head.lower():
                    out[phrase] = None
    return sorted(out, key=lambda p: -len(p))


def glossary(spark: SparkSession, entries: Iterable[tuple] | None = None, custom: Iterable[tuple] = ()) -> DataFrame:
    """A row per spelling: key, surface, target, head, gloss, category, preserve, alternatives, literals.

    entries are tuples as in rules.glossary.ENTRIES; the core ones by default.
    custom entries come after these. Of spellings with one key the last counts.
    """
    rows = {}
    for source, target, category, preserve, alternatives, aliases in [*(G.ENTRIES if entries is None else entries), *custom]:
        gloss = re.search(r"\(([^()]+)\)", target)
        for spelling in [source, *aliases]:
            key = term_key(spelling)
            rows[key] = (key, source, target, target.split(" (")[0], gloss[1] if gloss else None, category, preserve,
                         list(alternatives), literal_candidates(target))
    return spark.createDataFrame(
        list(rows.values()),
        "key string, surface string, target string, head string, gloss string, category string, preserve boolean, "
        "alternatives array<string>, literals array<string>",
    )


def glossary_table(entries: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """As glossary(), from a table: source, target, category, preserve, alternatives, aliases.

    Rows of ``custom`` take the place of those with one of their keys. Of several rows
    of a table with one key the last source in code-point order counts; null aliases and
    alternatives are none, rows without a source or target are left out.
    """
    none = F.array().cast("array<string>")

    def spelled(df: DataFrame, rank: int) -> DataFrame:
        df = df.filter("source is not null and target is not null").select(
            "source", "target", "category", F.coalesce("preserve", F.lit(False)).alias("preserve"),
            F.coalesce("alternatives", none).alias("alternatives"), F.coalesce("aliases", none).alias("aliases"),
        )
        every = df.select("*", F.explode(F.concat(F.array("source"), "aliases")).alias("spelling"), F.lit(rank).alias("rank"))
        key = F.lower(F.regexp_replace(F.regexp_replace("spelling", "[\u200c\u200d]", ""), r"[\s.]+", ""))
        return every.withColumn("key", key)

    rows = spelled(entries, 0) if custom is None else spelled(entries, 0).unionByName(spelled(custom, 1))
    row = F.struct("source", "target", "category", "preserve", "alternatives")
    rows = rows.groupBy("key").agg(F.max_by(row, F.struct("rank", "source", "target")).alias("r")).select("key", "r.*")
    gloss = F.regexp_extract("target", r"\(([^()]+)\)", 1)
    rows = rows.select("key", F.col("source").alias("surface"), "target", F.substring_index("target", " (", 1).alias("head"), F.when(gloss != "", gloss).alias("gloss"),
                       "category", "preserve", "alternatives")
    return rows.withColumn("literals", _literals(F.col("head"), F.col("gloss")))


def _literals(head: Column, gloss: Column) -> Column:
    """As literal_candidates: phrases of the gloss of two words and more that the head lacks, the longest first."""
    parts = F.filter(F.split(F.coalesce(gloss, F.lit("")), r"\s+"), lambda w: w != "")
    n = F.size(parts)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    phrases = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.slice(parts, i, j - i + 1))))
    stop = F.array(*map(F.lit, G.STOP_WORDS))
    told = F.filter(phrases, lambda p: F.exists(p, lambda w: ~F.array_contains(stop, F.lower(w))))
    told = F.array_distinct(F.filter(F.transform(told, lambda p: F.array_join(p, " ")), lambda p: ~_in(head, p)))
    ranked = F.array_sort(F.transform(told, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p"))))
    return F.transform(ranked, lambda r: r["p"])


def contains_term(text: Column, surface: Column) -> Column:
    """Whether text has surface as a whole token: no letter or mark on either side."""
    edge = r"[\p{L}\p{M}]"
    quoted = F.concat(F.lit(rf"(?iu)(?<!{edge})\Q"), surface, F.lit(rf"\E(?!{edge})"))
    return F.contains(F.lower(text), F.lower(surface)) & F.regexp_like(text, quoted)


#: What a term's edge may not touch, and so what words are runs of.
_LETTER = r"\p{L}\p{M}"


def words(text: Column) -> Column:
    """Maximal runs of letters and marks, in lower case."""
    return F.filter(F.split(F.lower(text), f"[^{_LETTER}]+", -1), lambda w: w != "")


def _anchor(spelling: Column) -> Column:
    """The first word of a spelling: where the spelling stands in a text, this is a whole word of it. '' without letters."""
    return F.regexp_extract(F.lower(spelling), f"[{_LETTER}]+", 0)


def _own_pattern(keys: Column) -> Column:
    """A pattern of some keys, the longest first, as whole tokens."""
    ranked = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    quoted = F.transform(ranked, lambda r: F.concat(F.lit(r"\Q"), F.replace(r["k"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit(rf"(?iu)(?<![{_LETTER}])(?:"), F.array_join(quoted, "|"), F.lit(rf")(?![{_LETTER}])"))


def term_scan(blocks: DataFrame, terms: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id", "block_ord")) -> DataFrame:
    """ids, key, surface, category, n: how often each block has each term, whatever the number of terms.

    A key that is one word is found by joining words. One of several words, or without
    letters, is a candidate where its first word, or a piece of the same length, joins;
    the blocks that have such a candidate are searched again, with a pattern of the keys
    that are candidates there: of overlapping ones the first counts, and of those the
    longest. Blocks have distinct ids.
    """
    ids = list(id_cols)
    keys = terms.select("key").distinct().filter("length(key) >= 2").withColumn("anchor", _anchor(F.col("key")))
    word_keys, more = keys.filter("anchor = key").select("key"), keys.filter("anchor <> key")
    found = blocks.select(*ids, F.explode(words(F.col(text_col))).alias("key"))
    single = found.join(word_keys, "key")
    if more.isEmpty():
        counts = single.groupBy(*ids, "key").agg(F.count("*").alias("n"))
    else:
        hits = found.withColumnRenamed("key", "anchor").join(more.filter("anchor <> ''"), "anchor").select(*ids, "key")
        sizes = [r["n"] for r in more.filter("anchor = ''").select(F.length("key").alias("n")).distinct().collect()]  # lengths, so few
        if sizes:
            runs = F.filter(F.split(F.lower(F.col(text_col)), rf"[{_LETTER}\s.]+", -1), lambda x: x != "")
            run = blocks.select(*ids, F.explode(runs).alias("run")).select(*ids, "run", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
            cut = run.filter("length(run) >= size").select(*ids, F.explode(F.expr("transform(sequence(1, length(run) - size + 1), i -> substring(run, i, size))")).alias("key"))
            hits = hits.union(cut.join(more.filter("anchor = ''").select("key"), "key").select(*ids, "key"))
        again = hits.distinct().groupBy(*ids).agg(F.collect_set("key").alias("_several"))
        ones = single.join(again.select(*ids), ids, "left_semi").groupBy(*ids).agg(F.collect_set("key").alias("_one"))
        own = again.join(ones, ids, "left").select(*ids, F.array_union("_several", F.coalesce("_one", F.array().cast("array<string>"))).alias("_keys"))
        searched = blocks.select(*ids, text_col).join(own, ids)
        searched = searched.select(*ids, F.explode(F.regexp_extract_all(F.col(text_col), _own_pattern(F.col("_keys")), F.lit(0))).alias("hit"))
        searched = searched.select(*ids, F.lower("hit").alias("key")).groupBy(*ids, "key").agg(F.count("*").alias("n"))
        counts = single.join(again.select(*ids), ids, "left_anti").groupBy(*ids, "key").agg(F.count("*").alias("n")).union(searched)
    return counts.join(terms.select("key", "surface", "category"), "key").select(*ids, "key", "surface", "category", "n")


def term_plan(scan: DataFrame, terms: DataFrame, doc_col: str = "doc_id", block_col: str = "block_ord") -> DataFrame:
    """doc, key and the term's columns, cnt, first_use_block, glossed: a row per term that a document uses."""
    used = scan.groupBy(doc_col, "key").agg(F.sum("n").alias("cnt"), F.min(block_col).alias("first_use_block"))
    return used.join(terms, "key").withColumn("glossed", F.col("gloss").isNotNull())


def counts_by_category(scan: DataFrame) -> DataFrame:
    return scan.groupBy("category").agg(F.sum("n").alias("n"))


def _in(text: Column, phrase: Column) -> Column:
    return F.contains(F.lower(text), F.lower(phrase))


def term_index(plan: DataFrame, blocks: DataFrame, text_col: str = "source_text", doc_col: str = "doc_id", block_col: str = "block_ord") -> DataFrame:
    """doc, block, key, exact: the blocks of a document that may have a term of its plan, by its main spelling.

    An inverted index of words leads from a spelling's first word to the blocks that have
    it, so no block meets the terms that it lacks. ``exact`` is true where that word is
    the whole spelling; elsewhere the text has to be looked at. Spellings without letters
    go to all blocks of their document.
    """
    asked = plan.select(doc_col, "key", F.lower("surface").alias("_s"), _anchor(F.col("surface")).alias("_w"))
    listed = blocks.select(doc_col, block_col, F.explode(F.array_distinct(words(F.col(text_col)))).alias("_w"))
    found = listed.join(asked.filter("_w <> ''"), [doc_col, "_w"]).select(doc_col, block_col, "key", (F.col("_s") == F.col("_w")).alias("exact"))
    rest = blocks.select(doc_col, block_col).join(asked.filter("_w = '' and _s <> ''"), doc_col)
    return found.union(rest.select(doc_col, block_col, "key", F.lit(False)))


def _with_terms(plan: DataFrame, blocks: DataFrame, doc_col: str, block_col: str) -> DataFrame:
    """Blocks joined with the terms of their document's plan that their source has."""
    pairs = term_index(plan, blocks, "source_text", doc_col, block_col).join(plan, [doc_col, "key"])
    pairs = pairs.join(blocks.select(doc_col, block_col, "source_text", "target_text"), [doc_col, block_col])
    return pairs.filter(F.col("exact") | contains_term(F.col("source_text"), F.col("surface"))).drop("exact")


def term_compliance(plan: DataFrame, blocks: DataFrame, doc_col: str = "doc_id", block_col: str = "block_ord") -> DataFrame:
    """doc, block, key, surface, expected, actual, kind, severity: terms that a block's target doesn't keep.

    A block answers for the terms that its source has by their main spelling; see
    term_index.
    """
    pairs = _with_terms(plan, blocks, doc_col, block_col)
    target = F.coalesce("target_text", F.lit(""))
    head = _in(target, F.col("head"))
    alias = F.get(F.filter("alternatives", lambda a: _in(target, a)), 0)
    literal = F.get(F.filter("literals", lambda x: _in(target, x)), 0)
    verdict = lambda kind, severity, actual: F.struct(
        F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), actual.alias("actual")
    )
    found = (
        F.when(head | (F.col("preserve") & alias.isNotNull()), F.lit(None))
        .when(alias.isNotNull(), verdict("inconsistent_target", "minor", alias))
        .when(literal.isNotNull(), verdict("literal_translation", "major", literal))
        .otherwise(verdict("not_present", "major", F.lit("(absent)")))
    )
    out = pairs.withColumn("_v", found).filter("_v is not null")
    return out.select(doc_col, block_col, "key", "surface", F.col("target").alias("expected"), "_v.actual", "_v.kind", "_v.severity")


def term_consistency(plan: DataFrame, blocks: DataFrame, doc_col: str = "doc_id", block_col: str = "block_ord") -> DataFrame:
    """doc, key, surface, renderings: terms that a document renders in more than one way."""
    pairs = _with_terms(plan, blocks, doc_col, block_col)
    heads = F.concat(F.array("head"), F.transform("alternatives", lambda a: F.substring_index(a, " (", 1)))
    used = F.filter(F.array_distinct(heads), lambda h: (h != "") & _in(F.coalesce(F.col("target_text"), F.lit("")), h))
    rows = pairs.select(doc_col, "key", "surface", F.explode(used).alias("rendering"))
    out = rows.groupBy(doc_col, "key", "surface").agg(F.array_sort(F.collect_set("rendering")).alias("renderings"))
    return out.filter(F.size("renderings") > 1)


def term_findings(compliance: DataFrame, consistency: DataFrame | None = None, doc_col: str = "doc_id", block_col: str = "block_ord") -> DataFrame:
    """doc, block, check, category, severity, title: findings of term_compliance and term_consistency."""
    quoted = F.concat(F.lit('"'), F.col("surface"), F.lit('"'))
    title = (
        F.when(F.col("kind") == "not_present", F.concat(F.lit("Term "), quoted, F.lit(" is not rendered as "), F.col("expected")))
        .when(F.col("kind") == "literal_translation", F.concat(F.lit("Term "), quoted, F.lit(" is put literally: "), F.col("actual")))
        .otherwise(F.concat(F.lit("Term "), quoted, F.lit(" is rendered as "), F.col("actual")))
    )
    shape = lambda df, check, severity, text: df.select(
        doc_col, block_col, check.alias("check"), F.lit("Terminology").alias("category"), severity.alias("severity"), text.alias("title")
    )
    out = shape(compliance, F.concat(F.lit("terminology."), F.col("kind")), F.col("severity"), title)
    if consistency is None:
        return out
    mixed = consistency.withColumn(block_col, F.lit(None).cast(compliance.schema[block_col].dataType))
    text = F.concat(F.lit("Term "), quoted, F.lit(" is rendered in several ways: "), F.array_join("renderings", ", "))
    return out.unionByName(shape(mixed, F.lit("terminology.inconsistent_target"), F.lit("minor"), text))


def glossary_density(blocks: DataFrame, terms: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_hits, per_thousand: words that are terms."""
    words = blocks.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{M}\p{N}]+")).alias("w")).filter("w != ''")
    known = terms.select(F.col("key").alias("w")).distinct().withColumn("known", F.lit(1))
    out = words.groupBy(id_col, "w").agg(F.count("*").alias("n")).join(known, "w", "left")
    out = out.groupBy(id_col).agg(F.sum("n").alias("n_words"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("n_hits"))
    return out.withColumn("per_thousand", F.round(1000 * F.col("n_hits") / F.col("n_words"), 6))


def prompt_terms(plan: DataFrame, doc_col: str = "doc_id", most: int = 60) -> DataFrame:
    """The commonest terms of a document, as lines of a prompt."""
    rank = F.row_number().over(Window.partitionBy(doc_col).orderBy(F.desc("cnt"), "key"))
    line = F.format_string("- %s → %s%s", F.col("surface"), F.col("target"), F.when(F.col("preserve"), " [keep]").otherwise(""))
    return plan.withColumn("_r", rank).filter(F.col("_r") <= most).select(doc_col, "key", "cnt", line.alias("line"))
