"""Scalar functions over bilingual text, as expressions that stay in the JVM.

Each takes a Column (or a column's name) and returns a Column; null gives null
unless it says otherwise. Lengths are in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import values as V
from .jsregex import BLANK_CHARS, BLANKS, java

INDIC = r"[ऀ-ॿ\u0A80-૿]"
GUJARATI = r"[\u0A80-૿]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def replace_all(c: Column | str, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(col(c), pattern, by)


def trimmed(c: Column | str) -> Column:
    """Without blanks of any kind at either end."""
    return F.btrim(col(c), F.lit(BLANK_CHARS))


def count_of(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def any_case(c: Column | str) -> Column:
    """The text in lower case, with ASCII letters for all that patterns of any case take for them."""
    return F.lower(F.translate(col(c), "\u017f\u212a\u0131\u0130", "skii"))


def has_any(c: Column | str, parts: list[str]) -> Column:
    """Whether a text has one of the parts."""
    return reduce(lambda a, b: a | b, (F.contains(col(c), F.lit(part)) for part in parts))


# Digits


def to_ascii_digits(c: Column | str, devanagari: bool = False) -> Column:
    """Gujarati (and if asked Devanagari) digits as 0-9."""
    more = V.DEVANAGARI_DIGITS if devanagari else ""
    return F.translate(col(c), V.GUJARATI_DIGITS + more, "0123456789" * (2 if devanagari else 1))


def to_gujarati_digits(c: Column | str) -> Column:
    return F.translate(col(c), "0123456789", V.GUJARATI_DIGITS)


def has_gujarati_digits(c: Column | str) -> Column:
    return col(c).rlike("[૦-૯]")


def gujarati_month(c: Column | str) -> Column:
    """Month number of a Gujarati name in any accepted spelling, composed or not; else null."""
    import unicodedata

    names = {unicodedata.normalize(f, k): n for k, n in V.GUJARATI_MONTHS.items() for f in ("NFC", "NFD")}
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), col(c))


def indian_group(c: Column | str) -> Column:
    """Digits with commas after the last three and then after every two."""
    digits = F.regexp_replace(col(c), "^0+(?=[0-9])", "")
    head = F.regexp_replace(F.substr(digits, F.lit(1), F.greatest(F.length(digits) - 3, F.lit(0))), r"\B(?=(\d{2})+(?!\d))", ",")
    return F.when(F.length(digits) <= 3, digits).otherwise(F.concat(head, F.lit(","), F.right(digits, F.lit(3))))


# Scripts


def script_counts(c: Column | str) -> dict[str, Column]:
    out = {name: count_of(c, f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]") for name, lo, hi in V.SCRIPTS}
    return out | {"latin": count_of(c, "[A-Za-z]")}


def detect_script(c: Column | str) -> Column:
    """The Indic script with most characters (ties to the one seen first); Latin if over four times as many."""
    n = script_counts(c)
    names = [name for name, *_ in V.SCRIPTS]
    most = F.greatest(*(n[x] for x in names))
    # Of scripts with equally many characters the one whose first character stands first.
    at = {name: F.regexp_instr(col(c), F.lit(f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]")) for name, lo, hi in V.SCRIPTS}
    leaders = F.array(*(F.when(n[x] == most, F.struct(at[x].alias("at"), F.lit(x).alias("name"))) for x in names))
    first = F.array_min(F.filter(leaders, lambda s: s.isNotNull()))
    return (
        F.when(most == 0, F.when(n["latin"] > 0, "latin").otherwise("unknown"))
        .when(n["latin"] > most * 4, "latin")
        .otherwise(first["name"])
    )


def script_profile(c: Column | str) -> Column:
    """struct(script, gujarati_ratio, latin_ratio, other_ratio) over characters that aren't blank."""
    body = replace_all(c, f"[{BLANKS}]")
    total = F.greatest(F.length(body), F.lit(1))
    gu, latin = count_of(body, GUJARATI), count_of(body, "[A-Za-z0-9]")
    return F.struct(
        detect_script(c).alias("script"),
        (gu / total).alias("gujarati_ratio"),
        (latin / total).alias("latin_ratio"),
        ((F.length(body) - gu - latin) / total).alias("other_ratio"),
    )


def is_gujarati(c: Column | str) -> Column:
    return col(c).rlike(GUJARATI)


def contains_indic(c: Column | str) -> Column:
    return col(c).rlike(r"[\u0900-\u0AFF]")


def indic_ratio(c: Column | str) -> Column:
    """Share of Devanagari and Gujarati among characters that aren't blank; 0 if there are none."""
    total = F.length(replace_all(c, f"[{BLANKS}]"))
    return F.when(~col(c).rlike(INDIC), F.lit(0.0)).otherwise(count_of(c, INDIC) / total)


def legacy_encoding(c: Column | str) -> Column:
    """struct(suspected, candidates, confidence): signs of fonts that redefine other code points.

    The first 20 000 characters are looked at. A font is a candidate from three
    signs on; it is suspected above one sign in 200 characters.
    """
    sample = F.substring(col(c), 1, 20000)
    counts = [(name, count_of(sample, rx)) for name, rx in V.LEGACY_SIGNS]
    named = F.filter(F.array(*(F.when(n >= 3, F.lit(name)) for name, n in counts)), lambda x: x.isNotNull())
    hits = reduce(lambda a, b: a + b, (F.when(n >= 3, n).otherwise(0) for _, n in counts))
    density = hits / F.greatest(F.lit(1.0), F.length(sample) / 100)
    suspected = (F.size(named) > 0) & (density > 0.5)
    return F.struct(
        suspected.alias("suspected"),
        named.alias("candidates"),
        F.when(suspected, F.least(F.lit(1.0), density / 4)).otherwise(F.lit(0.0)).alias("confidence"),
    )


# Blanks and words


def clean_invisible(c: Column | str) -> Column:
    return replace_all(c, V.INVISIBLE)


def normalize_whitespace(c: Column | str) -> Column:
    """One kind of line end and blank, no blank before a line end, at most one empty line, trimmed."""
    steps = [(r"\r\n?", "\n"), (V.SPACE_SEPARATORS, " "), (" {2,}", " "), (r"[ \t]+\n", "\n"), (r"\n{2,}", "\n\n")]
    return trimmed(reduce(lambda x, s: F.regexp_replace(x, *s), steps, col(c)))


def has_single_blanks(c: Column | str) -> Column:
    """Whether normalize_whitespace only trims the text: one line whose blanks are single and plain."""
    text = col(c)
    ascii_only = F.octet_length(text) == F.length(text)
    return ~has_any(text, ["\n", "\r", "\t", "  "]) & (ascii_only | ~text.rlike(V.SPACE_SEPARATORS))


def flatten_whitespace(c: Column | str) -> Column:
    one = F.regexp_replace(normalize_whitespace(c), rf"[{BLANKS}]*\n[{BLANKS}]*", " ")
    return trimmed(F.regexp_replace(one, " {2,}", " "))


def estimate_tokens(c: Column | str) -> Column:
    """A monotone guess: 2.2 Gujarati or 4 other characters to the token, rounded up; 0 for null."""
    gu = count_of(c, GUJARATI)
    guess = F.ceil(gu / F.lit(2.2) + (F.length(col(c)) - gu) / F.lit(4.0))
    return F.when(col(c).isNull() | (col(c) == ""), F.lit(0)).otherwise(guess).cast("long")


def without_marks(c: Column | str) -> Column:
    """The text with a blank for each of the two control characters that mark places while it is cut."""
    return F.when(F.contains(col(c), F.lit("\u0001")) | F.contains(col(c), F.lit("\u0002")), F.translate(col(c), "\u0001\u0002", "  ")).otherwise(col(c))


def split_sentences(c: Column | str) -> Column:
    """Sentences as an array: cut after . ! ? and danda before blanks, and at line ends.

    Abbreviations (as whole tokens) keep their dots: these are hidden behind a
    control character while the text is cut. The text's own are blanks.
    """
    text = without_marks(c)
    for word in sorted({w for w in V.ABBREVIATIONS if "." in w}, key=lambda w: (-len(w), w)):
        groups = "(" + ")\\.(".join(p for p in word.split(".")) + ")"
        back = "".join(f"${i + 1}\u0001" if i < word.count(".") else f"${i + 1}" for i in range(word.count(".") + 1))
        text = F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{M}}]){groups}(?=$|[^\p{{L}}\p{{M}}])", back)
    parts = F.split(text, rf"(?<=[।.!?])[{BLANKS}]+|\n+", -1)
    whole = F.transform(parts, lambda x: trimmed(F.translate(x, "\u0001", ".")))
    return F.filter(whole, lambda x: x != "")


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and marks that hold a letter or digit."""
    parts = F.split(F.lower(clean_invisible(c)), r"[^\p{L}\p{N}\p{M}]+", -1)
    return F.filter(parts, lambda x: x.rlike(r"[\p{L}\p{N}]"))


def strip_edge_punctuation(c: Column | str) -> Column:
    edge = rf"[{BLANKS}\"'“”‘’\-–—:;,.।]+"
    return F.regexp_replace(F.regexp_replace(col(c), f"^{edge}", ""), f"{edge}$", "")


# Names


def transliterate(c: Column | str) -> Column:
    """Gujarati letters by a fixed Latin spelling each, then a-z only."""
    out = col(c)
    single = {k: v for k, v in V.LATIN_OF.items() if len(v) == 1}
    none = "".join(k for k, v in V.LATIN_OF.items() if not v)
    out = F.translate(out, "".join(single) + none, "".join(single.values()))
    for k, v in V.LATIN_OF.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(F.lower(out), "[^a-z]", "")


def fold_digraphs(c: Column | str) -> Column:
    out = col(c)
    for rx, by in V.DIGRAPHS:
        if rx.startswith("aa"):
            for double in rx.split("|"):
                out = F.replace(out, F.lit(double), F.lit(double[0]))
        else:
            out = F.regexp_replace(out, rx, by)
    return out


def name_key(c: Column | str) -> Column:
    return fold_digraphs(transliterate(c))


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāēīōūńśťžšč"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaeiounstzsc"


def latin_key(c: Column | str) -> Column:
    """As name_key for text in Latin script: lower case, accents off, spellings folded."""
    return fold_digraphs(F.translate(F.lower(col(c)), _ACCENTED, _PLAIN))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; 1 if both are empty, 0 if one is."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(longest == 0, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(1 - F.levenshtein(a, b) / longest)
    )


def bounded_levenshtein(a: Column | str, b: Column | str, most: int) -> Column:
    """Edit distance up to a bound, the bound and one beyond it."""
    d = F.levenshtein(col(a), col(b), most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def names_match(a: Column | str, b: Column | str) -> Column:
    """struct(match, confidence): equal keys, or keys alike by 0.85 and more."""
    ka, latin = name_key(a), latin_key(b)
    kb = F.when(latin != "", latin).otherwise(name_key(b))
    s = similarity(ka, kb)
    ok = (ka != "") & (kb != "") & (s >= 0.85)
    return F.struct(ok.alias("match"), F.when((ka == "") | (kb == ""), F.lit(0.0)).otherwise(s).alias("confidence"))


# Titles and excerpts


def display_surface(c: Column | str) -> Column:
    out = to_ascii_digits(c)
    for rx, by in V.TITLE_LABELS:
        out = F.regexp_replace(out, rx, by)
    return trimmed(F.regexp_replace(out, f"[{BLANKS}]+", " "))


def excerpt(c: Column | str, around: Column | str | None = None) -> Column:
    """The first 220 characters, or 80 before to 100 after a passage; an ellipsis where text is left off."""
    text = F.regexp_replace(col(c), f"[{BLANKS}]+", " ")
    head = F.when(F.length(text) > 220, F.concat(F.substring(text, 1, 220), F.lit("…"))).otherwise(text)
    if around is None:
        return head
    at = F.position(F.lower(col(around)), F.lower(text))
    start = F.greatest(at - 80, F.lit(1))
    end = F.least(at + F.length(col(around)) + 99, F.length(text))
    cut = F.concat(
        F.when(start > 1, "…").otherwise(""),
        F.substr(text, start, end - start + 1),
        F.when(end < F.length(text), "…").otherwise(""),
    )
    return F.when(at > 0, cut).otherwise(head)


def context_around(c: Column | str, start: Column, end: Column, pad: int = 46) -> Column:
    """The characters from pad before start to pad after end (from 0, end not included)."""
    text = col(c)
    a, b = F.greatest(start - pad, F.lit(0)), F.least(end + pad, F.length(text))
    body = F.regexp_replace(F.substr(text, (a + 1).cast("int"), (b - a).cast("int")), f"[{BLANKS}]+", " ")
    return F.concat(F.when(a > 0, "…").otherwise(""), body, F.when(b < F.length(text), "…").otherwise(""))


# Numbers in pairs of texts


def numeric_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(to_ascii_digits(c, devanagari=True), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))


def lost_numbers(source: Column | str, target: Column | str, most: int = 4) -> Column:
    """Numbers of two digits and more whose digits the target lacks, also without their decimals."""
    there = F.regexp_replace(to_ascii_digits(target, devanagari=True), r"[^0-9]", "")

    def lost(token: Column) -> Column:
        every = F.regexp_replace(token, "[.,]", "")
        whole = F.regexp_replace(F.substring_index(token, ".", 1), ",", "")
        return (F.length(every) >= 2) & ~F.contains(there, every) & ~((F.length(whole) >= 2) & F.contains(there, whole))

    return F.slice(F.array_distinct(F.filter(numeric_tokens(source), lost)), 1, most)


def foreign_numbers(source: Column | str, target: Column | str, most: int = 3) -> Column:
    """Numbers of four digits and more in the target that the source lacks."""
    plain = lambda c: F.array_distinct(F.transform(numeric_tokens(c), lambda t: F.regexp_replace(t, "[.,]", "")))
    long = F.filter(plain(target), lambda t: F.length(t) >= 4)
    return F.slice(F.array_except(long, plain(source)), 1, most)


def looks_transliterated(c: Column | str) -> Column:
    """Twelve Latin words or more of which under 8 % are English function words."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z]{2,}"), F.lit(0))
    glue = F.array(*(F.lit(w) for w in V.FUNCTION_WORDS))
    n = F.size(words)
    return (n >= 12) & (F.size(F.filter(words, lambda w: F.array_contains(glue, w))) / F.greatest(n, F.lit(1)) < 0.08)


def target_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


# Targets that failed


CLAUSE_LABEL = java(r"^\s*(\(?\d{1,3}(?:\.\d{1,3}){0,4}[.)]?|[a-z]\)|\([ivx]+\))\s+", True)


def restore_clause_label(target: Column | str, source: Column | str) -> Column:
    """The source's numbering before the target without its own."""
    label = F.regexp_extract(col(source), CLAUSE_LABEL, 1)
    body = F.regexp_replace(col(target), java(r"^\s*\(?\s*(?:\d{1,3}|[ivxIVX]+|[a-zA-Z])\s*[.)]?\s+"), "")
    return F.when(label == "", col(target)).otherwise(trimmed(F.concat(label, F.lit(" "), body)))


def _without_indic(c: Column | str) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(col(c), f"{INDIC}+", " "), f"[{BLANKS}]+", " "))


def last_resort_english(source: Column | str) -> Column:
    """What a source holds in Latin script if that is two words and twelve characters, else a marker."""
    left = _without_indic(source)
    enough = (count_of(left, "[A-Za-z]{2,}") >= 2) & (F.length(left) >= 12)
    return F.when(enough, F.concat(left, F.lit(V.ILLEGIBLE_SUFFIX))).otherwise(F.lit(V.NO_TRANSLATION))


def strip_residue(target: Column | str, limit: float = 0.08) -> Column:
    """A target without its Indic characters, or a marker where too much of it was Indic."""
    ratio, left = indic_ratio(target), _without_indic(target)
    lost = (ratio > 0.4) | ((ratio > limit) & (F.length(left) < 12)) | (left == "")
    return (
        F.when(ratio == 0, col(target))
        .when(lost, F.lit(V.ILLEGIBLE))
        .when(ratio > limit, F.concat(left, F.lit(V.ILLEGIBLE_SUFFIX)))
        .otherwise(left)
    )


def max_rupee(c: Column | str) -> Column:
    """The largest amount after a rupee sign in Gujarati, as written; null without one."""
    found = F.regexp_extract_all(to_ascii_digits(c), F.lit(r"રૂ\.?\s*([\d,]+(?:\.\d+)?)"), F.lit(1))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_replace(x, ",", "").try_cast("double").alias("n"), x.alias("raw")))
    return F.array_max(pairs)["raw"]


def safe_file_name(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^A-Za-z0-9_-]", "_")
