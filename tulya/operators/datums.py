"""Typed facts: found in either side of a block, normalised, and matched by value."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.jsregex import BLANKS, java
from ..rules import datums as R
from ..rules import values as V
from ..sources.scratch import kept

_SEVERITY = {"person_name": "major", "party_name": "critical", "place": "major", "count_phrase": "minor"} | {
    kind: severity for kind, severity, _, _ in R.PATTERNS
}
#: Kinds of which a value that only the target has is reported.
ADDED = ["currency", "number", "date"]


_FOUND = "struct<start:int,end:int,prio:int,kind:string,surface:string,role:string>"


def _row(s: Column, prio: Column, kind: Column) -> Column:
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), prio.alias("prio"), kind.alias("kind"),
        s["surface"].alias("surface"), F.lit(None).cast("string").alias("role"),
    )


def _rows(found: Column, prio: int, kind: str) -> Column:
    return F.transform(found, lambda s: _row(s, F.lit(prio), F.lit(kind)))


#: Values to a chunk of running().
_CHUNK = 64


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """What op has made of all values before each one; zero before the first.

    op is associative with zero as its identity. Appending to an array copies it, so
    long arrays are worked on in chunks: over n values the work grows with n, not with
    its square.
    """
    def before(vs: Column, start: Column) -> Column:
        full = F.aggregate(vs, F.array(start), lambda a, x: F.array_append(a, op(F.element_at(a, -1), x)))
        return F.slice(full, F.lit(1), F.size(vs))

    def chunked(vs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / _CHUNK).cast("int")), lambda i: F.slice(vs, i * _CHUNK + 1, F.lit(_CHUNK)))
        starts = before(F.transform(chunks, lambda c: F.aggregate(c, zero, op)), zero)
        return X.let(F.struct(chunks.alias("chunks"), starts.alias("starts")), lambda s: F.flatten(F.transform(s["chunks"], lambda c, i: before(c, F.get(s["starts"], i)))))

    return X.let(values, lambda vs: F.when(F.size(vs) <= _CHUNK, before(vs, zero)).otherwise(chunked(vs)))


_SPANS = "array<struct<start:int,end:int,surface:string>>"


def marked(text: Column, pattern: str, needs: list[str] | None = None, any_case: bool = False) -> Column:
    """The text with its matches between control characters; null for one with none of ``needs``, which isn't searched."""
    out = F.regexp_replace(text, pattern, "\u0001$0\u0002")
    return out if needs is None else F.when(has_any(text, needs, any_case), out)


def places(marks: Column) -> Column:
    """array of struct(start, end, surface), start from 0, for each of an array of marked texts.

    A marked text is cut at its control characters, and the lengths of the pieces before
    one give its place. The text must hold none of these itself (see text.without_marks).
    """
    def placed(parts: Column) -> Column:
        starts = running(F.transform(parts, F.length), lambda a, x: a + x, F.lit(0))
        every = F.transform(F.arrays_zip(starts.alias("at"), parts.alias("x")), lambda z, i: F.when(
            i % 2 == 1, F.struct(z["at"].alias("start"), (z["at"] + F.length(z["x"])).alias("end"), z["x"].alias("surface"))
        ))
        return F.filter(every, lambda e: e.isNotNull())

    cut = F.transform(marks, lambda m: F.split(F.coalesce(m, F.lit("")), "[\u0001\u0002]", -1))
    return F.transform(cut, lambda parts: F.when(F.size(parts) > 1, placed(parts)).otherwise(F.array().cast(_SPANS)))


def spans(text: Column, pattern: str) -> Column:
    """All matches as array of struct(start, end, surface), start from 0."""
    return F.get(places(F.array(marked(text, pattern))), 0)


def has_any(text: Column, parts: list[str], any_case: bool = False) -> Column:
    """Whether a text has one of the parts; in any case, as patterns of any case have it, the parts are in lower case."""
    return X.has_any(X.any_case(text) if any_case else text, parts)


def disjoint(found: Column) -> Column:
    """Of overlapping spans the longest, then the first, then the most important; in order of place.

    In order of place, spans fall into groups that don't overlap each other; only
    within a group of several are they weighed against one another.
    """
    def best(group: Column) -> Column:
        ranked = F.array_sort(
            F.transform(group, lambda f: F.struct((f["start"] - f["end"]).alias("longest"), f["start"].alias("start"), f["prio"].alias("prio"), f.alias("f")))
        )
        kept = F.aggregate(
            ranked, F.array().cast(f"array<{_FOUND}>"),
            lambda a, r: F.when(
                F.exists(a, lambda k: (r["f"]["start"] < k["end"]) & (k["start"] < r["f"]["end"])), a
            ).otherwise(F.array_append(a, r["f"])),
        )
        return F.array_sort(kept)

    def grouped(rows: Column, heads: Column) -> Column:
        ends = F.concat(F.slice(heads, F.lit(2), F.size(heads)), F.array(F.size(rows)))
        return F.transform(F.arrays_zip(heads.alias("a"), ends.alias("b")), lambda z: F.slice(rows, z["a"] + 1, z["b"] - z["a"]))

    def swept(rows: Column) -> Column:
        reach = running(F.transform(rows, lambda f: f["end"]), lambda a, x: F.greatest(a, x), F.lit(-1))
        at = F.transform(F.arrays_zip(rows.alias("f"), reach.alias("reach")), lambda z, i: F.when(z["f"]["start"] >= z["reach"], i))
        heads = F.filter(at, lambda i: i.isNotNull())
        return X.let(heads, lambda h: F.flatten(F.transform(grouped(rows, h), lambda g: F.when(F.size(g) == 1, g).otherwise(best(g)))))

    return X.let(F.array_sort(found), lambda rows: F.when(F.size(rows) <= 1, rows).otherwise(swept(rows)))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat(y.cast("string"), F.lit("-"), _two(m), F.lit("-"), _two(d))


#: Dates with nothing to choose: year, month and day in order, or an English month between day and year.
_ISO_DATE = "^[12][0-9]{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\\z"
_NAMED_DATE = rf"^(?:0?[1-9]|[12][0-9]|3[01]) (?:{'|'.join(V.ENGLISH_MONTHS)}) [12][0-9]{{3}}\z"


def normalize_date(raw: Column) -> Column:
    """ISO date; AMBIG:a|b where day and month can change places; ? and the text where it is none.

    Two-digit years are the first number of 21 to 99, in any place, and 2000 more.
    """
    found = F.transform(F.regexp_extract_all(raw, F.lit(r"[0-9]+"), F.lit(0)), lambda x: x.cast("long"))
    # The two forms of most dates, which have one reading; all others are read number by number.
    english = F.create_map(*(F.lit(x) for i, m in enumerate(V.ENGLISH_MONTHS) for x in (m, f"{i + 1:02d}")))
    named = F.concat_ws("-", F.substring_index(raw, " ", -1), F.element_at(english, F.substring_index(F.substring_index(raw, " ", 2), " ", -1)), F.lpad(F.substring_index(raw, " ", 1), 2, "0"))
    return F.when(raw.rlike(_ISO_DATE), raw).when(raw.rlike(_NAMED_DATE), named).otherwise(X.let(found, lambda nums: _date_of(raw, nums)))


_MONTHS = [*V.GUJARATI_MONTHS.items(), *((m.lower(), i + 1) for i, m in enumerate(V.ENGLISH_MONTHS))]


def _date_of(raw: Column, nums: Column) -> Column:
    four = F.filter(nums, lambda n: (n >= 1000) & (n <= 2999))
    two = F.filter(nums, lambda n: (n > 20) & (n <= 99))
    year = F.coalesce(F.get(four, 0), F.get(two, 0) + 2000)
    months = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(n).alias("n")) for name, n in _MONTHS))
    named = lambda low: F.get(F.filter(months, lambda m: F.contains(low, m["name"])), 0)["n"]
    month = F.when(F.translate(raw, "0123456789-./", "") != "", X.let(F.lower(raw), named))
    return X.let(F.struct(year.alias("y"), month.alias("m")), lambda t: _date_by(raw, nums, t["y"], t["m"]))


def _date_by(raw: Column, nums: Column, year: Column, month: Column) -> Column:
    day = F.coalesce(F.get(F.filter(nums, lambda n: (n <= 31) & (n != month)), 0), F.get(nums, 0))
    named = month.isNotNull() & year.isNotNull() & (day >= 1) & (day <= 31)
    a, b, c = (F.get(nums, i) for i in range(3))
    none = F.concat(F.lit("?"), raw)
    by_numbers = (
        F.when(F.size(nums) < 3, none)
        .when((a >= 1000) & (a <= 2999), F.when(b.between(1, 12) & c.between(1, 31), _iso(a, b, c)).otherwise(none))
        .when(year.isNull(), none)
        .when((a <= 12) & (b <= 12), F.concat(F.lit("AMBIG:"), _iso(year, a, b), F.lit("|"), _iso(year, b, a)))
        .when((a > 12) & (b <= 12), _iso(year, b, a))
        .when((b > 12) & (a <= 12), _iso(year, a, b))
        .otherwise(none)
    )
    return F.when(named, _iso(year, month, day)).otherwise(by_numbers)


def _value(surface: Column) -> Column:
    digits = F.regexp_replace(surface, "[^0-9]", "")
    return F.when(F.startswith(digits, F.lit("0")), F.regexp_replace(digits, "^0+(?=[0-9])", "")).otherwise(digits)


def normalized(kind: Column, surface: Column) -> Column:
    """The value of a fact as text. A decimal point is dropped from amounts and numbers."""
    blank = f"[{BLANKS}]+"
    written = F.regexp_replace(surface, blank, "")
    whole = F.substring_index(written, ".", 1)
    counts = F.create_map(*(F.lit(x) for k, v in R.COUNTS.items() for x in (k, str(v))))
    latin = X.transliterate(surface)
    name = F.when(latin != "", latin).otherwise(F.regexp_replace(F.lower(surface), blank, ""))
    percent = java(r"\s*(?:%|ટકા|ટકે|percent|per cent)$", True)
    time = next(p for k, _, p, _ in R.PATTERNS if k == "time")
    pin = next(p for k, _, p, _ in R.PATTERNS if k == "address_pin")
    return (
        F.when(kind == "currency", _value(surface))
        .when(kind == "percentage", F.regexp_replace(F.regexp_replace(surface, percent, ""), "^([^,]*),", "$1."))
        .when(kind == "case_number", F.upper(F.regexp_replace(written, r"\.$", "")))
        .when(kind.isin("statute", "section_ref"), X.trimmed(F.regexp_replace(surface, blank, " ")))
        .when(kind == "date", normalize_date(surface))
        .when(kind == "time", F.concat(F.lpad(F.regexp_extract(surface, java(time, True), 1), 2, "0"), F.lit(":undefined")))
        .when(kind == "address_pin", F.regexp_extract(surface, java(pin), 1))
        .when(kind == "number", F.when(F.contains(whole, F.lit(",")), F.concat(_value(surface), F.lit("|"), whole)).otherwise(_value(surface)))
        .when(kind == "count_phrase", F.element_at(counts, F.lower(surface)))
        .otherwise(name)
    )


def facts(text: Column) -> Column:
    """array of struct(start, end, prio, kind, surface): amounts, dates, references, numbers."""
    kinds = F.array(*(F.struct(F.lit(R.PRIORITY.index(kind)).alias("prio"), F.lit(kind).alias("kind")) for kind, *_ in R.PATTERNS))

    def found(ascii_text: Column) -> Column:
        marks, seen = [], Counter()
        for kind, _, pattern, any_case in R.PATTERNS:
            needs = R.NEEDS.get(kind)
            rx = java(pattern.replace("[0-9૦-૯]", "[0-9]"), any_case)  # all digits are ASCII here
            marks.append(marked(ascii_text, rx, needs and needs[seen[kind]], any_case))
            seen[kind] += 1
        rows = F.transform(places(F.array(*marks)), lambda g, i: F.transform(g, lambda s: _row(s, F.get(kinds, i)["prio"], F.get(kinds, i)["kind"])))
        return disjoint(F.flatten(rows))

    return X.let(X.to_ascii_digits(text), found)


def _named(found: Column, rx: str, kind: str, prio: int, least: int = 3, role: bool = False) -> Column:
    tail = "$" if kind == "place" else "[,.]$"

    def row(s: Column) -> Column:
        name = F.regexp_extract(s["surface"], rx, 1)
        clean = X.normalize_whitespace(name) if kind != "person_name" else X.trimmed(name)
        before = F.substr(s["surface"], F.lit(1), F.length(s["surface"]) - F.length(name))
        label = F.regexp_replace(X.normalize_whitespace(before), rf"[{BLANKS}–—:-]+$", "")
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(prio).alias("prio"), F.lit(kind).alias("kind"),
            (clean if kind == "place" else F.regexp_replace(clean, tail, "")).alias("surface"),
            (F.when(label != "", label) if role else F.lit(None).cast("string")).alias("role"),
        )

    return F.filter(F.transform(found, row), lambda s: F.length(s["surface"]) >= least)


def names(text: Column) -> Column:
    """array as of facts: persons, parties with their role, institutions, written counts."""
    words = "|".join(sorted(R.COUNTS, key=lambda k: (-len(k), k)))
    rx = {
        "honorific": java(R.HONORIFIC), "latin_honorific": java(R.LATIN_HONORIFIC), "role": java(R.ROLE, True),
        "institution": java(R.INSTITUTION), "count": java(rf"\b({words})\b"),
    }
    marks = F.array(*(marked(text, x, R.NAME_NEEDS.get(name), name == "role") for name, x in rx.items()))
    return X.let(places(marks), lambda found: _names(dict(zip(rx, (F.get(found, i) for i in range(len(rx))))), rx))


def _names(found: dict[str, Column], rx: dict[str, str]) -> Column:
    people = F.concat(
        _named(found["honorific"], rx["honorific"], "person_name", 20), _named(found["latin_honorific"], rx["latin_honorific"], "person_name", 21, least=1)
    )
    keyed = F.transform(people, lambda p: F.struct(X.name_key(p["surface"]).alias("key"), p.alias("p")))
    # The first of each key, by pattern and place.
    once = F.aggregate(
        keyed, F.array().cast(f"array<struct<key:string,p:{_FOUND}>>"),
        lambda a, k: F.when((k["key"] == "") | F.exists(a, lambda o: o["key"] == k["key"]), a).otherwise(F.array_append(a, k)),
    )
    parties = F.filter(
        _named(found["role"], rx["role"], "party_name", 22, role=True),
        lambda p: ~F.lower(F.substring_index(p["surface"], " ", 1)).isin(R.CONNECTORS)
        & (F.size(F.split(p["surface"], " ")) <= 4)
        & (X.name_key(p["surface"]) != ""),
    )
    places_ = _named(found["institution"], rx["institution"], "place", 23, least=4)
    return F.concat(F.transform(once, lambda k: k["p"]), parties, places_, _rows(found["count"], 24, "count_phrase"))


#: Texts of at most so many characters are searched once for each of their shapes.
_SHORT = 400


def shape(text: Column) -> Column:
    """The text with 0 for every ASCII digit; texts of one shape have their facts and names in the same places.

    Patterns know digits as a class only, but for that of statutes, which knows 19: a text that
    may hold one is its own shape. Gujarati digits stay, as names may hold them.
    """
    return F.when(has_any(text, R.NEEDS["statute"][0]), text).otherwise(F.translate(text, "123456789", "000000000"))


def _every(text: Column, with_names: bool) -> Column:
    """array as of facts and severity, in order of place; the surface of a fact (not of a name) is null."""
    bare = F.transform(facts(text), lambda f: f.withField("surface", F.lit(None).cast("string")))
    found = F.array_sort(F.concat(bare, names(text)) if with_names else bare)
    return F.transform(found, lambda f: f.withField("severity", _severity_of(f["kind"])))


def _shapes(texts: DataFrame, cols: list[str], with_names: bool) -> DataFrame:
    """_shape, _known: what every shape of the short texts of cols holds.

    Short texts are often alike but for their numbers, so each shape is searched once; long ones are searched as they are.
    """
    of = [texts.filter(F.length(c) <= _SHORT).select(shape(F.col(c)).alias("_shape")).distinct() for c in cols]
    every = of[0]
    for more in of[1:]:
        every = every.union(more)
    every = (every.distinct() if len(of) > 1 else every).repartition(2 * texts.sparkSession.sparkContext.defaultParallelism)
    return kept(every.select("_shape", _every(F.col("_shape"), with_names).alias("_known")), "shapes")


def _found(texts: DataFrame, shapes: DataFrame, col: str, with_names: bool) -> DataFrame:
    """texts and _f: array as of _every, of a column of which shapes are the shapes."""
    short = F.length(col) <= _SHORT
    # No shape holds the mark, so a long text meets none; its key is its own, lest all of them meet in one task.
    key = F.when(short, shape(F.col(col))).otherwise(F.concat(F.lit("\u0001"), F.xxhash64(col).cast("string")))
    out = texts.withColumn("_shape", key).join(shapes, "_shape", "left")
    return out.select(*texts.columns, F.when(short, F.col("_known")).otherwise(_every(F.col(col), with_names)).alias("_f"))


def _severity_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in _SEVERITY.items() for x in kv)), kind)


def _shown(text: Column, d: Column) -> Column:
    """The surface of an element of _every."""
    return F.coalesce(d["surface"], X.to_ascii_digits(F.substr(text, d["start"] + 1, d["end"] - d["start"])))


def extract_datums(blocks: DataFrame, text_col: str, origin: str, keys: list[str], *, with_names: bool = True) -> DataFrame:
    """keys, origin, ord, kind, surface, normalized, start, end, context, severity, role: a row per fact.

    ord is the order of place in the text (of equal places, that of the kinds).
    """
    blocks = blocks.select(*keys, X.without_marks(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    rows = _found(blocks, _shapes(blocks, ["_text"], with_names), "_text", with_names).select(*keys, "_text", F.posexplode("_f").alias("ord", "d"))
    rows = rows.withColumn("_surface", _shown(F.col("_text"), F.col("d")))
    return rows.select(
        *keys, F.lit(origin).alias("origin"), "ord", F.col("d.kind").alias("kind"), F.col("_surface").alias("surface"),
        normalized(F.col("d.kind"), F.col("_surface")).alias("normalized"),
        F.col("d.start").alias("start"), F.col("d.end").alias("end"),
        X.context_around("_text", F.col("d.start"), F.col("d.end")).alias("context"),
        F.col("d.severity").alias("severity"), F.col("d.role").alias("role"),
    )


# Agreement


def _first_of(table: list[tuple[str, list[str]]], text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, tokens in table[::-1]:
        hit = F.lit(False)
        for t in tokens:
            hit = hit | F.contains(text, F.lit(t))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def institution_key(surface: Column) -> Column:
    """Concept and qualifiers of an institution's name; null if no concept is known."""
    low = F.lower(surface)
    qualifiers = F.array_sort(F.filter(F.array(*(_first_of([q], low) for q in R.QUALIFIERS)), lambda x: x.isNotNull()))
    concept = _first_of(R.CONCEPTS, low)
    return F.when(concept.isNotNull(), F.concat(concept, F.lit(":"), F.array_join(qualifiers, "+")))


def match_key(kind: Column, surface: Column, value: Column) -> Column:
    """Two facts of a kind agree if their keys are equal."""
    squeezed = F.upper(F.regexp_replace(value, f"[{BLANKS}]+", ""))
    digits = F.array_join(F.regexp_extract_all(squeezed, F.lit("[0-9]+"), F.lit(0)), ",")
    return (
        F.when(kind == "number", F.substring_index(value, "|", 1))
        .when(kind.isin("section_ref", "case_number", "statute"), F.when(digits != "", digits).otherwise(squeezed))
        .when(kind == "place", F.coalesce(institution_key(surface), F.concat(F.lit("="), value)))
        .otherwise(value)
    )


#: Kinds of which facts that agree can have a note.
_NOTED = ["number", "section_ref", "case_number", "statute"]


def _note(kind: Column, a: Column, b: Column) -> Column:
    grouped = kind.eqNullSafe("number") & F.contains(a, F.lit("|")) & F.contains(b, F.lit("|"))
    return F.when(
        grouped & (a != b),
        F.concat(F.lit("digit grouping reformatted ("), F.substring_index(a, "|", -1), F.lit(" -> "), F.substring_index(b, "|", -1), F.lit(")")),
    ).when(
        kind.isin("section_ref", "case_number", "statute")
        & (F.upper(F.regexp_replace(a, r"\s+", "")) != F.upper(F.regexp_replace(b, r"\s+", ""))),
        F.lit("reference identifier matches; surrounding label differs"),
    )


#: Kinds that are matched in order of place.
_ORDERED = ["person_name", "party_name"]


def match_datums(source: DataFrame, target: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side, kind, surface, normalized, ord, severity, context, status, note, other: a row per fact.

    source and target come from extract_datums, with context or without; blocks has keys and target_blank.
    For kinds whose agreement is an equality of keys, matching the first unused
    equal fact is pairing by rank: the i-th of a key on one side with the i-th on
    the other. One fact of a kind on either side with unequal keys is a change.
    Names and blocks with an ambiguous source date are matched in order, a block
    at a time. status: agreed, changed, missing, repeated (missing, its value found
    elsewhere), silent (missing, no target), added, extra.
    """
    more = ["context"] if "context" in source.columns else []
    fields = [*keys, "kind", "surface", "normalized", "ord", "severity", *more]
    both = source.select(*fields, F.lit("s").alias("side")).union(target.select(*fields, F.lit("t").alias("side")))
    in_block = Window.partitionBy(*keys)
    doubtful = F.max((F.col("side") == "s") & (F.col("kind") == "date") & F.col("normalized").startswith("AMBIG:"))
    both = both.withColumn("_fold", F.col("kind").isin(_ORDERED) | ((F.col("kind") == "date") & doubtful.over(in_block)))
    both = kept(both, "facts")  # either way of matching reads it
    # All windows are within a block, so the facts are dealt by block once.
    plain = both.filter("not _fold").drop("_fold").repartition(*keys)
    plain = plain.withColumn("key", match_key(F.col("kind"), F.col("surface"), F.col("normalized")))
    of_kind = Window.partitionBy(*keys, "kind")
    of_key = Window.partitionBy(*keys, "kind", "key")
    plain = plain.withColumns({
        "i": F.row_number().over(Window.partitionBy(*keys, "kind", "key", "side").orderBy("ord")),
        "cs": F.count_if(F.col("side") == "s").over(of_key), "ct": F.count_if(F.col("side") == "t").over(of_key),
        "ns": F.count_if(F.col("side") == "s").over(of_kind), "nt": F.count_if(F.col("side") == "t").over(of_kind),
    })
    same_values = F.count_if(F.col("side") == "t").over(Window.partitionBy(*keys, "kind", "normalized"))
    pair = Window.partitionBy(*keys, "kind", "key", "i")
    other = F.when(F.col("side") == "s", F.max(F.when(F.col("side") == "t", F.struct("normalized", "surface"))).over(pair))
    lone = F.max(F.when(F.col("side") == "t", F.struct("normalized", "surface"))).over(of_kind)
    plain = plain.withColumns({"sv": same_values, "pair": other, "lone": lone})
    plain = plain.join(blocks.select(*keys, "target_blank"), keys, "left")
    change = (F.col("ns") == 1) & (F.col("nt") == 1) & (F.col("cs") + F.col("ct") == 1)
    status = (
        F.when((F.col("side") == "s") & (F.col("i") <= F.col("ct")), "agreed")
        .when((F.col("side") == "t") & (F.col("i") <= F.col("cs")), "agreed")
        .when(change, F.when(F.col("side") == "s", "changed").otherwise("agreed"))
        .when(F.col("side") == "t", F.when(F.col("kind").isin(ADDED) & (F.col("ns") > 0), "added").otherwise("extra"))
        .when(F.col("target_blank"), "silent")
        .when(F.col("sv") > 0, "repeated")
        .otherwise("missing")
    )
    agreed = (F.col("status") == "agreed") & (F.col("side") == "s")
    out = plain.withColumn("status", status)
    out = out.select(
        *keys, "side", "kind", "surface", "normalized", "ord", "severity", *more, "status",
        F.when(agreed, _note(F.col("kind"), F.col("normalized"), F.col("pair.normalized"))).alias("note"),
        F.when(agreed, F.col("pair.surface")).when(F.col("status") == "changed", F.col("lone.surface")).alias("other"),
    )
    folded = both.filter("_fold").drop("_fold").join(blocks.select(*keys, "target_blank"), keys, "left")
    return out.unionByName(_match_in_order(folded, keys, out))


#: Blocks of at most so many facts are matched within their row.
_FEW = 64


def _listed(rows: DataFrame, text: str, side: str, context: bool) -> DataFrame:
    """rows with the facts of a text in arrays side_kinds, _surfaces, _values, _keys and, if asked, _contexts, instead of the text and _f.

    Arrays of texts, as an array of structs is put together anew by every step that reads it.
    """
    name = lambda what: f"{side}_{what}"
    kinds, surfaces, values = (F.col(name(c)) for c in ("kinds", "surfaces", "values"))
    keep = [c for c in rows.columns if c not in (text, "_f")]
    around = F.transform("_f", lambda d: X.context_around(text, d["start"], d["end"])).alias(name("contexts"))
    rows = rows.select(
        *keep, F.col("_f.kind").alias(name("kinds")), F.transform("_f", lambda d: _shown(F.col(text), d)).alias(name("surfaces")), *([around] if context else []),
    )
    rows = rows.withColumn(name("values"), F.zip_with(kinds, surfaces, normalized))
    return rows.withColumn(name("keys"), F.transform(kinds, lambda k, i: match_key(k, F.get(surfaces, i), F.get(values, i))))


def _tagged(kinds: str, values: str) -> Column:
    """Kinds and values as one text each, which is never null."""
    return F.zip_with(kinds, values, lambda k, v: F.concat(k, F.coalesce(F.concat(F.lit("="), v), F.lit(""))))


def _pattern() -> Column:
    """What of a block's facts decides how they are matched, as one text: their kinds, which of them have one key, and of which source
    values the target has one. Blocks are many, their patterns few, so each pattern is matched once.
    """
    joined = lambda c: F.array_join(c, ",")
    first = F.transform("_tags", lambda x: F.array_position("_tags", x).cast("string"))
    again = F.transform("s_known", lambda x: F.array_contains("t_known", x).cast("string"))
    return F.concat_ws("|", joined("s_kinds"), joined("t_kinds"), joined(first), joined(again), F.coalesce("target_blank", F.lit(False)).cast("string"))


def _matched_patterns(patterns: DataFrame) -> DataFrame:
    """_pattern, _facts: array of struct(side, i, status, j, kind, severity) of every pattern."""
    part = lambda i: F.filter(F.split(F.get(F.split("_pattern", r"\|", -1), i), ","), lambda x: x != "")
    rows = patterns.select("_pattern", part(0).alias("s_kinds"), part(1).alias("t_kinds"), part(2).alias("_first"), part(3).alias("_again"), F.endswith("_pattern", F.lit("|true")).alias("target_blank"))
    n, m = F.size("s_kinds"), F.size("t_kinds")
    rows = rows.withColumns({"s_tags": F.slice("_first", F.lit(1), n), "t_tags": F.slice("_first", n + 1, m), "s_again": F.transform("_again", lambda x: x == "true")})

    def row(m: Column) -> Column:
        kind = F.when(m["side"] == "s", F.get("s_kinds", m["i"])).otherwise(F.get("t_kinds", m["i"]))
        return F.struct(*(m[c].alias(c) for c in ("side", "i", "status", "j")), kind.alias("kind"), _severity_of(kind).alias("severity"))

    return kept(rows.select("_pattern", F.transform(F.concat(_within("s"), _within("t")), row).alias("_facts")), "patterns")


def _within(of: str) -> Column:
    """array of struct(side, i, status, j): how the facts of a block are matched, as by match_datums if none is in order.

    i is a fact's place in its array, j that of the target's fact that it agrees with or is changed to. of: s or t.
    """
    own, other = ("s", "t") if of == "s" else ("t", "s")
    tags, fits = F.col(f"{own}_tags"), F.col(f"{other}_tags")
    kinds, others = F.col(f"{own}_kinds"), F.col(f"{other}_kinds")

    def row(k: Column, i: Column) -> Column:
        kind = F.get(kinds, i)
        at = F.array_compact(F.transform(fits, lambda x, j: F.when(x == k, j)))
        rank = F.size(F.filter(F.slice(tags, F.lit(1), i + 1), lambda x: x == k))
        lone = lambda kind: (F.size(F.filter(kinds, lambda x: x == kind)) == 1) & (F.size(F.filter(others, lambda x: x == kind)) == 1)
        pair = X.let(at, lambda a: F.when(F.size(a) > 0, F.get(a, rank - 1)))

        def settled(j: Column) -> Column:
            if of == "t":
                added = F.when(kind.isin(ADDED) & F.array_contains(others, kind), "added").otherwise("extra")
                status = F.when(j.isNotNull() | X.let(kind, lone), "agreed").otherwise(added)
                return F.struct(F.lit("t").alias("side"), i.alias("i"), status.alias("status"), F.lit(None).cast("int").alias("j"))
            again = F.get(F.col("s_again"), i)
            status = F.when(j.isNotNull(), "agreed").when(X.let(kind, lone), "changed").when(F.col("target_blank"), "silent").when(again, "repeated").otherwise("missing")
            changed = F.coalesce(j, (F.array_position(others, kind) - 1).cast("int"))  # not read unless changed
            return F.struct(F.lit("s").alias("side"), i.alias("i"), status.alias("status"), changed.alias("j"))

        return X.let(pair, settled)

    return F.transform(tags, row)


def _block_facts(blocks: DataFrame, keys: list[str], context: bool) -> DataFrame:
    """keys, target_blank, _apart, _pattern and the facts in arrays s_ and t_ kinds, surfaces, values (and contexts) of every block.

    _apart, with a null for _pattern: a block of many facts, with names or with an ambiguous source date.
    """
    clean = lambda c: X.without_marks(F.coalesce(F.col(c), F.lit("")))
    rows = blocks.select(*keys, "target_blank", clean("source_text").alias("_source"), clean("target_text").alias("_target"))
    shapes = _shapes(rows, ["_source", "_target"], True)
    for text, side in (("_source", "s"), ("_target", "t")):
        rows = _listed(_found(rows, shapes, text, True), text, side, context)
    in_order = lambda c: F.arrays_overlap(c, F.array(*map(F.lit, _ORDERED)))
    doubtful = F.exists("s_values", lambda v: F.coalesce(v.startswith("AMBIG:"), F.lit(False)))
    apart = (F.size("s_kinds") + F.size("t_kinds") > _FEW) | in_order("s_kinds") | in_order("t_kinds") | doubtful
    rows = rows.withColumn("_apart", apart)
    rows = rows.withColumns({f"{x}_{new}": _tagged(f"{x}_kinds", f"{x}_{old}") for x in "st" for new, old in (("tags", "keys"), ("known", "values"))})
    return rows.withColumn("_tags", F.concat("s_tags", "t_tags")).withColumn("_pattern", F.when(~F.col("_apart"), _pattern()))


def _match_apart(apart: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """match_datums of blocks whose facts are in arrays; fields: the array of each field but the kind."""
    def exploded(side: str) -> DataFrame:
        listed = F.arrays_zip(*(F.col(f"{side}_{c}").alias(out) for out, c in {"kind": "kinds", **fields}.items()))
        return apart.select(*keys, F.posexplode(listed).alias("ord", "f")).select(*keys, "ord", "f.*").withColumn("severity", _severity_of(F.col("kind")))

    return match_datums(exploded("s"), exploded("t"), apart.select(*keys, "target_blank"), keys)


#: Counts of a block's facts in the source, of those changed or missing, and of findings about them by severity.
TALLIES = ["n_datums", "n_changed", "found_critical", "found_major", "found_minor"]


def datum_tallies(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys and TALLIES, of what matched_datums and datum_findings have of a block: a row per block.

    Blocks of one pattern have the same counts, so their facts become no rows.
    """
    rows = _block_facts(blocks, keys, False)
    fields = {"surface": "surfaces", "normalized": "values"}
    kept_apart = [F.when(F.col("_apart"), F.col(f"{x}_{c}")).alias(f"{x}_{c}") for x in "st" for c in ("kinds", *fields.values())]
    rows = kept(rows.select(*keys, "target_blank", "_apart", "_pattern", *kept_apart), "block-facts")

    def tallied(matched: DataFrame, by: list[str]) -> DataFrame:
        source = F.col("side") == "s"
        n = matched.groupBy(*by).agg(F.count_if(source).alias("n_datums"), F.count_if(source & F.col("status").isin("changed", "missing")).alias("n_changed"))
        found = datum_findings(matched, by).groupBy(*by).agg(*(F.count_if(F.col("severity") == c.removeprefix("found_")).alias(c) for c in TALLIES[2:]))
        return n.join(found, by, "left")

    few = rows.filter("not _apart")
    no = F.lit(None).cast("string")
    patterns = _matched_patterns(few.select("_pattern").distinct()).select("_pattern", F.explode("_facts").alias("m")).select("_pattern", "m.*")
    patterns = kept(tallied(patterns.withColumns({"surface": no, "other": no, "note": no}), ["_pattern"]), "tallies")
    with_counts = lambda df: df.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in TALLIES))
    here = with_counts(few.join(patterns, "_pattern", "left"))
    apart = rows.filter("_apart")
    if apart.isEmpty():
        return here
    return here.unionByName(with_counts(apart.join(tallied(kept(_match_apart(apart, keys, fields), "apart"), keys), keys, "left")))


def matched_datums(blocks: DataFrame, keys: list[str], *, context: bool = False) -> DataFrame:
    """The facts of blocks (keys, source_text, target_text, target_blank) found and matched: the rows of match_datums, with context if asked.

    Both texts of a block are in its row, so the facts of most blocks are matched there, by their pattern: no
    fact is dealt or sorted. Blocks of many facts, with names or with an ambiguous source date go through match_datums.
    """
    rows = _block_facts(blocks, keys, context)
    fields = {"surface": "surfaces", "normalized": "values"} | ({"context": "contexts"} if context else {})
    kinds = [F.when(F.col("_apart"), F.col(f"{x}_kinds")).alias(f"{x}_kinds") for x in "st"]
    rows = kept(rows.select(*keys, "target_blank", "_apart", "_pattern", *kinds, *(f"{x}_{c}" for x in "st" for c in fields.values())), "block-facts")

    few = rows.filter("not _apart").drop("_apart")
    patterns = _matched_patterns(few.select("_pattern").distinct())
    here = few.join(patterns, "_pattern").select(*few.columns, F.explode("_facts").alias("m")).select(*few.columns, "m.*")
    source, i, j = F.col("side") == "s", F.col("i"), F.col("j")
    own = lambda c: F.when(source, F.get(f"s_{c}", i)).otherwise(F.get(f"t_{c}", i))
    note = F.when(source & (F.col("status") == "agreed") & F.col("kind").isin(_NOTED), _note(F.col("kind"), F.get("s_values", i), F.get("t_values", j)))
    other = F.when(F.col("status").isin("agreed", "changed"), F.get("t_surfaces", j))
    own_fields = {out: own(c).alias(out) for out, c in fields.items()}
    here = here.select(
        *keys, "side", "kind", own_fields["surface"], own_fields["normalized"], i.alias("ord"), "severity",
        *([own_fields["context"]] if context else []), "status", note.alias("note"), other.alias("other"),
    )

    apart = rows.filter("_apart")
    return here if apart.isEmpty() else here.unionByName(_match_apart(apart, keys, fields))


def _match_in_order(rows: DataFrame, keys: list[str], like: DataFrame) -> DataFrame:
    """Names by similarity of their keys and dates by readings, first unused fit, in order of place.

    What fits what is a join within a block, with the edit distance bounded by what a
    match allows; which fit is still free is a fold over the block's facts, in order, that
    carries the places taken. Both stay in the JVM; a block holds its own facts only.
    """
    key, latin = X.name_key("surface"), X.latin_key("surface")
    date = F.col("kind") == "date"
    rows = rows.withColumns({"_key": key, "_latin": F.when(latin != "", latin).otherwise(key)})
    readings = F.when(F.col("normalized").startswith("AMBIG:"), F.split(F.substr("normalized", F.lit(7)), r"\|")).otherwise(F.array("normalized"))
    rows = rows.withColumn("_read", F.when(date, readings))
    side = lambda name, *more: rows.filter(F.col("side") == name).select(*keys, *(F.col(c).alias(f"{name}_{c.strip('_')}") for c in ("ord", "kind", "normalized", "_read", *more)))
    s, t = side("s", "_key", "target_blank"), side("t", "_latin", "surface")
    longest = F.greatest(F.length("s_key"), F.length("t_latin"))
    most = F.floor(longest * 0.15 + 1e-9).cast("int")  # as many edits as leave 0.85
    edits = F.levenshtein("s_key", "t_latin")
    by_name = (
        (F.col("s_kind") != "date") & F.col("t_kind").isin("person_name", "party_name") & ((F.col("t_kind") == F.col("s_kind")) | (F.col("t_kind") == "person_name"))
        & (F.col("s_key") != "") & (F.col("t_latin") != "") & (F.abs(F.length("s_key") - F.length("t_latin")) <= most) & (1 - edits / longest >= 0.85)
    )
    same = F.col("s_normalized") == F.col("t_normalized")
    doubtful = F.col("s_normalized").startswith("AMBIG:")
    by_date = (F.col("s_kind") == "date") & (F.col("t_kind") == "date") & (same | (doubtful & F.arrays_overlap("s_read", "t_read")))
    fit = F.struct(F.col("t_ord").alias("t"), F.when(F.col("s_kind") != "date", 1 - edits / longest).alias("close"), same.alias("same"), F.col("t_surface").alias("surface"))
    fits = s.join(t, keys).filter(by_name | by_date).groupBy(*keys, "s_ord").agg(F.array_sort(F.collect_list(fit)).alias("fits"))
    asked = s.join(fits, [*keys, "s_ord"], "left")
    fact = F.struct("s_ord", F.col("s_kind").alias("kind"), doubtful.alias("doubtful"), F.coalesce("s_target_blank", F.lit(True)).alias("blank"), "fits")
    blocks = asked.groupBy(*keys).agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    taken = "array<struct<ord:int,t:int,status:string,note:string,other:string>>"

    def step(out: Column, f: Column) -> Column:
        used = F.filter(F.transform(out, lambda o: o["t"]), lambda t: t.isNotNull())
        is_date = f["kind"] == "date"

        def row(fit: Column) -> Column:
            again = F.exists(F.coalesce(f["fits"], F.array().cast(fits.schema["fits"].dataType)), lambda x: x["same"] & F.array_contains(used, x["t"]))
            status = (
                F.when(fit.isNotNull(), F.when(is_date & f["doubtful"], "ambiguous").otherwise("agreed"))
                .when(is_date & f["doubtful"], "missing").when(f["blank"], "silent")
                .when(is_date & again, "repeated").otherwise("missing")
            )
            note = F.when(~is_date & (fit["close"] < 0.9), "spelling")
            return F.array_append(out, F.struct(f["s_ord"].alias("ord"), fit["t"].alias("t"), status.alias("status"), note.alias("note"), fit["surface"].alias("other")))

        return X.let(F.get(F.filter(f["fits"], lambda x: ~F.array_contains(used, x["t"])), 0), row)

    found = blocks.select(*keys, F.explode(F.aggregate("facts", F.array().cast(taken), step)).alias("o")).select(*keys, "o.*")
    fields = [c for c in like.columns if c not in ("status", "note", "other")]
    sources = rows.filter("side = 's'").select(*fields).join(found.drop("t"), [*keys, "ord"])
    dates = rows.filter((F.col("side") == "s") & date).select(*keys).distinct().withColumn("_dates", F.lit(True))
    targets = rows.filter("side = 't'").select(*fields).join(found.filter("t is not null").select(*keys, F.col("t").alias("ord"), F.lit(True).alias("_used")), [*keys, "ord"], "left")
    targets = targets.join(dates, keys, "left").withColumn("status", F.when(F.col("_used"), "agreed").when(date & F.col("_dates"), "added").otherwise("extra"))
    targets = targets.withColumns({"note": F.lit(None).cast("string"), "other": F.lit(None).cast("string")})
    names_ = like.columns
    return sources.select(*names_).union(targets.select(*names_))


def datum_findings(matched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, check, category, severity, title, source_excerpt: what matching has found."""
    kind, status, note = F.col("kind"), F.col("status"), F.col("note")
    is_name = kind.isin("person_name", "party_name")
    of = lambda check, severity: F.struct(check.alias("check"), severity.alias("severity"))
    found = (
        F.when(is_name & (status == "missing"), of(F.lit("datum.name_missing"), F.lit("critical")))
        .when(is_name & (note == "spelling"), of(F.lit("datum.name_spelling_drift"), F.lit("major")))
        .when(is_name, F.lit(None))
        .when(status == "ambiguous", of(F.lit("datum.date_ambiguous"), F.lit("major")))
        .when(status == "added", of(F.concat(F.lit("datum."), kind, F.lit("_added")), F.lit("major")))
        .when(status.isin("changed", "missing"), of(F.concat(F.lit("datum."), kind, F.lit("_"), status), F.col("severity")))
        .when(note.isNotNull() & (status == "agreed"), of(F.lit("datum.reformatted"), F.lit("info")))
    )
    category = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in R.CATEGORIES.items() for x in kv)), kind), F.lit("Data fidelity"))
    label = F.element_at(F.create_map(*(F.lit(x) for kv in V.DATUM_LABELS.items() for x in kv)), kind)
    shown = F.concat(F.lit('"'), X.display_surface("surface"), F.lit('"'))
    title = (
        F.when(status == "changed", F.concat(label, F.lit(" changed: "), shown, F.lit(' → "'), X.display_surface("other"), F.lit('"')))
        .when(status == "added", F.concat(F.lit('Value "'), F.col("surface"), F.lit('" appears only in the translation')))
        .when(status == "ambiguous", F.concat(F.lit("Ambiguous source date "), shown))
        .when(status == "missing", F.concat(label, F.lit(" "), shown, F.lit(" missing from the translation")))
        .when(F.col("_f.check") == "datum.name_spelling_drift", F.concat(F.lit('Name rendered as "'), F.col("other"), F.lit('"')))
        .otherwise(F.concat(F.lit("Formatting difference on "), shown))
    )
    out = matched.withColumn("_f", found).filter("_f is not null")
    return out.select(
        *keys, F.col("_f.check").alias("check"),
        F.when(F.col("_f.check") == "datum.reformatted", "Data fidelity").otherwise(category).alias("category"),
        F.col("_f.severity").alias("severity"), title.alias("title"), (F.col("context") if "context" in matched.columns else F.lit(None).cast("string")).alias("source_excerpt"),
    )
