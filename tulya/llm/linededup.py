"""Repeated lines across documents, by a deletion-neighbourhood join; SQL functions only.

Lines are compared after lower-casing and folding blanks. The unit of an edit is
a word, the bound one edit for every ten words of the longer line and one at
least. In lines under five words the unit is a character, the bound one edit;
the longer needs ten characters for it, and digits aren't edited (two numbers are no
typo of each other).

One edit: each line's variants are the line itself and the line with any one unit
left out, as hashed keys:

* equal variants with the same unit left out are substitutions. All members of
  such a group are within one edit of each other, so each is compared with the
  group's earliest only, and a group of any size costs its own length;
* a variant equal to another whole line is an insertion or a deletion, found by
  an equi-join.

The units of either pair are then compared, which settles the edit distance.
A line goes if an earlier line equals it or is within the bound of it.

Emitting every variant of every line is not needed: two lines within one edit
share one half of their units unchanged. Lines none of whose halves occur in
another line are passed over; nothing that could match is lost.

More edits (lines of 20 words and more): an edit touches three runs of three words
at most, so of the runs in the order of their hashes, 3 k + 1 from either line have
one in common if the lines are within k edits. Lines are different texts here, copies
count once. Each line carries a sketch, the parity of its words by 64 bits of their hashes
(long lines by 512 too, as theirs allow many edits): a replaced word changes two bits at most, one put in or left out one bit
and the length by one, so pairs whose bits and lengths differ by more than twice their bound
are none and aren't written. A line is compared, by its edit distance, with the earliest line of
each of its runs, which costs a run its own length. Only what that leaves is compared with every
earlier line of its runs, in as many parts as keep the pairs of each few: a run that many lines keep, none of
them near the earliest, still meets them in pairs, which takes time but no room.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_table, free, maybe_in, session, texts, tidy, written


#: Blanks within a line. Runs of them fold into one blank; at its ends they don't count.
_BLANKS = " \t\r\x0b\x0c"


def _lines(body: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, raw of every line."""
    return body.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))


def _words(lines: DataFrame, *keep: str) -> DataFrame:
    """keep, w, n: the lower-case words of every line that isn't blank, and how many."""
    bare = lines.select(*keep, F.btrim(F.lower("raw"), F.lit(_BLANKS)).alias("bare")).filter("bare != ''")
    return bare.select(*keep, F.split("bare", f"[{_BLANKS}]+", -1).alias("w")).withColumn("n", F.size("w"))


def _halves(units: str, tag: str, first: str, last: str) -> str:
    """Hashes of the first and last half of a line, as it is and as if it were a unit shorter."""
    both = []
    for m in (units, f"({units} - 1)"):
        both.append(f"xxhash64('{tag}1', {m}, {first.format(k=f'cast({m} div 2 as int)')})")
        both.append(f"xxhash64('{tag}2', {m}, {last.format(k=f'cast({m} - {m} div 2 as int)')})")
    return f"array({', '.join(both)})"


#: Characters that a line under least_words words needs to be compared by them.
LEAST_CHARS = 10
#: Words for each edit, and words in a run.
EDIT_WORDS, RUN = 10, 3


#: The characters of a short line.
_CHARS = "transform(sequence(1, char_length(array_join(w, ' '))), i -> substring(array_join(w, ' '), i, 1))"
#: Words as one character each by their hashes.
_HASHED = "decode(unhex(array_join(transform(w, x -> concat('000', hex(65536 + (xxhash64(x) & 524287)))), '')), 'UTF-32')"


def _fetched(wanted: DataFrame, body: DataFrame, least_words: int) -> DataFrame:
    """h, at, gated, chars, w (words or characters), n and hashed words of the wanted lines. wanted: h, at, gated."""
    spot = F.xxhash64("doc_id", "text_key", "line_no")
    wanted = wanted.select("h", "at", "gated", "at.*").withColumn("spot", spot)
    of_docs, of_lines = (bitmap_table(wanted.select(F.col(c).alias("key")).distinct()) for c in ("text_key", "spot"))
    lines = maybe_in(_lines(maybe_in(body, "text_key", of_docs)).withColumn("here", spot), "here", of_lines)
    place = wanted.select("h", "at", "gated", "spot", F.col("doc_id").alias("i"), F.col("text_key").alias("k"), F.col("line_no").alias("l"))
    same = (F.col("here") == F.col("spot")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")) & (F.col("line_no") == F.col("l"))
    lines = lines.join(place, same).dropDuplicates(["h"])
    out = _words(lines, "h", "at", "gated").withColumn("chars", F.size("w") < least_words)
    out = out.withColumn("hashed", F.expr(f"if(n < {2 * EDIT_WORDS - 2}, null, {_HASHED})"))
    out = out.withColumn("w", F.expr(f"if(chars, {_CHARS}, w)")).withColumn("n", F.size("w"))
    out = written(out, "lines")
    free(of_docs[0], of_lines[0])
    return out


def _near(lines: DataFrame) -> list[DataFrame]:
    """Tables of (h): lines within one edit of an earlier one."""
    lines = lines.filter("gated")
    fixed = "chars and {} between '0' and '9'"
    # A line's words with their places, as one number; leaving a word out is one more xor.
    placed = "aggregate(sequence(0, n - 1), 0L, (x, i) -> x ^ xxhash64(w[i], i))"
    holes = lines.select("h", "at", "chars", "n", "w", F.expr(placed).alias("all")).select(
        "h", "at", "chars", "n", "all", F.posexplode("w").alias("i", "word")
    )
    holes = holes.filter(f"not ({fixed.format('word')})")
    holes = holes.select(F.expr("xxhash64('hole', chars, n, i, all ^ xxhash64(word, i))").alias("key"), "at", "h")
    first = holes.groupBy("key").agg(F.min(F.struct("at", "h")).alias("e"), F.max("h").alias("hi"), F.min("h").alias("lo"))
    first = first.filter("lo != hi").select("key", F.col("e.h").alias("e"))
    swapped = holes.select("key", "h").join(first, "key").filter("h != e").select("h", "e").distinct()
    swapped = written(swapped, "swapped")  # step by step, so that the shuffle files of each can go

    # A line as the set of its neighbouring words, the ends being neighbours of nothing.
    pairs = "aggregate(sequence(0, n), 0L, (x, i) -> x ^ xxhash64(p[i], p[i + 1]))"
    framed = lines.select("h", "at", "chars", "n", F.expr("concat(array(''), w, array(''))").alias("p")).withColumn(
        "all", F.expr(pairs)
    )
    short = framed.select(F.expr("xxhash64('gap', chars, n, all)").alias("key"), F.col("h").alias("short"))
    left_out = framed.select("h", "chars", "n", "all", "p", F.explode(F.expr("sequence(1, n)")).alias("i"))
    left_out = left_out.filter(f"not ({fixed.format('p[i]')})").select(
        F.expr("xxhash64('gap', chars, n - 1, all ^ xxhash64(p[i - 1], p[i]) ^ xxhash64(p[i], p[i + 1]) ^ xxhash64(p[i - 1], p[i + 1]))").alias("key"),
        F.col("h").alias("long"),
    )
    shorter = written(left_out.join(short, "key").select("long", "short").distinct(), "shorter")  # several places can have one key

    one = lines.select(F.col("h").alias("h1"), F.col("at").alias("at1"), F.col("n").alias("n1"), F.col("w").alias("w1"), F.col("chars").alias("c1"))
    two = lines.select(F.col("h").alias("h2"), F.col("at").alias("at2"), F.col("n").alias("n2"), F.col("w").alias("w2"), F.col("chars").alias("c2"))
    later = F.when(F.col("at1") > F.col("at2"), F.col("h1")).otherwise(F.col("h2")).alias("h")
    by_swap = (
        swapped.join(one, F.col("h") == F.col("h1"))
        .join(two, F.col("e") == F.col("h2"))
        .filter(f"c1 = c2 and (not c1 or n1 >= {LEAST_CHARS}) and n1 = n2 and aggregate(zip_with(w1, w2, (a, b) -> a = b), 0, (x, same) -> x + if(same, 0, 1)) = 1")
        .select(later)
    )
    by_gap = (
        shorter.join(one, F.col("long") == F.col("h1"))
        .join(two, F.col("short") == F.col("h2"))
        .filter(f"c1 = c2 and (not c1 or n1 >= {LEAST_CHARS}) and n1 = n2 + 1")
        # If leaving out any word will do, so will leaving out the first that differs.
        .withColumn("i", F.expr("cast(array_position(zip_with(slice(w1, 1, n2), w2, (a, b) -> a = b), false) as int)"))
        .withColumn("i", F.expr("if(i = 0, n1, i)"))
        .filter("concat(slice(w1, 1, i - 1), slice(w1, i + 1, n1)) = w2")
        .select(later)
    )
    near = [written(by_swap.distinct(), "by-swap"), written(by_gap.distinct(), "by-gap")]
    free(swapped, shorter)
    return near


#: Words as one character each by their first place among the words of both, so that levenshtein counts words.
_CODE = "decode(unhex(array_join(transform({w}, x -> lpad(hex(65536 + array_position(both, x)), 8, '0')), '')), 'UTF-32')"


def _run_keys() -> str:
    """SQL: the smallest hashes of a line's runs, as many as are needed for all its edits."""
    runs = f"transform(sequence(0, n - {RUN}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(RUN))}))"
    # The longer of two lines has at most a tenth more words than the shorter, and so n div 9 edits at most.
    first = f"slice(sort_array(array_distinct({runs})), 1, {RUN} * (n div {EDIT_WORDS - 1}) + 1)"
    # A line two words short of two edits may be within two of one that isn't.
    return f"if(n >= {2 * EDIT_WORDS - 2}, {first}, cast(array() as array<bigint>))"


#: SQL: for each of 64 bits whether a line has an odd number of words of it; of lines that have runs.
_SKETCH = f"if(n >= {2 * EDIT_WORDS - 2}, aggregate(w, 0L, (x, v) -> x ^ shiftleft(1L, cast(xxhash64(v) & 63 as int))), null)"


#: Words from which a line has a wide sketch, and the longs of that.
WIDE_WORDS, WIDE = 144, 8
#: SQL: the parities by 512 bits, of which the sketch has those of 64; null for shorter lines.
_WIDE = (
    f"if(n >= {WIDE_WORDS}, transform(array(transform(w, v -> xxhash64(v))), hs -> transform(sequence(0, {WIDE - 1}), j -> "
    f"aggregate(hs, 0L, (x, y) -> x ^ if((y & {(WIDE - 1) * 64}) = j * 64, shiftleft(1L, cast(y & 63 as int)), 0L))))[0], null)"
)
#: SQL: whether the sketches of two lines (n, sketch, wide and m, other, others) allow their bound of two edits or more.
_BOUND = f"cast(greatest(n, m) div {EDIT_WORDS} as int)"
_ALIKE = (
    f"{_BOUND} >= 2 and abs(n - m) <= {_BOUND} and bit_count(sketch ^ other) + abs(n - m) <= 2 * {_BOUND} and (wide is null or others is null or "
    + " + ".join(f"bit_count(wide[{j}] ^ others[{j}])" for j in range(WIDE)) + f" + abs(n - m) <= 2 * {_BOUND})"
)
#: Rows of pairs that are worked on at a time.
MOST_PAIRS = 1 << 24


def _sharing(occ: DataFrame) -> DataFrame:
    """(key, h, n, sketch, wide): the runs of lines that another line has too."""
    each = occ.select("h", "n", "sketch", "wide", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo != hi").select("key")
    shared = written(shared, "shared-runs")
    bits = bitmap_table(shared)
    some = written(maybe_in(each, "key", bits).distinct(), "maybe-shared")  # step by step, as each table is large
    free(bits[0], occ)
    sharing = written(some.join(shared, "key", "left_semi"), "sharing")
    free(some, shared)
    return sharing


def _other(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(F.col("key").alias("k"), F.col("h").alias("e"), F.col("n").alias("m"), F.col("sketch").alias("other"), F.col("wide").alias("others"), *more)


def _alive(sharing: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, h, n, sketch, wide, at): the runs that a line shares with one its sketch allows."""
    some = written(sharing.join(_other(sharing), F.expr(f"key = k and h != e and {_ALIKE}"), "left_semi"), "alike")
    free(sharing)
    alive = written(some.join(firsts.select("h", "at"), "h"), "alive")
    free(some)
    return alive


def _far(alive: DataFrame, lines: DataFrame) -> list[DataFrame]:
    """Tables of (h): the lines within a bound of two edits or more of an earlier one."""
    leads = written(alive.groupBy("key").agg(F.min(F.struct("at", "h", "n", "sketch", "wide")).alias("f")).select(F.col("key").alias("k"), "f.*"), "leads")
    lead = leads.select("k", *(F.col(c).alias(x) for c, x in zip(("h", "n", "sketch", "wide"), ("e", "m", "other", "others"), strict=True)))
    led = alive.join(lead, F.expr("key = k and h != e"))
    pairs = written(led.filter(_ALIKE).select("h", "e", F.expr(_BOUND).alias("bound")).distinct(), "pairs")
    found = _close(pairs, lines)
    # The earliest line of a run has been compared with all others of it.
    others = written(led.select(*alive.columns), "others")
    free(pairs, leads)
    rest = written(others.join(reduce(DataFrame.union, found).withColumnRenamed("h", "near_h"), F.col("h") == F.col("near_h"), "left_anti"), "rest")
    both = lambda rows: rows.join(_other(others, F.col("at").alias("before")), F.expr(f"key = k and before < at and {_ALIKE}"))
    with tidy(session(rest)):
        parts = -(-both(rest).count() // MOST_PAIRS)
    for i in range(parts):
        some = both(rest.filter(f"pmod(h, {parts}) = {i}")).select("h", "e", F.expr(_BOUND).alias("bound"))
        pairs = written(some.distinct(), "more-pairs")
        found += _close(pairs, lines)
        free(pairs)
    free(others, rest)
    return found


def _close(pairs: DataFrame, lines: DataFrame) -> list[DataFrame]:
    """Tables of (h): the lines of pairs (h, e, bound) that are within the bound of their earlier one."""
    one, two = (lines.select(F.col("h").alias(f"h{i}"), F.col("w").alias(f"w{i}"), F.col("hashed").alias(f"c{i}")) for i in (1, 2))
    both = pairs.join(one.drop("w1"), F.col("h") == F.col("h1")).join(two.drop("w2"), F.col("e") == F.col("h2"))
    # Words of one hash count as equal here, so these are no more edits than there are; the words themselves stay behind.
    close = written(both.filter("levenshtein(c1, c2, bound) >= 0").select("h", "e", "bound"), "close")
    edits = f"levenshtein({_CODE.format(w='w1')}, {_CODE.format(w='w2')}, bound)"
    # They are exact if the words of both have as many hashes. As the argument of a lambda these words are listed once.
    exact = f"size(array_distinct(transform(both, x -> xxhash64(x) & 524287))) = size(both) or {edits} >= 0"

    def settled(some: DataFrame, what: str) -> DataFrame:
        half = written(some.join(one.drop("c1"), F.col("h") == F.col("h1")).select("h", "e", "bound", "w1"), "half")
        words = half.join(two.drop("c2"), F.col("e") == F.col("h2"))
        out = written(words.filter(f"transform(array(array_union(w1, w2)), both -> {exact})[0]").select("h").distinct(), what)
        free(half)
        return out

    # One pair settles nearly every line; where two words of it had one hash, all its others are looked at.
    sure = settled(close.groupBy("h").agg(F.min_by("bound", "e").alias("bound"), F.min("e").alias("e")), "far")
    more = settled(close.join(sure, "h", "left_anti"), "far-more")
    free(close)
    return [sure, more]


def removed_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5
) -> DataFrame:
    """doc_id, text_key, line_no (from 0), near: the lines to remove.

    The earliest place of a line is that of the smallest (doc_id, text_key,
    line_no), nulls first. Every later line equal to it (after folding) goes; a
    line also goes, wherever it stands, if an earlier one is within the bound of
    it (near): a word for every ten words, one at least, or in lines of fewer than
    least_words words and at least LEAST_CHARS characters one character.

    Blank lines stay and null texts have no lines. Rows with the same id and text
    are one document. Ids may be of any type that can be ordered. An empty table
    gives an empty result.
    """
    body = texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    of_words = _halves("n", "w", "slice(w, 1, {k})", "slice(w, -{k}, {k})")
    of_chars = _halves("char_length(array_join(w, ' '))", "c", "left(array_join(w, ' '), {k})", "right(array_join(w, ' '), {k})")
    occ = _words(_lines(body), "doc_id", "text_key", "line_no").select(
        "doc_id", "text_key", "line_no", "n", F.xxhash64("w").alias("h"),
        F.expr(
            f"case when n >= {least_words} then {of_words} "
            f"when char_length(array_join(w, ' ')) >= {LEAST_CHARS - 1} then {of_chars} else cast(array() as array<bigint>) end"
        ).alias("halves"),
        F.expr(_run_keys()).alias("keys"), F.expr(_SKETCH).alias("sketch"), F.expr(_WIDE).alias("wide"),
    )
    occ = written(occ, "occurrences")
    place = F.struct("doc_id", "text_key", "line_no")
    firsts = written(occ.groupBy("h").agg(F.min(place).alias("at"), F.max(place).alias("last")), "firsts")
    halves = occ.select("h", F.explode("halves").alias("key"))
    shared = halves.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo != hi").select("key")
    shared = written(shared, "shared")
    bits = bitmap_table(shared)
    in_two = maybe_in(halves, "key", bits).select("h").distinct()
    gated = written(firsts.join(in_two, "h", "left_semi").select("h", "at", F.lit(True).alias("gated")), "gated")
    free(shared, bits[0])
    places = written(occ.select("doc_id", "text_key", "line_no", "h"), "places")
    alive = _alive(_sharing(occ), firsts)
    asked = alive.select("h").distinct()
    asked = firsts.select("h", "at", F.lit(False).alias("gated")).join(asked, "h", "left_semi")
    wanted = written(gated.union(asked).groupBy("h").agg(F.min("at").alias("at"), F.max("gated").alias("gated")), "wanted")
    lines = _fetched(wanted, body, least_words)
    found = [*_near(lines), *_far(alive, lines)]
    near = written(reduce(DataFrame.union, found).distinct().toDF("near_h"), "near")
    free(gated, wanted, alive, lines, *found)
    bad = firsts.join(near, F.col("h") == F.col("near_h"), "left").filter("at != last or near_h is not null")
    # A join of its own, whose largest keys Spark can split.
    bad = written(bad.select(F.col("h").alias("bad"), "at", F.col("near_h").isNotNull().alias("near")), "bad")
    gone = (
        places.withColumn("here", place)
        .join(bad, F.col("h") == F.col("bad"))
        .filter(F.col("near") | ~F.col("here").eqNullSafe(F.col("at")))
        .select("doc_id", "text_key", "line_no", "near")
        .distinct()
    )
    gone = written(gone, "gone")
    free(places, firsts, near, bad)
    return gone


#: Names that no table is likely to have.
_GONE, _NEAR_COUNT = "_tulya_gone", "_tulya_near"
_LEFT = f"array_join(filter(split({{text}}, '\\n', -1), (x, i) -> not array_contains({_GONE}, i)), '\\n')"


def _marked(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """docs with the numbers of the lines to remove (null if none) and how many of them are near."""
    gone = (
        removed_lines(docs, id_col=id_col, text_col=text_col, **options)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("line_no").alias(_GONE), F.count_if("near").alias(_NEAR_COUNT))
        .withColumnsRenamed({"doc_id": "_tulya_id", "text_key": "_tulya_key"})
    )
    same = (F.xxhash64(docs[text_col]) == gone["_tulya_key"]) & docs[id_col].eqNullSafe(gone["_tulya_id"])
    return docs.join(gone, same, "left")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_lines, n_removed, n_near, text): a row per row of docs, without its removed lines.

    See removed_lines for which lines go. A text of which nothing goes is returned
    as it was, a null text as null (n_lines 0).
    """
    docs = texts(docs, id_col, text_col)
    return _marked(docs, "doc_id", "text", **options).select(
        "doc_id",
        F.coalesce(F.expr("octet_length(text) - octet_length(replace(text, '\\n', '')) + 1"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size(_GONE), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(_NEAR_COUNT, F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col(_GONE).isNull(), F.col("text")).otherwise(F.expr(_LEFT.format(text="text"))).alias("text"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their repeated lines cut out; n_chars follows. Those left without a line go."""
    cut = F.col(_GONE).isNotNull()
    out = _marked(docs, "doc_id", "text").withColumn(
        "text", F.when(cut, F.expr(_LEFT.format(text="text"))).otherwise(F.col("text"))
    )
    out = out.filter(~cut | F.rlike("text", F.lit(r"[^ \t\r\n]")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
