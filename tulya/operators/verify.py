"""Coverage, alignment and structure of a translation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.jsregex import java
from ..rules import values as V

#: Gap of the alignment; least length of a target, in characters and as a share of its source.
GAP = -0.35
LEAST_CHARS, LEAST_SHARE = 8, 0.45
RESIDUE = 0.08


def coverage_state(source: Column, target: Column) -> Column:
    """empty, stunted or translated."""
    text = F.coalesce(target, F.lit(""))
    # Most texts have blanks that need no pattern to be put in order.
    s, t = F.length(F.coalesce(source, F.lit(""))), F.length(F.when(X.has_single_blanks(text), X.trimmed(text)).otherwise(X.normalize_whitespace(text)))
    expected = F.greatest(F.lit(LEAST_CHARS), F.floor(s * LEAST_SHARE + 0.5))
    return F.when(t == 0, "empty").when((t < expected) & (t < s), "stunted").otherwise("translated")


def coverage(blocks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """doc, n_blocks, n_translated, n_empty, n_stunted, ratio."""
    state = coverage_state(F.col("source_text"), F.col("target_text"))
    out = blocks.select(doc_col, state.alias("state")).groupBy(doc_col).agg(*coverage_counts(F.col("state")))
    return out.withColumn("ratio", F.col("n_translated") / F.col("n_blocks"))


def coverage_counts(state: Column) -> list[Column]:
    """Aggregates n_blocks, n_translated, n_empty, n_stunted of the states of blocks."""
    return [
        F.count("*").alias("n_blocks"), F.count_if(state != "empty").alias("n_translated"),
        F.count_if(state == "empty").alias("n_empty"), F.count_if(state == "stunted").alias("n_stunted"),
    ]


_ALIGNED = "method string, exact boolean, pairs array<struct<src:int,tgt:int,confidence:double>>, unmatched_source array<int>, unmatched_target array<int>"


def align(df: DataFrame, source_col: str, target_col: str, id_col: str = "doc_id", *, clean: bool = True) -> DataFrame:
    """id, method, exact, pairs, unmatched_source, unmatched_target of sentence arrays.

    With clean, words are compared without the characters of text.clean_invisible, which
    has all of U+00AD to U+200F (accented letters too); else such a character ends a word.

    Equal numbers pair by place, in the JVM. Others are aligned in order (Needleman
    and Wunsch, by shared words), a document at a time in an Arrow batch.
    """
    n, m = F.size(source_col), F.size(target_col)
    rows = df.select(F.col(id_col), F.col(source_col).alias("src"), F.col(target_col).alias("tgt"), (n == m).alias("same"), (F.least(n, m) == 0).alias("none"))
    count = lambda c: F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
    pair = F.transform(count("src"), lambda i: F.struct(i.alias("src"), i.alias("tgt"), F.lit(1.0).alias("confidence")))
    nothing = F.array().cast("array<int>")
    plain = rows.filter("same or none").select(
        id_col, F.when(F.col("same"), "positional").otherwise("resegmented").alias("method"), F.col("same").alias("exact"),
        F.when(~F.col("none"), pair).otherwise(F.array().cast("array<struct<src:int,tgt:int,confidence:double>>")).alias("pairs"),
        F.when(F.col("none"), count("src")).otherwise(nothing).alias("unmatched_source"),
        F.when(F.col("none"), count("tgt")).otherwise(nothing).alias("unmatched_target"),
    )
    words = lambda c: F.transform(c, lambda x: F.array_distinct(F.filter(F.split(F.lower(X.clean_invisible(x) if clean else x), "[^a-z0-9]+", -1), lambda w: F.length(w) > 2)))
    rest = rows.filter("not same and not none").select(id_col, words("src").alias("src"), words("tgt").alias("tgt"))

    def run(batches):
        for batch in batches:
            found = [_align(list(s), list(t)) for s, t in zip(batch["src"], batch["tgt"], strict=True)]
            yield pd.DataFrame({
                id_col: batch[id_col], "method": "resegmented", "exact": False,
                "pairs": [f[0] for f in found], "unmatched_source": [f[1] for f in found], "unmatched_target": [f[2] for f in found],
            })

    kind = df.schema[id_col].dataType.simpleString()
    return plain.unionByName(rest.mapInPandas(run, f"{id_col} {kind}, {_ALIGNED}"))


#: Sentence pairs up to which plain loops are quicker, and rows that are worked on at a time beyond.
_FEW, _BAND = 1500, 256


def _align(src: list, tgt: list) -> tuple[list[dict], list[int], list[int]]:
    """Pairs in order; places without a partner, last first. Of equal scores a pair comes before a source gap.

    The scores are of Needleman and Wunsch. Few sentences are scored in plain loops, many
    in bands of rows, along each band's diagonals: kept are the scores above every band,
    and on the way back a band is scored again with its directions. Memory is a band and
    a row for each band, not all pairs; either way the numbers are the same to the last bit.
    """
    a, b = [set(x) for x in src], [set(x) for x in tgt]
    pairs, lone_src, lone_tgt = [], [], []
    for move, i, j in _plain_moves(a, b) if len(a) * len(b) <= _FEW else _banded_moves(a, b):
        if move == 0:
            pairs.append({"src": i, "tgt": j, "confidence": len(a[i] & b[j]) / min(len(a[i]), len(b[j])) if a[i] and b[j] else 0.0})
        elif move == 1:
            lone_src.append(i)
        else:
            lone_tgt.append(j)
    return pairs[::-1], lone_src, lone_tgt


def _walk(n: int, m: int, move_at: Callable[[int, int], int]) -> Iterator[tuple[int, int, int]]:
    """Moves from the end to the start: 0 a pair, 1 a source, 2 a target alone, with the places."""
    i, j = n, m
    while i or j:
        move = 1 if not j else 2 if not i else move_at(i, j)
        i, j = i - (move != 2), j - (move != 1)
        yield move, i, j


def _plain_moves(a: list[set], b: list[set]) -> Iterator[tuple[int, int, int]]:
    n, m = len(a), len(b)
    score = [[GAP * j for j in range(m + 1)]] + [[GAP * i] + [0.0] * m for i in range(1, n + 1)]
    moves = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            pair = score[i - 1][j - 1] + (len(x & y) / min(len(x), len(y)) if x and y else 0.0)
            up, left = score[i - 1][j] + GAP, score[i][j - 1] + GAP
            score[i][j] = best = max(pair, up, left)
            moves[i][j] = 0 if best == pair else 1 if best == up else 2
    return _walk(n, m, lambda i, j: moves[i][j])


def _banded_moves(a: list[set], b: list[set]) -> Iterator[tuple[int, int, int]]:
    n, m = len(a), len(b)
    where: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        for w in y:
            where.setdefault(w, []).append(j)
    places, sizes = {w: np.array(js) for w, js in where.items()}, np.array([len(y) for y in b])

    def likeness(at: int, rows: int) -> np.ndarray:
        out = np.zeros((rows, m))
        for r in range(rows):
            x = a[at + r]
            shared = [places[w] for w in x if w in places]
            if shared:
                common = np.bincount(np.concatenate(shared), minlength=m)
                out[r] = common / np.maximum(np.minimum(sizes, len(x)), 1)
        return out

    def band(at: int, above: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
        """Scores of the last row of the band that starts behind row at, whose scores are above."""
        rows = min(_BAND, n - at)
        like = likeness(at, rows)
        skewed = np.zeros((m + rows - 1, rows))  # a diagonal of pairs a row
        for r in range(rows):
            skewed[r : r + m, r] = like[r]
        del like
        first = np.array([GAP * (at + r) for r in range(1, rows + 1)])  # scores before the first target
        last, every = np.full(m + 1, 0.0), np.arange(rows)
        last[0] = first[-1]
        one = two = np.zeros(rows)  # scores of the last two diagonals, by row
        for d in range(m + rows - 1):
            low, high = max(0, d - m + 1), min(d, rows - 1) + 1
            r = every[low:high]
            j = d - r  # the target of each row
            left = np.where(j == 0, first[low:high], one[low:high])
            up, pair = np.empty(high - low), np.empty(high - low)
            up[1 if low == 0 else 0 :] = one[max(low - 1, 0) : high - 1]
            pair[1 if low == 0 else 0 :] = two[max(low - 1, 0) : high - 1]
            if low == 0:
                up[0], pair[0] = above[d + 1], above[d]
            if j[-1] == 0 and high > 1:
                pair[-1] = first[high - 2]
            pair += skewed[d, low:high]
            up += GAP
            left = left + GAP
            best = np.maximum(np.maximum(pair, up), left)
            if moves is not None:
                moves[r, j] = np.where(best == pair, 0, np.where(best == up, 1, 2))
            two, one = one, one.copy() if d else np.zeros(rows)
            one[low:high] = best
            if high == rows:
                last[d - rows + 2] = best[-1]
        return last

    above = [np.array([GAP * j for j in range(m + 1)])]
    for at in range(0, n, _BAND):
        above.append(band(at, above[-1]))
    held: dict[int, np.ndarray] = {}

    def move_at(i: int, j: int) -> int:
        k = (i - 1) // _BAND
        if k not in held:
            held.clear()
            held[k] = np.zeros((min(_BAND, n - k * _BAND), m), np.uint8)
            band(k * _BAND, above[k], held[k])
        return int(held[k][i - 1 - k * _BAND, j - 1])

    return _walk(n, m, move_at)


_FINDING = ["check", "category", "severity", "title", "source_excerpt", "target_excerpt"]


def _findings(df: DataFrame, keys: list[str], check: str, severity: str, title: Column, source: Column, target: Column) -> DataFrame:
    return df.select(
        *keys, F.lit(check).alias("check"), F.lit("Coverage").alias("category"), F.lit(severity).alias("severity"),
        title.alias("title"), source.alias("source_excerpt"), target.alias("target_excerpt"),
    )


def structure_findings(blocks: DataFrame, segments: DataFrame | None = None, doc_col: str = "doc_id") -> DataFrame:
    """doc, block_ord and a finding's columns, of blocks (source_text, target_text) and segments (seg_idx, target)."""
    keys = [doc_col, "block_ord"]
    name = F.concat(F.lit("Block "), (F.col("block_ord") + 1).cast("string"))
    src, tgt = X.excerpt(F.coalesce("source_text", F.lit(""))), X.excerpt(F.coalesce("target_text", F.lit("")))
    empty, stunted, marked = (F.lit(f"structure.{c}") for c in ("block_empty", "block_stunted", "translation_missing"))
    # Blocks are read once; whatever a finding shows is worked out only for those found.
    state = blocks.select(*keys, "source_text", "target_text", coverage_state(F.col("source_text"), F.col("target_text")).alias("_state"))
    states = F.when(F.col("_state") == "empty", empty).when(F.col("_state") == "stunted", stunted)
    found = F.array(states, F.when(F.contains("target_text", F.lit(V.NO_TRANSLATION)), marked))
    check = F.col("check")
    title = F.when(check == empty, " has no English").when(check == stunted, " is much shorter than its source").otherwise(" contains an untranslated passage")
    out = state.select(*keys, "source_text", "target_text", F.explode(found).alias("check")).filter("check is not null").select(
        *keys, "check", F.lit("Coverage").alias("category"), F.when(check == stunted, "major").otherwise("critical").alias("severity"),
        F.concat(name, title).alias("title"), src.alias("source_excerpt"), F.when(check == empty, "(empty)").otherwise(tgt).alias("target_excerpt"),
    )
    if segments is None:
        return out
    seg = F.concat(F.lit("Segment "), (F.col("seg_idx") + 1).cast("string"))
    left = segments.withColumn("block_ord", F.lit(None).cast(blocks.schema["block_ord"].dataType))
    residue = left.filter(X.indic_ratio("target") > RESIDUE)
    out = out.unionByName(_findings(residue, keys, "structure.untranslated_residue", "major", F.concat(seg, F.lit(" still contains Gujarati")), F.lit(""), X.excerpt("target")))
    return out.unionByName(_findings(left.filter(echo_only("target")), keys, "structure.echo_only", "critical", F.concat(seg, F.lit(" is not a translation")), F.lit(""), F.col("target")))


def echo_only(target: Column | str) -> Column:
    """Nothing but a number in brackets or a dash."""
    t = X.col(target)
    return t.rlike(java(r"^\s*(?:\[\d+\]|-\s*)?$")) & (X.trimmed(t) != "")


def alignment_findings(aligned: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    lost = aligned.filter(F.size("unmatched_source") > 0).withColumn("block_ord", F.lit(None).cast("int"))
    made = aligned.filter(F.size("unmatched_target") > 0).withColumn("block_ord", F.lit(None).cast("int"))
    n = lambda c, text: F.concat(F.size(c).cast("string"), F.lit(text))
    keys = [doc_col, "block_ord"]
    return _findings(lost, keys, "structure.alignment_mismatch", "major", n("unmatched_source", " source segment(s) have no aligned English"), F.lit(""), F.lit("")).unionByName(
        _findings(made, keys, "structure.hallucinated_segment", "critical", n("unmatched_target", " English segment(s) have no Gujarati source"), F.lit(""), F.lit(""))
    )
