"""A translator that needs no model: facts and terms kept, common words replaced, the rest of the script left out.

It is poor English on purpose and by rule, so that the checks behind it can be
tried without a provider, and with one fault put in where asked.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..rules import offline as R

_WORD = r"(?<![\p{{L}}\p{{M}}]){0}(?![\p{{L}}\p{{M}}])"
#: Marks around the number of what is held back; texts lose them first.
_OPEN, _CLOSE = "\ue000", "\ue001"
_MARK = re.compile(f"{_OPEN}([0-9]+){_CLOSE}")


def _whole_words(words: list[str]) -> regex.Pattern | None:
    """The words as whole ones, longer ones first, in one pattern."""
    ranked = sorted(words, key=lambda w: -len(w))
    return regex.compile(_WORD.format("(?:" + "|".join(map(regex.escape, ranked)) + ")")) if ranked else None


def renderer(terms: dict[str, str]) -> Callable[[str], str]:
    """A function of one segment. terms: source to the head of its target."""
    glossary, common = _whole_words(list(terms)), _whole_words(list(R.COMMON))
    months = re.compile("|".join(sorted(map(re.escape, R.MONTHS), key=lambda m: -len(m))))
    kept = [re.compile(rx, re.ASCII if cased else re.ASCII | re.IGNORECASE) for rx, cased in R.KEPT]

    def render(source: str) -> str:
        held: list[str] = []

        def hold(value: str) -> str:
            held.append(value)
            return f"{_OPEN}{len(held) - 1}{_CLOSE}"

        out = re.sub(f"[{_OPEN}{_CLOSE}]", "", source)
        for i, rx in enumerate(kept):
            out = rx.sub(lambda m, i=i: hold(m[0].strip() if i == 0 else m[0]), out)
        if glossary:
            out = glossary.sub(lambda m: hold(terms[m[0]]), out)
        out = months.sub(lambda m: hold(R.MONTHS[m[0]]), out)
        out = common.sub(lambda m: hold(R.COMMON[m[0]]), out)
        out = re.sub("[઀-૿]+", "", out)
        while _MARK.search(out):  # what was held may hold a mark itself
            out = _MARK.sub(lambda m: held[int(m[1])], out)
        out = re.sub(r"\s{2,}", " ", out).strip()
        end = re.search(r"([।.!?])\s*$", source)
        if not re.search(r"[.!?]$", out):
            out = f"{re.sub('।+$', '', out)} {end[1] if end else '.'}"
        return out[:1].upper() + out[1:]

    return render


def rendered(segments: DataFrame, terms: dict[str, str], source_col: str = "source") -> DataFrame:
    """segments with target, confidence and notes. A null source has an empty target."""
    schema = "target string, confidence double"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        render = renderer(terms)
        for texts in batches:
            targets = [render(t) if t is not None and t.strip() else "" for t in texts]
            share = [_residue(t) for t in targets]
            yield pd.DataFrame({"target": targets, "confidence": [R.LOW_CONFIDENCE if s > R.MUCH_RESIDUE else R.CONFIDENCE for s in share]})

    out = segments.withColumn("_r", run(F.col(source_col)))
    note = F.when(F.col("_r.confidence") < R.CONFIDENCE, F.array(F.lit("Offline renderer left untranslated Gujarati in this segment.")))
    return out.withColumns({
        "target": F.col("_r.target"), "confidence": F.col("_r.confidence"),
        "notes": F.coalesce(note, F.array().cast("array<string>")),
    }).drop("_r")


def _residue(text: str) -> float:
    bare = re.sub(r"\s", "", text)
    return len(re.findall("[઀-૿ऀ-ॿ]", bare)) / len(bare) if bare else 0.0


def with_fault(segments: DataFrame, fault: str, by: str = "doc_id", order: str = "seg_idx") -> DataFrame:
    """Targets with one fault a request (rows alike in by): drop_sentence, change_number, literalize_term or none.

    The sentence that goes is that a third into the request; the first segment has
    its first number raised by one, or the name of a power of attorney put into words.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(by))
    first = F.col("_i") == 0
    number = F.regexp_extract("target", r"(?<![A-Za-z0-9_])([0-9][0-9,]*)(?![A-Za-z0-9_])", 1)
    raised = (F.regexp_replace(number, ",", "").try_cast("long") + 1).cast("string")
    at = F.instr(F.col("target"), number)
    changed = F.concat(F.substr("target", F.lit(1), at - 1), raised, F.substr("target", at + F.length(number)))
    target = {
        "none": F.col("target"),
        "drop_sentence": F.when(F.col("_i") == F.floor(F.col("_n") / 3), F.lit("")).otherwise(F.col("target")),
        "change_number": F.when(first & raised.isNotNull(), changed).otherwise(F.col("target")),
        "literalize_term": F.when(first, F.regexp_replace("target", r"Vakalatnama \([^)]*\)", "power of attorney")).otherwise(F.col("target")),
    }[fault]
    return segments.withColumns({"_i": place, "_n": n}).withColumn("target", target).drop("_i", "_n")


def from_pairs(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Targets out of a table of known pairs (source, reference); what it doesn't have stays empty."""
    known = pairs.select(X.normalize_whitespace("source").alias("_s"), F.col("reference").alias("_t")).groupBy("_s").agg(F.min("_t").alias("_t"))
    out = segments.join(known, X.normalize_whitespace(F.col("source")) == F.col("_s"), "left")
    return out.withColumns({
        "target": F.coalesce("_t", F.lit("")), "confidence": F.when(F.col("_t").isNotNull(), 1.0).otherwise(0.0),
    }).drop("_s", "_t")


def judged_by_pairs(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """segments with faithful and code: DRIFT where the target isn't the known one, null where none is known."""
    known = pairs.select(X.normalize_whitespace("source").alias("_s"), F.col("reference").alias("_t")).groupBy("_s").agg(F.min("_t").alias("_t"))
    out = segments.join(known, X.normalize_whitespace(F.col("source")) == F.col("_s"), "left")
    same = X.normalize_whitespace(F.col("target")) == X.normalize_whitespace(F.col("_t"))
    return out.withColumns({"faithful": F.coalesce(same, F.lit(True)), "code": F.when(~same, "DRIFT")}).drop("_s", "_t")


def answered(requests: DataFrame, provider: Callable[[list[str]], list[str | None]], *, prompt_col: str = "prompt",
             attempts: int = 3, wait: Callable[[int], float] | None = None) -> DataFrame:
    """requests with raw (the provider's reply) and error, a batch of prompts at a time on the executors.

    A provider that fails is asked again, attempts times in all, with wait(n) seconds
    in between (as a rule 0.8 * 2**n, half a minute at most); then the batch's rows
    have an error and no reply, and the rest goes on.
    """
    import time

    pause = wait or (lambda n: min(30.0, 0.8 * 2**n))
    columns = requests.columns
    schema = requests.schema.add("raw", "string").add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw: list[str | None] = [None] * len(batch)
            error: str | None = None
            for n in range(attempts):
                try:
                    raw, error = list(provider(batch[prompt_col].tolist())), None
                    break
                except Exception as failure:  # whatever a provider raises is its failure, and told
                    error = str(failure).split("\n")[0][:160]
                    if n + 1 < attempts:
                        time.sleep(pause(n))
            yield batch[columns].assign(raw=raw, error=error)

    return requests.mapInPandas(run, schema)


def translation_prompt(context: Column, terms: Column, tail: Column, numbered: Column) -> Column:
    """What a translator is asked: sections of the document's context, terms, the text before, and [id] source lines."""
    section = lambda head, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {head}\n"), body))
    return F.concat_ws("\n\n", section("Document context", context), section("Glossary", terms), section("Preceding text", tail), section("Segments", numbered), F.lit("## Output\nJSON only."))


def verifier_prompt(context: Column, languages: Column, pairs: Column) -> Column:
    """What a judge is asked; pairs are an array of judge_pair."""
    return F.concat_ws(
        "\n\n", F.concat(F.lit("## Document context\n"), context), F.concat(F.lit("## Language pair\n"), languages),
        F.lit("## Pairs to audit"), F.array_join(pairs, "\n\n"), F.lit("## Output\nJSON only."),
    )


def within_budget(batches: DataFrame, most_batches: int, doc_col: str = "doc_id") -> DataFrame:
    """Blocks (doc_id, batch) as far as the judge's budget goes: so many batches a document, in order."""
    return batches.filter(F.col("batch") < most_batches)
