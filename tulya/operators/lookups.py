"""Small fixed tables as Columns: statutes, law-report abbreviations, document types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import statutes as R
from ..rules.values import SCALES


def _table(rows: list[tuple[str, Column]]) -> Column:
    return F.create_map(*(x for key, value in rows for x in (F.lit(key), value)))


def statute(token: Column) -> Column:
    """struct(old_token, old_act, new_token, new_act, note) of an abbreviation, null if unknown.

    Case and dots don't count; an ``ACT`` at the end does only if the rest is no
    abbreviation without it. The blank in ``NI Act`` counts.
    """
    names = ("old_token", "old_act", "new_token", "new_act", "note")
    table = _table([(r[0].upper(), F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, r, strict=True)))) for r in R.STATUTES])
    key = F.replace(F.upper(token), F.lit("."), F.lit(""))
    return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, F.regexp_replace(key, "ACT$", "")))


def court_abbreviation(token: Column) -> Column:
    return F.try_element_at(_table([(k, F.lit(v)) for k, v in R.COURT_ABBREVIATIONS.items()]), token)


def doc_type_label(kind: Column) -> Column:
    """The label of a document type; itself if it is not listed."""
    return F.coalesce(F.try_element_at(_table([(r[0], F.lit(r[1])) for r in R.DOC_TYPES]), kind), kind)


def doc_type_register(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_table([(r[0], F.lit(r[4])) for r in R.DOC_TYPES]), kind), F.lit(R.REGISTER))


def described(docs: DataFrame, type_col: str = "type") -> DataFrame:
    """docs with label, short, description and register of their type."""
    names = ("label", "short", "description", "register")
    table = _table([(r[0], F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r[1:], strict=True)))) for r in R.DOC_TYPES])
    meta = F.try_element_at(table, F.col(type_col))
    return docs.withColumns({
        "label": doc_type_label(F.col(type_col)), "short": meta["short"], "description": meta["description"],
        "register": doc_type_register(F.col(type_col)),
    })


def effective_type(declared: Column, detected: Column) -> Column:
    """What a document is taken for: as declared, else as detected, else other_legal."""
    return F.coalesce(declared, detected, F.lit("other_legal"))


def company_name(override: Column, detected: Column) -> Column:
    """The company a report is addressed to: what was given, if that isn't blank, else what was found."""
    return F.coalesce(F.when(F.trim(override) != "", F.trim(override)), F.when(F.trim(detected) != "", F.trim(detected)))


def scale_value(word: Column) -> Column:
    """The number that a scale word (lakh, crore and so on) stands for; null if it is none."""
    return F.try_element_at(_table([(k, F.lit(v).cast("long")) for k, v in SCALES.items()]), F.lower(word))
