"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import re

from ..operators.control import WEIGHTS
from ..rules import doctypes
from ..rules import structure as R
from ..rules import values as V
from .views import BITEXT, SEEDED, TURNS

_GU = r"[\x{0A80}-\x{0AFF}]"
_INDIC = r"[\x{0900}-\x{097F}\x{0A80}-\x{0AFF}]"


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(c: str, rx: str) -> str:
    return f"len(regexp_extract_all({c}, {_s(rx)}))"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


_BLANKLESS = lambda c: f"regexp_replace({c}, '\\s', '', 'g')"
_RATIO = lambda c: f"case when length({_BLANKLESS(c)}) = 0 then 0.0 else {_count(c, _INDIC)} / length({_BLANKLESS(c)}) end"


def _normalized(c: str) -> str:
    for rx, by in ((r"\r\n?", "chr(10)"), (r"[\t\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", "' '"), (" {2,}", "' '"), (r"[ \t]+\n", "chr(10)"), (r"\n{2,}", "chr(10) || chr(10)")):
        c = f"regexp_replace({c}, {_s(rx)}, {by}, 'g')"
    return _trim(c)


_BLANKS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _sentences(c: str) -> str:
    """As text.split_sentences: dots of abbreviations hidden, cut, shown again. A letter after one match may come before the next, so each goes twice."""
    out = f"translate(coalesce({c}, ''), chr(1) || chr(2), '  ')"
    for word in sorted({w for w in V.ABBREVIATIONS if "." in w}, key=lambda w: (-len(w), w)):
        parts = word.split(".")
        rx = "(^|[^\\p{L}\\p{M}])(" + ")\\.(".join(parts) + ")($|[^\\p{L}\\p{M}])"
        by = "'\\1'" + "".join(f" || '\\{i + 2}'" + (" || chr(1)" if i < len(parts) - 1 else "") for i in range(len(parts))) + f" || '\\{len(parts) + 2}'"
        for _ in range(2):
            out = f"regexp_replace({out}, {_s(rx)}, {by}, 'gi')"
    cut = f"regexp_replace(regexp_replace({out}, '([।.!?]){_BLANKS}+', '\\1' || chr(2), 'g'), '\\n+', chr(2), 'g')"
    trimmed = f"regexp_replace(translate(x, chr(1), '.'), '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(2)), lambda x: {trimmed}), lambda x: x <> '')"


# What bitext holds is known: an amount and a date on either side, put wrong by k.
_FACTS = f"""
{BITEXT},
src as (
  select doc_id, block_ord, k, 'currency' as kind, 'રૂ. ' || cast(amount as varchar) as surface, cast(amount as varchar) as normalized, 4 as start from bitext
  union all
  select doc_id, block_ord, k, 'date', strftime(d, '%Y-%m-%d'), strftime(d, '%Y-%m-%d'), 4 + 4 + length(cast(amount as varchar)) + 5 from bitext),
tgt as (
  select doc_id, block_ord, k, 'currency' as kind, 'Rs. ' || shown as surface, replace(shown, ',', '') as normalized, 13 as start from bitext where k <> 4
  union all
  select doc_id, block_ord, k, 'date', strftime(d, '%-d %B %Y'), strftime(d, '%Y-%m-%d'), 13 + 4 + length(shown) + 7 from bitext where k not in (1, 4)
  union all
  select doc_id, block_ord, k, 'number', '77', '77', 13 + 4 + length(shown) + 7 + length(strftime(d, '%-d %B %Y')) + 5 from bitext where k = 3),
finds as (
  select doc_id, block_ord, 'datum.currency_changed' as "check", 'Amounts' as category, 'critical' as severity from bitext where k = 0
  union all select doc_id, block_ord, 'datum.date_missing', 'Dates', 'critical' from bitext where k = 1
  union all select doc_id, block_ord, 'structure.block_empty', 'Coverage', 'critical' from bitext where k = 4)
"""
_SCORES = f"""
{_FACTS},
docs as (
  select doc_id, count(*) as n, count(*) filter (k = 4) as empty, count(*) filter (k in (0, 1)) as wrong, sum(case when k in (1, 3) then 1.0 else 0.5 end) / count(*) as ocr
  from bitext group by doc_id),
parts as (
  select *, greatest(0, 1 - wrong / (2.0 * n)) as di, greatest(0, 1 - 0.5 * empty / n) as term, (n - empty) / n as cov,
    greatest(0, 1 - empty / greatest(4.0, n / 4)) as sem, wrong + 2 * empty as crit from docs),
scored as (select *, 0.0 + di * 0.3 + term * 0.2 + cov * 0.15 + sem * 0.3 + ocr * 0.05 as total from parts),
graded as (select *, case when crit > 0 or total < 0.7 then 'red' when empty = 0 and total >= 0.9 then 'green' else 'yellow' end as grade from scored)
"""

_KEEP = "select doc_id, block_ord,"


def _doc_type() -> str:
    scores = []
    for name, weight, patterns in doctypes.RULES:
        parts = []
        for rx, f in patterns:
            n = _count("t", ("(?i)" if f else "") + rx)
            parts.append(f"(case when {n} > 0 then {weight} * (1 + log2(1 + {n}) / 4) else 0 end)")
        scores.append(f"select doc_id, {_s(name)} as name, {len(scores)} as rank, {' + '.join(parts)} as score from marked")
    words = "['affidavit', 'Whereas', 'FIR No. 12', 'sale deed', 'Circular', 'writ petition', 'It is ordered', '']"
    return f"""
with marked as (select doc_id, {words}[1 + doc_id % 8] || ' ' || text as t from documents),
s as ({' union all '.join(scores)}),
r as (select *, row_number() over (partition by doc_id order by score desc, rank) as place from s),
p as (select doc_id, max(name) filter (place = 1) as name, max(score) filter (place = 1) as top, max(score) filter (place = 2) as second from r group by doc_id),
m as (select *, case when second > 0 then (top - second) / top else 1.0 end as margin from p)
select doc_id, case when top = 0 or (margin < 0.18 and top < 6) then 'other_legal' else name end as type,
  case when top = 0 then 0.0 when margin < 0.18 and top < 6 then round(least(0.5, top / 12), 3) else round(least(0.98, 0.55 + margin * 0.4), 3) end as confidence,
  round(cast(top as double), 6) as top_score from m
"""


def _line_kind() -> str:
    hit = lambda rx, i=False: f"regexp_matches(line, {_s(('(?i)' if i else '') + rx)})"
    label = f"regexp_extract(line, {_s('(?i)' + R.CLAUSE)}, 1)"
    cases = [(f"{hit(R.FOOTER, True)} and n < 100", "'footer'")]
    cases += [(f"{hit(rx, i)} and n < 200", _s(kind)) for kind, rx, i in R.HEADINGS]
    cases += [
        (f"{hit(R.CASE_NUMBER, True)} and n < 90", "'case_number'"), (f"{hit(R.SEAL, True)} and n < 80", "'seal_note'"),
        (f"{hit(R.SIGNATURE, True)} and n < 200", "'signature_block'"), (f"{hit(R.CITATION)} and n < mean * 0.8 and n < 160", "'citation'"),
        (f"{label} <> ''", f"case when contains({label}, '.') then 'sub_clause' else 'clause' end"),
        (f"{hit(R.LIST_ITEM)} and n < mean * 1.5", "'list_item'"), (f"{hit(R.QUOTE)} and n < 400", "'quotation'"),
    ]
    when = " ".join(f"when {c} then {v}" for c, v in cases)
    return f"""
with l as (select doc_id, {_trim('x')} as line from (select doc_id, unnest(regexp_split_to_array(text, '\\n+')) as x from documents)),
m as (select *, length(line) as n, avg(length(line)) over (partition by doc_id) as mean from l where line <> '')
select doc_id, case {when} else 'body' end as kind, count(*) as n from m group by 1, 2
"""


def _translit() -> str:
    c = "regexp_replace(lower(p_name), '[^a-z]', '', 'g')"
    for rx, by in (("ph", "f"), ("sh", "s"), ("chh?", "c"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("j+h", "z")):
        c = f"regexp_replace({c}, '{rx}', '{by}', 'g')"
    for x in "abcdefghijklmnopqrstuvwxyz":
        c = f"regexp_replace({c}, '{x}+', '{x}', 'g')"
    return f"select p_partkey, {c} as key from part"


def _legacy() -> str:
    signs = [(n, re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", rx)) for n, rx in V.LEGACY_SIGNS]
    counts = ", ".join(f"{_count('s', rx)} as c{i}" for i, (_, rx) in enumerate(signs))
    hits = " + ".join(f"(case when c{i} >= 3 then c{i} else 0 end)" for i in range(len(signs)))
    names = ", ".join(f"case when c{i} >= 3 then {_s(n)} end" for i, (n, _) in enumerate(signs))
    return f"""
with s as (select doc_id, text as whole, substr(text, 1, 20000) as s from documents),
c as (select *, {counts} from s),
h as (select *, ({hits}) / greatest(1.0, length(s) / 100) as density, concat_ws(',', {names}) as candidates from c),
legacy as (select *, candidates <> '' and density > 0.5 as suspected from h)
"""


_SEEDED = ", ".join(
    f"({_s(s)}, {_s(t.split(' (')[0])}, {_s(c)}, {str(p).lower()}, {_s(a[0] if a else '')}, {str(' (' in t).lower()})" for s, t, c, p, a, _ in SEEDED
)
_TERMS = f"terms(key, head, category, preserve, alternative, glossed) as (values {_SEEDED})"
_TOKENS = r"regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{M}}]+')"
_PLAN = f"""
{TURNS}, {_TERMS},
tok as (select doc_id, block_ord, unnest({_TOKENS.format(c='source_text')}) as w from turns),
scan as (select doc_id, block_ord, key, category, count(*) as n from tok join terms on w = key group by all),
plan as (select doc_id, key, sum(n) as cnt, min(block_ord) as first_use_block from scan group by all)
"""
_HAS = lambda c, p: f"contains(lower({c}), lower({p}))"
_PAIRS = f"""
{_PLAN},
pairs as (select t.*, p.key, head, preserve, alternative, list_contains({_TOKENS.format(c='source_text')}, p.key) as used
  from turns t join plan p on t.doc_id = p.doc_id join terms on terms.key = p.key)
"""

_ASSESSED = rf"""with {BITEXT}, t as (select *, regexp_extract_all(source_text, '[0-9][0-9,]*(?:\.[0-9]+)?') as src, regexp_extract_all(target_text, '[0-9][0-9,]*(?:\.[0-9]+)?') as tgt,
  regexp_replace(target_text, '[^0-9]', '', 'g') as digits from bitext),
f as (select doc_id, block_ord as seg_idx, target_text = '' as empty,
  len([x for x in src if length(replace(x, ',', '')) >= 2 and not contains(digits, replace(x, ',', ''))]) > 0 as lost,
  len([x for x in tgt if length(replace(x, ',', '')) >= 4 and not list_contains(src, replace(x, ',', ''))]) > 0 as made from t)
select doc_id, seg_idx, cast(case when empty then {WEIGHTS['empty']} else (case when made then 6 else 0 end) + (case when lost then 6 else 0 end) end as int) as weight,
  case when empty then 'empty' else concat_ws(',', case when made then 'foreign_numbers' end, case when lost then 'lost_numbers' end) end as reasons from f"""

SQL = {
    "datum_extract": f"""with {_FACTS}
select doc_id, block_ord, 's' as origin, kind, surface, normalized, cast(start as int) as start, 'critical' as severity from src
union all select doc_id, block_ord, 't', kind, surface, case when kind = 'number' then '77' else normalized end, cast(start as int), case when kind = 'number' then 'major' else 'critical' end from tgt""",
    "datum_match": f"""with {_FACTS}
select doc_id, block_ord, kind, normalized, case when k = 4 then 'silent' when kind = 'currency' and k = 0 then 'changed'
  when kind = 'date' and k = 1 then 'missing' else 'agreed' end as status from src""",
    "datum_findings": f"with {_FACTS} select doc_id, block_ord, \"check\", category, severity from finds",
    "findings_by_severity": f"with {_FACTS} select severity, count(*) as n from finds group by 1",
    "top_critical_categories": f"with {_FACTS} select category, count(*) as n from finds where severity = 'critical' group by 1 order by n desc, category limit 3",
    "must_judge": f"with {_FACTS} select distinct doc_id, block_ord from finds",
    "fidelity_score": f"""with {_SCORES}
select doc_id, round(cast(di as double), 3) as datum_integrity, round(cast(term as double), 3) as terminology, round(cast(cov as double), 3) as coverage_score,
  round(cast(sem as double), 3) as semantic, round(cast(ocr as double), 3) as ocr_confidence, round(cast(total as double), 3) as total, grade, crit = 0 and empty = 0 as certified_ready from graded""",
    "score_gate": f"""with {_SCORES}
select doc_id, grade, concat_ws('; ', case when crit > 0 then crit || ' critical finding(s)' end, case when empty > 0 then empty || ' block(s) without English' end) as reasons from graded""",
    "mechanical_checks": f"""with {_SCORES}, c as (select doc_id, unnest([
  {{'check': 'Script and encoding preflight', 'count': cast(0 as bigint), 'passed': true}},
  {{'check': 'Data extraction and comparison', 'count': 2 * n, 'passed': wrong = 0}},
  {{'check': 'Terminology compliance', 'count': n, 'passed': empty = 0}},
  {{'check': 'Segment coverage', 'count': n, 'passed': empty = 0}},
  {{'check': 'Sentence-level alignment', 'count': n, 'passed': true}},
  {{'check': 'Untranslated residue', 'count': cast(0 as bigint), 'passed': true}},
  {{'check': 'Semantic faithfulness review', 'count': n, 'passed': empty = 0}}]) as c from graded)
select doc_id, c."check" as "check", c.count as "count", c.passed as passed from c""",
    "section_assignment": f"with {BITEXT} select doc_id, cast(18 as int) as section, cast(count(*) as int) as n from bitext where k = 4 group by 1",
    "judge_escalation": f"""with {_FACTS}
select doc_id, block_ord, k in (0, 1, 4) as priority from bitext where k = 4 or block_ord % 2 = 1 or k in (0, 1)""",
    "judge_coverage": f"""with {BITEXT}, j as (select doc_id, count(*) as blocks_total, count(*) filter (block_ord % 3 <> 0) as blocks_judged,
  count(*) filter (block_ord % 3 <> 0 and k = 4) = 0 as faithful from bitext group by 1)
select *, blocks_judged > 0 as available, blocks_judged = blocks_total as complete from j""",
    "date_normalize": """with s as (select distinct l_shipdate as d from lineitem), r as (select d, '%d/%m/%Y' as f, strftime(d, '%d/%m/%Y') as raw from s
  union all select d, '%Y.%m.%d', strftime(d, '%Y.%m.%d') from s union all select d, '%-d %B %Y', strftime(d, '%-d %B %Y') from s
  union all select d, '%B %-d, %Y', strftime(d, '%B %-d, %Y') from s)
select distinct raw, case when f = '%d/%m/%Y' and day(d) <= 12
  then 'AMBIG:' || year(d) || '-' || lpad(cast(day(d) as varchar), 2, '0') || '-' || lpad(cast(month(d) as varchar), 2, '0') || '|' || strftime(d, '%Y-%m-%d')
  when f in ('%-d %B %Y', '%B %-d, %Y') and day(d) = month(d) then year(d) || '-' || lpad(cast(month(d) as varchar), 2, '0') || '-' || lpad(cast(day(d) as varchar), 2, '0')
  else strftime(d, '%Y-%m-%d') end as normalized from r""",
    "institution_match": """select s_suppkey, ['court:district', 'court:high', 'bank:', 'police:', null][1 + s_suppkey % 5] as institution from supplier""",
    "to_ascii_digits": """select l_orderkey, l_linenumber, translate(cast(cast(floor(l_extendedprice) as bigint) as varchar), '0123456789', '૦૧૨૩૪૫૬૭૮૯') as gujarati,
  cast(cast(floor(l_extendedprice) as bigint) as varchar) as ascii from lineitem""",
    "script_profile": f"""with {BITEXT}, b as (select doc_id, block_ord, {_BLANKLESS('source_text')} as s from bitext),
c as (select *, {_count('s', _GU)} as gu, {_count('s', '[A-Za-z0-9]')} as la, greatest(length(s), 1) as n from b)
select doc_id, block_ord, 'gujarati' as script, round(gu / n, 6) as gujarati_ratio, round(la / n, 6) as latin_ratio, round((length(s) - gu - la) / n, 6) as other_ratio from c""",
    "indic_ratio": f"with {BITEXT} {_KEEP} round({_RATIO('source_text')}, 6) as ratio from bitext",
    "estimate_tokens": f"select doc_id, cast(case when text is null or text = '' then 0 else ceil({_count('text', _GU)} / 2.2 + (length(text) - {_count('text', _GU)}) / 4.0) end as bigint) as tokens from documents",
    "stream_ingest": f"select doc_id, cast(case when text is null or text = '' then 0 else ceil({_count('text', _GU)} / 2.2 + (length(text) - {_count('text', _GU)}) / 4.0) end as bigint) as tokens from documents",
    "legacy_encoding": f"{_legacy()} select doc_id, suspected, candidates, round(case when suspected then least(1.0, density / 4) else 0.0 end, 6) as confidence from legacy",
    "preflight": f"""{_legacy()}, p as (select doc_id, suspected, regexp_matches(whole, '[A-Za-z]') as latin from legacy)
select doc_id, concat_ws(',', case when suspected then 'legacy_encoding' end, 'not_indic') as warnings, not suspected as ok, case when latin then 'latin' else 'unknown' end as script from p""",
    "normalize_whitespace": f"select doc_id, md5({_normalized('text')}) as digest, md5({_trim('regexp_replace(regexp_replace(' + _normalized('text') + r", '\s*\n\s*', ' ', 'g'), ' {2,}', ' ', 'g')")}) as flat_digest from documents",
    "translit_key": _translit(),
    "levenshtein_sim": """select n_name, r_name, round(1 - levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)), 6) as similarity,
  cast(least(levenshtein(n_name, r_name), 6) as int) as bounded from nation join region on n_regionkey = r_regionkey""",
    "indian_group": f"with {BITEXT}, g as (select l_orderkey, l_linenumber, cast(cast(floor(l_extendedprice) as bigint) as varchar) as a from lineitem), h as (select *, length(a) as n from g) select l_orderkey, l_linenumber, case when n <= 3 then a when n <= 5 then a[1:n-3] || ',' || a[n-2:n] else a[1:n-5] || ',' || a[n-4:n-3] || ',' || a[n-2:n] end as grouped from h",
    "lost_numbers": rf"""with {BITEXT}, t as (select *, regexp_extract_all(source_text, '[0-9][0-9,]*(?:\.[0-9]+)?') as src, regexp_replace(target_text, '[^0-9]', '', 'g') as digits from bitext)
{_KEEP} array_to_string(list_sort(list_distinct([x for x in src if length(regexp_replace(x, '[.,]', '', 'g')) >= 2 and not contains(digits, regexp_replace(x, '[.,]', '', 'g'))]))[1:4], ',') as lost from t""",
    "foreign_numbers": rf"""with {BITEXT}, t as (select *, regexp_extract_all(source_text, '[0-9][0-9,]*(?:\.[0-9]+)?') as src, regexp_extract_all(target_text, '[0-9][0-9,]*(?:\.[0-9]+)?') as tgt from bitext)
{_KEEP} array_to_string([replace(x, ',', '') for x in tgt if length(replace(x, ',', '')) >= 4 and not list_contains(src, replace(x, ',', ''))][1:3], ',') as foreign_numbers from t""",
    "last_resort": rf"""with {BITEXT} {_KEEP} {_s(V.NO_TRANSLATION)} as from_source,
  {_trim(rf"regexp_replace(regexp_replace(source_text, '{_INDIC}+', ' ', 'g'), '\s+', ' ', 'g')")} || {_s(V.ILLEGIBLE_SUFFIX)} as stripped from bitext""",
    "title_facts": f"""with {BITEXT} select doc_id, 'Rs. ' || max(amount) || '/-' as consideration, 'Individual (as recorded in the source)' as constitution, '' as deed_no, '' as deed_date, '' as stamp_duty from bitext group by 1""",
    "looks_transliterated": f"""with w as (select doc_id, regexp_extract_all(lower(text), '[a-z]{{2,}}') as w from documents)
select doc_id, len(w) >= 12 and len([x for x in w if list_contains([{', '.join(map(_s, V.FUNCTION_WORDS))}], x)]) / greatest(len(w), 1) < 0.08 as transliterated from w""",
    "html_paragraphs": rf"""with t as (select page_id, unnest(regexp_split_to_array(html, '(?i)</?(?:p|h[1-6]|tr|table|br|li|ol|ul)\b[^>]*>')) as x, generate_subscripts(regexp_split_to_array(html, '(?i)</?(?:p|h[1-6]|tr|table|br|li|ol|ul)\b[^>]*>'), 1) as pos from pages),
e as (select page_id, pos, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '(?i)</(?:td|th)\s*>', ' ', 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') as x from t),
n as (select page_id, pos, {_normalized('x')} as x from e)
select page_id, count(*) as n, md5(string_agg(x, chr(10) order by pos)) as digest from n where x <> '' group by 1""",
    "line_classify": _line_kind(),
    "doc_type": _doc_type(),
    "footer_filter": "select l_orderkey, count(*) as n from lineitem where l_linenumber % 2 = 1 group by 1",
    "page_confidence": "select l_orderkey as doc_id, l_linenumber % 3 as page_no, min(l_discount) as confidence from lineitem group by 1, 2",
    "page_ranges": """with p as (select distinct l_orderkey as doc_id, l_linenumber as p from lineitem where l_discount < 0.07),
i as (select *, p - row_number() over (partition by doc_id order by p) as island from p),
r as (select doc_id, min(p) as a, max(p) as b from i group by doc_id, island)
select doc_id, string_agg(case when a = b then cast(a as varchar) else a || '–' || b end, ', ' order by a) as ranges from r group by 1""",
    "letterhead": """select p_partkey as doc_id, 'TITLE REPORT' as title, p_brand || ' Bank Limited' as company, cast(1 as int) as n_letterhead, cast(3 as int) as n_addressee, cast(5 as int) as body_start from part""",
    "segment_index": f"""with {BITEXT} select doc_id, cast(row_number() over (partition by doc_id order by block_ord) - 1 as int) as seg_idx, block_ord, source_text as source, false as passthrough from bitext""",
    "chunk_pack": f"""with recursive {BITEXT.split("li as")[0]} o as (select l_orderkey as doc_id, block_ord as seg_idx, cast(l_quantity as bigint) as tokens, block_ord + 1 as rn from numbered),
c as (select doc_id, seg_idx, tokens, rn, 0 as chunk_id, tokens as total, 1 as n from o where rn = 1
  union all
  select o.doc_id, o.seg_idx, o.tokens, o.rn, case when c.total + o.tokens > 60 or c.n >= 3 then c.chunk_id + 1 else c.chunk_id end,
    case when c.total + o.tokens > 60 or c.n >= 3 then o.tokens else c.total + o.tokens end, case when c.total + o.tokens > 60 or c.n >= 3 then 1 else c.n + 1 end
  from c join o on o.doc_id = c.doc_id and o.rn = c.rn + 1)
select doc_id, seg_idx, tokens, cast(chunk_id as int) as chunk_id from c""",
    "context_carry": f"""with {BITEXT}, c as (select doc_id, cast(block_ord // 2 as int) as chunk_id, arg_max(source_text, block_ord) as tail from bitext group by 1, 2)
select doc_id, chunk_id, coalesce(lag(tail) over (partition by doc_id order by chunk_id), '') as context from c""",
    "omission_anti_join": f"with {BITEXT} select doc_id, block_ord as seg_idx, {_s(V.NO_TRANSLATION)} as target from bitext where target_text = ''",
    "block_targets": f"""with {BITEXT}, b as (select doc_id, cast(block_ord // 2 as int) as block_id, coalesce(string_agg(target_text, ' ' order by block_ord) filter (target_text <> ''), '') as target from bitext group by 1, 2)
select *, case when target = '' then 'failed' else 'ai' end as state from b""",
    "coverage": f"""with {TURNS}, l as (select doc_id, length(source_text) as s, length({_normalized("target_text")}) as t from turns)
select doc_id, count(*) as n_blocks, count(*) filter (t > 0) as n_translated, count(*) filter (t = 0) as n_empty,
  count(*) filter (t > 0 and t < greatest(8, floor(s * 0.45 + 0.5)) and t < s) as n_stunted, round(count(*) filter (t > 0) / count(*), 6) as ratio from l group by 1""",
    "residue": f"""with {BITEXT}, m as (select doc_id, block_ord, case when block_ord % 3 = 0 then target_text || ' ' || substr(source_text, 1, 7) else target_text end as t from bitext)
select doc_id, block_ord from m where {_RATIO('t')} > 0.08""",
    "echo_only": "select l_orderkey, l_linenumber, ['[12]', ' - ', 'text', '-', '[x]'][1 + l_linenumber % 5] as t from lineitem where l_linenumber % 5 in (0, 1, 3)",
    "term_scan": f"""with {_TERMS}, tok as (select doc_id, unnest({_TOKENS.format(c='text')}) as w from documents)
select doc_id, key, category, count(*) as n from tok join terms on w = key group by all""",
    "split_sentences": f"""with s as (select doc_id, unnest({_sentences('text')}) as x from documents)
select doc_id, count(*) as n, cast(sum(length(x)) as bigint) as n_chars from s group by 1""",
    "alignment": f"""with {TURNS},
s as (select doc_id || '-' || block_ord as id, {_sentences('source_text')} as s, {_sentences('target_text')} as t from turns),
words as (
  select id, len(s) as n, len(t) as m,
    list_transform(s, lambda x: list_distinct(list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda w: length(w) > 2))) as a,
    list_transform(t, lambda x: list_distinct(list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda w: length(w) > 2))) as b from s),
likes as (
  select id, n, m, list_transform(a, lambda x: list_transform(b, lambda y:
    case when len(x) = 0 or len(y) = 0 then 0.0::double else len(list_intersect(x, y))::double / least(len(x), len(y)) end)) as likes from words where n <> m and n > 0 and m > 0),
rows as (
  with recursive nw(id, i, best) as (
    select id, 0, list_transform(range(0, m + 1), lambda j: {{'s': -0.35::double * j, 'c': 0::bigint}}) from likes
    union all
    select nw.id, nw.i + 1, list_reduce(
      list_prepend([{{'s': -0.35::double * (nw.i + 1), 'c': 0::bigint}}], list_transform(range(1, l.m + 1), lambda j: [{{'s': 0::double, 'c': j::bigint}}])),
      lambda done, x: list_append(done, case
        when nw.best[x[1].c].s + l.likes[nw.i + 1][x[1].c] >= greatest(nw.best[x[1].c + 1].s - 0.35::double, done[x[1].c].s - 0.35::double)
          then {{'s': nw.best[x[1].c].s + l.likes[nw.i + 1][x[1].c], 'c': nw.best[x[1].c].c + 1}}
        when nw.best[x[1].c + 1].s - 0.35::double >= done[x[1].c].s - 0.35::double then {{'s': nw.best[x[1].c + 1].s - 0.35::double, 'c': nw.best[x[1].c + 1].c}}
        else {{'s': done[x[1].c].s - 0.35::double, 'c': done[x[1].c].c}} end))
    from nw join likes l on nw.id = l.id where nw.i < l.n)
  select nw.id, nw.best[-1].c as n_pairs from nw join likes l on nw.id = l.id and nw.i = l.n)
select w.id, case when n = m then 'positional' else 'resegmented' end as method, n = m as exact,
  cast(case when n = m then n else coalesce(r.n_pairs, 0) end as int) as n_pairs
from words w left join rows r on w.id = r.id""",
    "term_dictionary": r"""with w as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{M}]+')) as w from documents),
known as (select w from w where length(w) >= 4 group by 1 having count(*) >= 2),
one as (select doc_id, w, count(*) as n from w where w in (from known) group by all)
select doc_id, 'c' || length(w) % 3 as category, count(*) as n_terms, cast(sum(n) as bigint) as n_hits from one group by all""",
    "term_plan": f"with {_PLAN} select doc_id, plan.key, head, cast(cnt as bigint) as cnt, first_use_block, glossed from plan join terms on terms.key = plan.key",
    "terms_by_category": f"with {_PLAN} select category, cast(sum(n) as bigint) as n from scan group by 1",
    "term_compliance": f"""with {_PAIRS}, v as (select doc_id, block_ord, key, {_HAS('target_text', 'head')} as has_head, alternative <> '' and {_HAS('target_text', 'alternative')} as has_alt, preserve,
  key = 'the' and ({_HAS('target_text', "'definite article'")}) as literal from pairs where used)
select doc_id, block_ord, key, case when has_alt then 'inconsistent_target' when literal then 'literal_translation' else 'not_present' end as kind, case when has_alt then 'minor' else 'major' end as severity
from v where not has_head and not (preserve and has_alt)""",
    "term_consistency": f"""with {_PAIRS}, r as (
  select doc_id, key, head as rendering from pairs where used and {_HAS('target_text', 'head')}
  union select doc_id, key, string_split(alternative, ' (')[1] from pairs where used and alternative <> '' and {_HAS('target_text', "string_split(alternative, ' (')[1]")})
select doc_id, key, string_agg(rendering, '|' order by rendering) as renderings from r group by 1, 2 having count(*) > 1""",
    "glossary_density": rf"""with {_TERMS}, w as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+')) as w from documents),
c as (select doc_id, count(*) as n_words, count(key) as n_hits from w left join terms on w = key where w <> '' group by 1)
select *, round(1000 * n_hits / n_words, 6) as per_thousand from c""",
    "assess_target": _ASSESSED,
    "repair_queue": f"""with a as ({_ASSESSED}), q as (select *, row_number() over (partition by doc_id order by weight desc, seg_idx) as place from a where weight > 0)
select doc_id, seg_idx, weight, cast(place as int) as place, cast((place - 1) // 8 as int) as batch from q where place <= 2""",
    "stub_judge": f"""with {TURNS}, l as (select doc_id, block_ord, length({_trim('source_text')}) as s, length({_trim('target_text')}) as t from turns),
i as (select *, case when t = 0 then 'OMISSION:critical' when s > 0 and t / s < 0.35 then 'OMISSION:major' when s > 0 and t / s > 2.6 then 'ADDITION:minor' else '' end as issues from l)
select doc_id, block_ord, issues in ('', 'ADDITION:minor') as faithful, issues from i""",
    "latest_job": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1",
    "queue_health": """select count(*) filter (event_id % 4 = 0) as running, count(*) filter (event_id % 4 = 1) as queued,
  count(*) filter (event_id % 4 = 2 and ts >= timestamp '2024-01-04 00:00:00') as failed_recently from events""",
    "stage_durations": """select event_id, cast(floor((epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / 1000) as bigint) as duration_ms from events""",
}
