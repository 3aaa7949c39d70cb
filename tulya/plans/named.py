"""Queries over texts with names on either side, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import datums, replies
from ..operators.english import ILLEGIBLE, normalize_target
from ..rules import values as V
from .views import BITEXT, numbered, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _people(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source_text, target_text: four parts' names as people, one of whom is left out, two spelt otherwise, one named anew."""
    p = table(spark, d, "part").select("p_partkey", F.initcap("p_name").alias("name"), F.floor(F.col("p_partkey") / 4).alias("doc_id"))
    k = F.col("p_partkey") % 7
    cut = F.concat(F.substring("name", 1, 1), F.substr("name", F.lit(3)))
    shown = F.when(k == 1, cut).when(k == 2, F.lit(None)).when(k == 3, F.concat("name", F.lit("ia"))).when(k == 5, F.reverse(F.split("name", " "))[0]).otherwise(F.col("name"))
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", c.alias("x")))), lambda s: s["x"])
    told = lambda c, honor: F.array_join(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.concat(F.lit(honor), x)), " and ")
    by_doc = p.withColumn("shown", shown).groupBy("doc_id").agg(order(F.col("name")).alias("s"), order(F.col("shown")).alias("t"))
    return by_doc.select("doc_id", F.lit(0).alias("block_ord"), told(F.col("s"), "Shri ").alias("source_text"), told(F.reverse("t"), "Mr. ").alias("target_text"))


def names_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Every person of a source with the first free person of the target whose name is near."""
    keys = ["doc_id", "block_ord"]
    b = _people(spark, d)
    source, target = (datums.extract_datums(b, f"{side}_text", side[0], keys) for side in ("source", "target"))
    matched = datums.match_datums(source, target, b.select(*keys, (F.col("target_text") == "").alias("target_blank")), keys)
    nth = F.row_number().over(Window.partitionBy("doc_id", "side").orderBy("ord"))
    return matched.withColumn("nth", nth).select("doc_id", "side", "nth", "surface", "status", "note", "other")


def _key(c: str, latin: bool = False) -> str:
    """As text.name_key, or text.latin_key, which drops blanks after letters have been folded."""
    out = f"lower({c})" if latin else f"regexp_replace(lower({c}), '[^a-z]', '', 'g')"
    for rx, by in V.DIGRAPHS:
        if rx.startswith("("):  # a letter repeated, one letter after the other
            by_one = [(f"{c}{c}+", c) for c in "abcdefghijklmnopqrstuvwxyz"]
        else:
            by_one = [(x, x[0]) for x in rx.split("|")] if rx.startswith("aa") else [(rx, by)]
        for one, new in by_one:
            out = f"regexp_replace({out}, '{one}', '{new}', 'g')"
    return out


QUERIES["names_in_order"] = names_in_order
SQL["names_in_order"] = rf"""with p as (
  select p_partkey, p_partkey // 4 as doc_id, p_partkey % 7 as k,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as name from part),
told as (
  select doc_id, 's' as side, p_partkey as place, name as surface from p
  union all
  select doc_id, 't', -p_partkey, case k when 1 then name[1:1] || name[3:] when 3 then name || 'ia' when 5 then string_split(name, ' ')[-1] else name end from p where k <> 2),
keyed as (select *, {_key('surface')} as key, {_key('surface', True)} as latin from told),
once as (
  select *, row_number() over (partition by doc_id, side order by place) as nth from (
    select *, row_number() over (partition by doc_id, side, key order by place) as copy from keyed)
  where copy = 1),
fits as (
  select s.doc_id, s.nth as s, list({{'t': t.nth, 'close': 1 - levenshtein(s.key, t.latin) / greatest(length(s.key), length(t.latin)), 'surface': t.surface}} order by t.nth) as fits
  from once s join once t on s.doc_id = t.doc_id and s.side = 's' and t.side = 't'
  where 1 - levenshtein(s.key, t.latin) / greatest(length(s.key), length(t.latin)) >= 0.85 group by 1, 2),
walk as (
  with recursive w(doc_id, step, used, fit) as (
    select doc_id, cast(0 as bigint), cast([] as bigint[]), null::struct(t bigint, close double, surface varchar) from once group by doc_id
    union all
    select doc_id, step + 1, case when fit.t is null then used else list_append(used, fit.t) end, fit from (
      select w.doc_id, w.step, w.used, list_filter(f.fits, lambda x: not list_contains(w.used, x.t))[1] as fit
      from w join once s on s.doc_id = w.doc_id and s.side = 's' and s.nth = w.step + 1
      left join fits f on f.doc_id = w.doc_id and f.s = w.step + 1))
  select * from w),
blank as (select doc_id from once group by 1 having count(*) filter (side = 't') = 0)
select o.doc_id, o.side, o.nth, o.surface,
  case when w.fit.t is not null then 'agreed' when b.doc_id is not null then 'silent' else 'missing' end as status,
  case when w.fit.close < 0.9 then 'spelling' end as note, w.fit.surface as other
from once o join walk w on o.doc_id = w.doc_id and w.step = o.nth left join blank b on o.doc_id = b.doc_id where o.side = 's'
union all
select o.doc_id, o.side, o.nth, o.surface, case when w.doc_id is not null then 'agreed' else 'extra' end, null, null
from once o left join walk w on o.doc_id = w.doc_id and w.fit.t = o.nth where o.side = 't'"""


# Every kind of fact, in texts made of a part's own values


def _planted(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumns({"size": F.col("p_size").cast("string"), "price": F.floor("p_retailprice").cast("long").cast("string"), "name": F.initcap("p_name")})
    text = [
        F.concat(F.lit("paid "), "price", F.lit("/- in full")), F.concat(F.lit("a rate of "), "size", F.lit("% only")),
        F.concat(F.lit("see CR No. "), "size", F.lit("/2019 here")), F.concat(F.lit("under IPC, 19"), F.lpad("size", 2, "0"), F.lit(" as said")),
        F.concat(F.lit("by Section "), "size", F.lit(" (2) now")), F.concat(F.lit("at "), F.lpad((F.col("p_size") % 24).cast("string"), 2, "0"), F.lit(":30 hrs sharp")),
        F.concat(F.lit("Pin 38"), F.lpad("size", 4, "0"), F.lit(" there")), F.concat(F.lit("met Shri "), "name", F.lit(", today")),
        F.concat(F.lit("for the accused - "), "name"), F.concat("name", F.lit(" Bank")),
        F.concat(F.lit("with "), F.when(F.col("p_size") % 2 == 0, "seven").otherwise("hundred"), F.lit(" others")), F.concat(F.lit("sum ૧૨,"), F.lpad("size", 3, "0")),
    ]
    out = F.lit(None).cast("string")
    for k, t in enumerate(text):
        out = F.when(F.col("p_partkey") % len(text) == k, t).otherwise(out)
    return p.select(F.col("p_partkey").alias("doc_id"), out.alias("text"))


def fact_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What is found in texts that each hold one kind of fact, the rarer ones among them."""
    return datums.extract_datums(_planted(spark, d), "text", "s", ["doc_id"]).select("doc_id", "kind", "surface", "normalized", "start", "severity", "role")


_LATIN = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"
QUERIES["fact_kinds"] = fact_kinds
SQL["fact_kinds"] = f"""with p as (
  select p_partkey as doc_id, p_partkey % 12 as k, p_size as n, cast(p_size as varchar) as size, cast(cast(floor(p_retailprice) as bigint) as varchar) as price,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as name from part),
f as (
  select doc_id, case k
    when 0 then ('currency', price || '/-', price, 5, 'critical', null)
    when 1 then ('percentage', size || '%', size, 10, 'critical', null)
    when 2 then ('case_number', 'CR No. ' || size || '/2019', 'CRNO.' || size || '/2019', 4, 'critical', null)
    when 3 then ('statute', 'IPC, 19' || lpad(size, 2, '0'), 'IPC, 19' || lpad(size, 2, '0'), 6, 'major', null)
    when 4 then ('section_ref', 'Section ' || size || ' (2)', 'Section ' || size || ' (2)', 3, 'critical', null)
    when 5 then ('time', lpad(cast(n % 24 as varchar), 2, '0') || ':30 hrs', '30:undefined', 3, 'minor', null)
    when 6 then ('address_pin', 'Pin 38' || lpad(size, 4, '0'), '38' || lpad(size, 4, '0'), 0, 'minor', null)
    when 7 then ('person_name', name, {_LATIN.format('name')}, 4, 'major', null)
    when 8 then ('party_name', name, {_LATIN.format('name')}, 8, 'critical', 'accused')
    when 9 then ('place', name || ' Bank', {_LATIN.format("name || 'bank'")}, 0, 'major', null)
    when 10 then ('count_phrase', case when n % 2 = 0 then 'seven' else 'hundred' end, case when n % 2 = 0 then '7' else '100' end, 5, 'minor', null)
    else ('number', '12,' || lpad(size, 3, '0'), '12' || lpad(size, 3, '0') || '|12,' || lpad(size, 3, '0'), 4, 'major', null) end as f
  from p)
select doc_id, f[1] as kind, f[2] as surface, f[3] as normalized, cast(f[4] as int) as start, f[5] as severity, f[6] as role from f"""


# Replies of a model, in the forms that models give


def _replies(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("n"), F.col("o_orderpriority").alias("t"))
    q = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    n, t = F.col("n"), F.col("t")
    forms = [
        q('```json\n{"segments": [{"id": ', n, ', "target": "', t, '"}, {"id": 1, "text": "x"}]}\n```'),
        q('Here you are: {"segments": {"', n, '": {"text": "', t, '"}, "b": {"text": "none"}}} Done.'),
        q('{"segments": [{"id": "[', n, ']", "translation": "', t, '", "confidence": 0.5}, {"target": "second"}]}'),
        q('[{"segments": 1}] no'), q('{"segments": [{"id": ', n, ', "target": "first"}, {"index": ', n, ', "target": "', t, '"}]'),
        q('{"segments": [{"id": ', n, ', "target": "first"}, {"index": ', n, ', "target": "', t, '"}]}'),
    ]
    out = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        out = F.when(F.col("o_orderkey") % 7 == k, form).otherwise(out)
    return o.select("o_orderkey", out.alias("raw"))


def replies_read(spark: SparkSession, d: str) -> DataFrame:
    """Segments out of replies with fences, prose around them, several schemas, and faults."""
    return replies.reply_targets(_replies(spark, d), "raw", ["o_orderkey"]).select("o_orderkey", "id", "target", "confidence")


QUERIES["replies_read"] = replies_read
SQL["replies_read"] = """with o as (select o_orderkey, o_orderkey % 7 as k, o_orderpriority as t from orders)
select o_orderkey, o_orderkey as id, case when k = 0 and o_orderkey = 1 then 'x' else t end as target, case when k = 2 then 0.5::double end as confidence from o where k in (0, 1, 2, 5)
  and not (k = 2 and o_orderkey = 1)
union all select o_orderkey, 1, 'x', null from o where k = 0 and o_orderkey <> 1
union all select o_orderkey, 1, 'second', null from o where k = 2"""


def judge_batches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as a judge is shown them, read back from the prompt, and verdicts put to blocks by place or by number."""
    li = numbered(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("block_ord").alias("block_idx"), "l_quantity", "l_shipdate")
    pair = replies.judge_pair(F.col("block_idx"), F.concat(F.lit("રકમ "), F.col("l_quantity").cast("int")), F.date_format("l_shipdate", "d MMMM yyyy"), F.array(F.lit("term")))
    li = li.withColumns({"batch": F.floor(F.col("block_idx") / 3).cast("int"), "place": (F.col("block_idx") % 3).cast("int"), "pair": pair, "n_blocks": F.count("*").over(Window.partitionBy("doc_id"))})
    prompts = li.groupBy("doc_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "pair"))), lambda s: s["pair"]), "\\n\\n").alias("prompt"))
    shown = prompts.select("doc_id", "batch", F.explode(replies.judge_pairs(F.concat("prompt", F.lit("\\n\\n## Output\\nJSON only.")))).alias("p"))
    # A model that numbers by place for even documents, and by block for the others.
    by_place = shown.withColumn("id", F.when(F.col("doc_id") % 2 == 0, F.col("p.id") % 3).otherwise(F.col("p.id")))
    verdicts = by_place.select("doc_id", "batch", "id", F.col("p.source").alias("source"), F.col("p.target").alias("target"))
    return replies.reconciled(verdicts, li.select("doc_id", "batch", "place", "block_idx", "n_blocks"), ["doc_id"]).select("doc_id", "block_idx", "source", "target")


QUERIES["judge_batches"] = judge_batches
SQL["judge_batches"] = f"""with {BITEXT.split("li as (select")[0]}
select l_orderkey as doc_id, block_ord as block_idx, 'રકમ ' || cast(l_quantity as int) as source, strftime(l_shipdate, '%-d %B %Y') as target from numbered"""


SQL["name_match"] = f"""with k as (
  select a.n_name as a, b.n_name as b, {_key('a.n_name')} as x, {_key('b.n_name', True)} as y from nation a join nation b on a.n_regionkey = b.n_regionkey)
select a, b, x <> '' and y <> '' and 1 - levenshtein(x, y) / greatest(length(x), length(y), 1) >= 0.85 as match from k"""


# English that its source contradicts


def english_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Survey numbers called roads, and dates that the source lacks, on pages read well and badly."""
    p = table(spark, d, "part").withColumns({"k": F.col("p_partkey") % 4, "n": F.col("p_size").cast("string"), "day": F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")})
    other = F.lpad((F.col("p_size") % 28 + 2).cast("string"), 2, "0")
    source = F.when(F.col("k") == 0, F.concat(F.lit("રે.સ.નં.: "), "n", F.lit(", બ્લોક નં.: "), "n", F.lit("(જુનો), "), "n", F.lit("(નવો)"))).otherwise(F.concat(F.lit("તા. "), "day", F.lit("/11/2019 ના રોજ")))
    target = (
        F.when(F.col("k") == 0, F.concat(F.lit("Road No.: "), "n", F.lit(", Block No.: "), "n", F.lit("(Junoo), "), "n", F.lit("(Navoo).")))
        .when(F.col("k") == 3, F.concat(F.lit(" On "), "day", F.lit("/11/2019. "))).otherwise(F.concat(F.lit("On "), other, F.lit("/11/2019.")))
    )
    confidence = F.when(F.col("k") == 1, 0.5).when(F.col("k") == 2, 0.95)
    return p.select("p_partkey", normalize_target(target, source, confidence).alias("english"))


QUERIES["english_repaired"] = english_repaired
SQL["english_repaired"] = f"""select p_partkey, case p_partkey % 4
  when 0 then 'Revenue Survey No.: ' || p_size || ', Block No.: ' || p_size || '(old), ' || p_size || '(new).' when 1 then '{ILLEGIBLE}'
  when 2 then 'On ' || lpad(cast(p_size % 28 + 2 as varchar), 2, '0') || '/11/2019.'
  else 'On ' || lpad(cast(p_size % 28 + 1 as varchar), 2, '0') || '/11/2019.' end as english from part"""
