"""Queries of the passes that bring a translation to an end, with providers that fail by rule, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import control, passes, repair
from ..rules import values as V
from .views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_STAMPS = ("this stamp line was read again here", "the seal of the office is not legible")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, seg_idx, source, n: a customer's orders as the sentences of a document."""
    idx = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("n"), idx.alias("seg_idx"),
        F.floor("o_totalprice").cast("long").cast("string").alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    return o.select("doc_id", "seg_idx", "n", F.concat(F.lit("રકમ રૂ. "), "a", F.lit(" તા. "), "day").alias("source"))


def _part(i: int) -> Column:
    """The amount (1) or the date (2) of a source."""
    return F.regexp_extract("source", r"([0-9]+) તા\. (.*)$", i)


def _right() -> Column:
    return F.concat(F.lit("Amount of Rs. "), _part(1), F.lit(" dated "), _part(2))


def _pick(by: Column, *texts: Column | None) -> Column:
    out = F.lit(None).cast("string")
    for i, text in enumerate(texts):
        if text is not None:
            out = F.when(by == i, text).otherwise(out)
    return out


def _opinions(by: Column) -> Column:
    stamps = [F.lit(x) for x in _STAMPS]
    return _pick(by, _right(), *stamps, None, F.concat(F.lit("Amount of Rs. "), _part(1)), _right())


_SEGMENTS = """seg as (
  select o_custkey as doc_id, o_orderkey as n, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as seg_idx,
    cast(cast(floor(o_totalprice) as bigint) as varchar) as a, strftime(o_orderdate, '%Y-%m-%d') as day from orders)"""
_RIGHT = "'Amount of Rs. ' || a || ' dated ' || day"
_SOURCE = "'રકમ રૂ. ' || a || ' તા. ' || day"
_OPINION = f"[{_RIGHT}, '{_STAMPS[0]}', '{_STAMPS[1]}', null, 'Amount of Rs. ' || a, {_RIGHT}]"
_KEY = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _weight(text: str) -> str:
    """What a text weighs but for repetition, for the texts that occur here."""
    digits = f"regexp_replace({text}, '[^0-9]', '', 'g')"
    lost = f"not contains({digits}, a) or not contains({digits}, day[1:4]) or not contains({digits}, day[6:7]) or not contains({digits}, day[9:10])"
    foreign = f"len(list_filter(regexp_extract_all({text}, '[0-9]+'), lambda x: length(x) >= 4 and x <> a and x <> day[1:4])) > 0"
    indic = f"regexp_matches({text}, '[\\x{{0A80}}-\\x{{0AFF}}]')"
    return f"(case when coalesce({text}, '') = '' then 8 else case when {indic} then 7 else 0 end + case when {lost} then 6 else 0 end + case when {foreign} then 6 else 0 end end)"


_LONG = "length({0}) >= 24 and length({0}) - length(replace({0}, ' ', '')) >= 3"


def _walk(suffix: str = "") -> str:
    """CTEs from state (doc_id, seg_idx, a, day, target) and answer (doc_id, seg_idx, candidate): the queue, walked one by one.

    Ends in done: state with what was taken.
    """
    again = _LONG.format("key")
    return f"""
keyed as (select *, {_KEY.format('target')} as key from state),
weighed as (
  select *, {_weight('target')} + case when {again} and count(*) over (partition by doc_id, key) > 1 then 2 else 0 end as weight from keyed),
placed as (select *, row_number() over (partition by doc_id order by weight desc, seg_idx) as place from weighed where weight > 0),
tried as (
  select p.doc_id, p.seg_idx, p.weight, p.place, r.candidate, {_KEY.format('r.candidate')} as new, {_weight('r.candidate')} as after
  from placed p left join answer r on p.doc_id = r.doc_id and p.seg_idx = r.seg_idx where p.place <= 48),
walk as (
  with recursive w(doc_id, step, keys, taken) as (
    select doc_id, 0, list(key order by seg_idx), cast([] as int[]) from weighed group by doc_id
    union all
    select w.doc_id, step + 1,
      case when ok then list_concat(keys[1 : seg_idx], [new], keys[seg_idx + 2 :]) else keys end,
      case when ok then list_append(taken, seg_idx) else taken end
    from (
      select w.*, t.seg_idx, t.new, coalesce(t.candidate, '') <> '' and t.after + case when {_LONG.format('t.new')}
        and list_contains(list_concat(w.keys[1 : t.seg_idx], w.keys[t.seg_idx + 2 :]), t.new) then 2 else 0 end < t.weight as ok
      from w join tried t on t.doc_id = w.doc_id and t.place = w.step + 1) w)
  select doc_id, arg_max(taken, step) as taken from w group by doc_id),
done as (
  select s.doc_id, s.seg_idx, a, day, coalesce(list_contains(w.taken, s.seg_idx), false) as replaced,
    case when list_contains(w.taken, s.seg_idx) then r.candidate else s.target end as target
  from state s left join walk w on s.doc_id = w.doc_id left join answer r on s.doc_id = r.doc_id and s.seg_idx = r.seg_idx)"""


def second_opinion(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that repeat each other, taken in the order of the queue."""
    s = _segments(spark, d)
    wrong = F.concat(F.lit("Amount of Rs. "), (_part(1).cast("long") + 1).cast("string"))
    h = (F.col("n") * 7 + F.col("doc_id")) % 8
    target = _pick(h, _right(), _right(), _right(), F.lit(""), F.concat(_right(), F.lit(" રકમ")), *(F.lit(x) for x in _STAMPS), wrong)
    s = s.withColumns({"target": target, "candidate": _opinions((F.col("n") * 5 + F.col("doc_id")) % 6)})
    asked = control.repair_queue(control.assess(s.select("doc_id", "seg_idx", "source", "target")))
    given = asked.select("doc_id", "seg_idx").join(s.select("doc_id", "seg_idx", "candidate"), ["doc_id", "seg_idx"])
    return repair.adopted(s, given).select("doc_id", "seg_idx", "target", "replaced")


QUERIES["second_opinion"] = second_opinion
SQL["second_opinion"] = f"""with {_SEGMENTS},
state as (select doc_id, seg_idx, a, day, [{_RIGHT}, {_RIGHT}, {_RIGHT}, '', {_RIGHT} || ' રકમ', '{_STAMPS[0]}', '{_STAMPS[1]}',
  'Amount of Rs. ' || (cast(a as bigint) + 1)][1 + (n * 7 + doc_id) % 8] as target from seg),
answer as (select doc_id, seg_idx, {_OPINION}[1 + (n * 5 + doc_id) % 6] as candidate from seg),
{_walk()}
select doc_id, seg_idx, target, replaced from done"""


def _first(requests: DataFrame) -> DataFrame:
    """Leaves out whole chunks and single segments, and sends empty and mixed texts."""
    h = (F.col("seg_idx") * 7 + F.col("doc_id")) % 8
    text = _pick(h, _right(), _right(), _right(), F.lit(""), F.col("source"), F.concat(_right(), F.lit(" રક")), _right())
    silent = (F.col("doc_id") * 3 + F.col("chunk_id")) % 4 == 0
    return requests.filter(~silent).withColumn("target", text).filter("target is not null")


def _again(requests: DataFrame) -> DataFrame:
    text = _pick((F.col("seg_idx") + F.col("doc_id")) % 5, F.lit(""), F.col("source"), _right(), _right(), _right())
    return requests.filter((F.col("doc_id") + F.col("chunk_id")) % 3 != 0).withColumn("target", text)


def _stronger(requests: DataFrame) -> DataFrame:
    """Fails for whole batches, and for every other document numbers its answers from 0."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("place")) - 1
    out = requests.withColumns({"pos": nth, "target": F.coalesce(_opinions((F.col("seg_idx") * 5 + F.col("doc_id")) % 6), F.lit(""))})
    out = out.filter((F.col("doc_id") + F.col("chunk_id")) % 7 != 0)
    return out.withColumn("id", F.when(F.col("doc_id") % 2 == 0, F.col("seg_idx")).otherwise(F.col("pos"))).select("doc_id", "chunk_id", "pos", "id", "target")


def retry_run(spark: SparkSession, d: str) -> DataFrame:
    """All passes over documents whose providers fail by rule; chunks of four segments, then of two."""
    return passes.translated(_segments(spark, d), _first, _again, _stronger, items=4).drop("source")


def _retried(name: str, wanted: str, limit: str) -> str:
    """CTEs <name>_q (requests in chunks of two), <name>_a (answers) and <name>_c (chunks that failed) of a later pass."""
    return f"""
{name}_q as (
  select *, cast((row_number() over (partition by doc_id order by seg_idx) - 1) // 2 as int) as chunk from ({wanted})),
{name}_l as (select q.* from {name}_q q join (select doc_id, count(*) as n from {name}_q group by 1) c on q.doc_id = c.doc_id where chunk < {limit}),
{name}_a as (
  select *, ['', {_SOURCE}, {_RIGHT}, {_RIGHT}, {_RIGHT}][1 + (seg_idx + doc_id) % 5] as target from {name}_l where (doc_id + chunk) % 3 <> 0)"""


QUERIES["retry_run"] = retry_run
SQL["retry_run"] = rf"""with {_SEGMENTS},
asked as (select *, seg_idx // 4 as chunk from seg),
one as (
  select *, [{_RIGHT}, {_RIGHT}, {_RIGHT}, '', {_SOURCE}, {_RIGHT} || ' રક', {_RIGHT}, null][1 + (seg_idx * 7 + doc_id) % 8] as t from asked
  where (doc_id * 3 + chunk) % 4 <> 0),
chunks as (
  select q.doc_id, q.chunk, 2 * count(o.t) < count(*) as failed
  from asked q left join one o on q.doc_id = o.doc_id and q.seg_idx = o.seg_idx group by 1, 2),
pass1 as (
  select q.*, c.failed, case when c.failed then '' else coalesce(o.t, '') end as target
  from asked q join chunks c on q.doc_id = c.doc_id and q.chunk = c.chunk left join one o on q.doc_id = o.doc_id and q.seg_idx = o.seg_idx),
{_retried('two', 'select doc_id, seg_idx, a, day from pass1 where failed', 'least(32, greatest(8, ceil(n / 2.0)))')},
two_c as (select l.doc_id, l.chunk, (l.doc_id + l.chunk) % 3 = 0 as failed from two_l l group by 1, 2),
two_e as (select *, coalesce(lag(failed, 1) over w, false) and coalesce(lag(failed, 2) over w, false) as ended
  from two_c window w as (partition by doc_id order by chunk)),
two_s as (select doc_id, min(chunk) as stop from two_e where ended group by 1),
pass2 as (
  select p.* replace (case when coalesce(t.target, '') <> '' then t.target else p.target end as target)
  from pass1 p left join (
    select x.* from two_a x left join two_s s on x.doc_id = s.doc_id where s.stop is null or x.chunk < s.stop) t
  on p.doc_id = t.doc_id and p.seg_idx = t.seg_idx),
share as (select doc_id, count(*) as n_all, count(*) filter (target = '' and not failed) as bad from pass2 group by 1),
{_retried('three', 'select p.doc_id, seg_idx, a, day from pass2 p join share s on p.doc_id = s.doc_id where length(target) = 0 and not failed and bad <= n_all / 2', '8')},
pass3 as (
  select p.* replace (case when coalesce(t.target, '') <> '' then t.target else p.target end as target)
  from pass2 p left join three_a t on p.doc_id = t.doc_id and p.seg_idx = t.seg_idx),
usable as (select doc_id from pass3 group by 1 having 2 * count(*) filter (target = '') <= count(*)),
state as (select p.doc_id, seg_idx, a, day, target from pass3 p join usable u on p.doc_id = u.doc_id),
q_keyed as (select *, {_KEY.format('target')} as key from state),
q_weighed as (
  select *, {_weight('target')} + case when {_LONG.format('key')} and count(*) over (partition by doc_id, key) > 1 then 2 else 0 end as weight from q_keyed),
q_placed as (select *, row_number() over (partition by doc_id order by weight desc, seg_idx) as place from q_weighed where weight > 0),
queue as (select *, (place - 1) // 8 as batch, (place - 1) % 8 as nth from q_placed where place <= 48),
opinion as (
  select doc_id, batch, nth, case when doc_id % 2 = 0 then seg_idx else nth end as id, coalesce({_OPINION}[1 + (seg_idx * 5 + doc_id) % 6], '') as text
  from queue where (doc_id + batch) % 7 <> 0),
batches as (
  select q.doc_id, q.batch, count(*) filter (o.text <> '') = 0 as failed from queue q left join opinion o on q.doc_id = o.doc_id and q.batch = o.batch and q.nth = o.nth group by 1, 2),
fails as (select doc_id, min(batch) as stop from batches where failed group by 1),
heard as (select o.* from opinion o left join fails f on o.doc_id = f.doc_id where f.stop is null or o.batch < f.stop),
known as (
  select h.doc_id, h.batch, count(q.seg_idx) = count(*) as by_id
  from heard h left join queue q on h.doc_id = q.doc_id and h.batch = q.batch and h.id = q.seg_idx group by 1, 2),
answer as (
  select q.doc_id, q.seg_idx, h.text as candidate
  from queue q join known k on q.doc_id = k.doc_id and q.batch = k.batch
  join heard h on h.doc_id = q.doc_id and h.batch = q.batch and case when by_id then h.id = q.seg_idx else h.nth = q.nth end where h.text <> ''),
{_walk()},
pass4 as (
  select p.doc_id, p.seg_idx, p.a, p.day, coalesce(d.target, p.target) as target, r.candidate is not null as reasked
  from pass3 p left join done d on p.doc_id = d.doc_id and p.seg_idx = d.seg_idx left join answer r on p.doc_id = r.doc_id and p.seg_idx = r.seg_idx),
ratio as (select *, coalesce(len(regexp_extract_all(target, '[\x{{0A80}}-\x{{0AFF}}]')) / nullif(length(replace(target, ' ', '')), 0), 0.0) as share from pass4),
{_retried('five', 'select doc_id, seg_idx, a, day from ratio where share > 0.15 and not reasked', '8')},
pass5 as (
  select p.doc_id, p.seg_idx, p.a, p.day, case when f.target = {_RIGHT.replace('a ||', 'p.a ||').replace('day', 'p.day')} then f.target else p.target end as target
  from ratio p left join five_a f on p.doc_id = f.doc_id and p.seg_idx = f.seg_idx),
mixed as (
  select *, coalesce(len(regexp_extract_all(target, '[\x{{0A80}}-\x{{0AFF}}]')) / nullif(length(replace(target, ' ', '')), 0), 0.0) as share,
    trim(regexp_replace(regexp_replace(target, '[\x{{0A80}}-\x{{0AFF}}]+', ' ', 'g'), '\s+', ' ', 'g')) as bare from pass5)
select doc_id, seg_idx,
  case when target = '' then '{V.NO_TRANSLATION}'
    when share = 0 then target when share > 0.4 or (share > 0.08 and length(bare) < 12) or bare = '' then '{V.ILLEGIBLE}'
    when share > 0.08 then bare || '{V.ILLEGIBLE_SUFFIX}' else bare end as target,
  case when target = '' then 'filled' when share > 0 then 'stripped' else 'translated' end as state
from mixed"""
