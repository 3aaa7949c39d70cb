"""Queries of joins by order, of streams that keep state, and of tables replaced by document; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, facts, jobs, store, structure, terms
from ..sources import scratch, writers
from ..streaming import state
from . import run as batch
from .views import BITEXT, SEEDED_GUJARATI, bitext, numbered, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_LAST = "last_value(case when is_mark then {0} end ignore nulls) over (partition by user_id order by ts, event_id, is_mark desc rows between unbounded preceding and current row)"


@query(f"""with b as (
  select user_id, ts, event_id, value, false as is_mark from events where event_type = 'purchase'
  union all select user_id, ts, event_id, value, true from events where event_type = 'view'),
l as (select *, {_LAST.format('event_id')} as view_id, {_LAST.format('value')} as view_value from b)
select user_id, event_id, view_id, view_value from l where not is_mark""")
def last_view(spark: SparkSession, d: str) -> DataFrame:
    """Every purchase with its user's last view before it; a user's events are cut by the day."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    views = e.filter("event_type = 'view'").select("user_id", "ts", "event_id", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    day = F.date_trunc("day", F.col("ts"))
    return asof.as_of(e.filter("event_type = 'purchase'"), views, "user_id", "ts", ["view_id", "view_value"], day, "event_id").select("user_id", "event_id", "view_id", "view_value")


@query("""with o as (select user_id, ts, event_id, props, lead(event_id) over w as next_id, lead(ts) over w as next_ts
  from events where event_type = 'view' window w as (partition by user_id order by ts, event_id)),
c as (select o.event_id as opened, arg_min(e.event_id, (e.ts, e.event_id)) as closed
  from o join events e on e.user_id = o.user_id and e.event_type in ('purchase', 'error') and (e.ts, e.event_id) > (o.ts, o.event_id)
    and (o.next_ts is null or (e.ts, e.event_id) < (o.next_ts, o.next_id)) group by 1)
select o.user_id, o.event_id as opened, c.closed, coalesce(case when e.event_type = 'error' then e.props end, o.props) as detail,
  cast(floor((epoch_us(e.ts) - epoch_us(o.ts)) / 1000) as bigint) as duration_ms
from o left join c on o.event_id = c.opened left join events e on e.event_id = c.closed""")
def closed_stages(spark: SparkSession, d: str) -> DataFrame:
    """A view opens a stage; the first purchase or error before the next view closes it, an error with a detail of its own."""
    e = table(spark, d, "events").withColumn("detail", F.when(F.col("event_type") != "purchase", F.col("props")))
    return asof.closed_stages(e, "user_id", "ts", "event_id", F.col("event_type") == "view", F.col("event_type").isin("purchase", "error"), "detail")


@query(f"""with {BITEXT}, p as (select doc_id, block_ord, k, case when block_ord % 3 = 1 then block_ord // 3 + 1 end as page from bitext)
select doc_id, block_ord, cast(page_no as int) as page_no from (
  select *, last_value(page ignore nulls) over (partition by doc_id order by block_ord) as page_no from p) where k in (0, 1, 4)""")
def finding_pages(spark: SparkSession, d: str) -> DataFrame:
    """The page of each finding, where every third block tells its page only."""
    b = bitext(spark, d).withColumn("page_no", F.when(F.col("block_ord") % 3 == 1, F.floor(F.col("block_ord") / 3).cast("int") + 1))
    wrong = b.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct(), "doc_id", "left_semi")
    k = F.regexp_extract("source_text", "([0-9]+) તા", 1).cast("long")
    shown = F.regexp_replace(F.regexp_extract("target_text", r"Rs\. ([0-9,]+)", 1), ",", "").try_cast("long")
    found = wrong.filter((F.trim("target_text") == "") | (shown != k) | ~F.contains("target_text", F.lit("dated"))).select("doc_id", "block_ord")
    return asof.page_of_findings(found, b)


# A stored document, checked again


#: Check, its count and whether it is passed. Digits and Latin letters are most of either kind of source, which is one warning each.
_CHECKS = [
    ("Script and encoding preflight", "1", "not latin"), ("Data extraction and comparison", "2 * n", "wrong = 0 and empty = 0"),
    ("Terminology compliance", "case when latin then 0 else n end", "latin or empty = 0"), ("Segment coverage", "n", "empty = 0"),
    ("Sentence-level alignment", "n", "empty = 0"), ("Untranslated residue", "left_over", "left_over = 0"), ("Semantic faithfulness review", "n", "empty = 0 and left_over = 0"),
]


@query(f"""with {BITEXT}, d as (
  select doc_id, doc_id % 7 = 0 as latin, count(*) as n, count(*) filter (k in (0, 1)) as wrong, count(*) filter (k = 4) as empty,
    count(*) filter (k = 2 and block_ord % 2 = 0) as left_over from bitext group by 1)
""" + " union all ".join(f"""select doc_id, '{name}' as "check", cast({count} as bigint) as "count", {passed} as passed from d""" for name, count, passed in _CHECKS))
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """The record of checks of stored documents: every seventh isn't in Gujarati, some English holds Gujarati still."""
    b = bitext(spark, d)
    latin = F.col("doc_id") % 7 == 0
    amount, day = F.regexp_extract("source_text", "([0-9]+) તા", 1), F.to_date(F.regexp_extract("source_text", "([0-9-]+)$", 1))
    english = F.concat(F.lit("An amount of Rs. "), amount, F.lit(" dated "), F.date_format(day, "d MMMM yyyy"))
    b = b.withColumn("source_text", F.when(latin, english).otherwise(F.col("source_text")))
    marked = numbered(spark, d).select(F.col("l_orderkey").alias("doc_id"), "block_ord", (F.col("l_linenumber") % 5).alias("k"))
    b = b.join(marked, ["doc_id", "block_ord"])
    target = F.when((F.col("k") == 2) & (F.col("block_ord") % 2 == 0), F.concat("target_text", F.lit(" રકમ રૂપિયા માત્ર"))).otherwise(F.col("target_text"))
    blocks = scratch.kept(b.select("doc_id", "block_ord", F.lit("body").alias("kind"), F.lit(1).alias("page_no"), "source_text", target.alias("target")), "stored")
    done = blocks.select("doc_id", F.col("block_ord").alias("seg_idx"), "block_ord", F.col("source_text").alias("source"), "target")
    documents = structure.preflight(facts.document_text(blocks)).select("doc_id", "warnings", "ok")
    out = batch.verified(blocks.drop("target"), done, documents, terms.glossary(spark, SEEDED_GUJARATI), reports=False, keep=scratch.kept)
    return out["checks"]


_SHOWN = "case l_linenumber % 4 when 0 then 'info' when 1 then 'minor' when 2 then 'critical' else 'major' end"


@query(f"""with numbered as (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_shipdate, l_partkey,
  l_suppkey, l_quantity) - 1 as int) as block_ord from lineitem),
f as (select l_orderkey as doc_id, block_ord, {_SHOWN} as severity, l_returnflag as c, 'f' || substr(md5(concat_ws('|', l_orderkey, l_returnflag, block_ord, 'line ' || l_linenumber)), 1, 15) as id from numbered),
g as (select doc_id, string_agg(id || ':' || severity, ',' order by case severity when 'critical' then 0 when 'major' then 1 when 'minor' then 2 else 3 end, block_ord) as findings,
  cast(count(*) filter (severity = 'critical') as int) as n_critical from f group by 1),
s as (select doc_id, count(*) as n, string_agg(target_text, '|' order by block_ord) as targets from (with {BITEXT} select * from bitext) group by 1),
j as (select event_id % 500 as doc_id, arg_max(event_id, (ts, event_id)) as job_id from events group by 1),
t as (select event_id % 500 as doc_id, string_agg(event_type, ',' order by ts, event_type) as stages from events group by 1)
select o.o_orderkey as doc_id, j.job_id, coalesce(t.stages, '') as stages, coalesce(s.n, 0)::int as n_segments, md5(coalesce(s.targets, '')) as targets,
  coalesce(g.findings, '') as findings, coalesce(g.n_critical, 0) as n_critical
from orders o left join s on o.o_orderkey = s.doc_id left join g on o.o_orderkey = g.doc_id left join j on o.o_orderkey = j.doc_id left join t on o.o_orderkey = t.doc_id
where o.o_orderkey % 3 = 0""")
def document_view(spark: SparkSession, d: str) -> DataFrame:
    """All that is shown of every third document: job, stages, segments, findings by severity with their ids."""
    docs = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"))
    e = table(spark, d, "events").withColumn("doc_id", F.col("event_id") % 500)
    li = numbered(spark, d).select(
        F.col("l_orderkey").alias("doc_id"), "block_ord", F.expr(_SHOWN).alias("severity"), F.col("l_returnflag").alias("check"), F.concat(F.lit("line "), "l_linenumber").alias("title")
    )
    seg = bitext(spark, d).select("doc_id", F.col("block_ord").alias("seg_idx"), F.col("source_text").alias("source"), F.col("target_text").alias("target"))
    out = store.document_view(
        docs, e.select("doc_id", F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at")),
        e.select("doc_id", F.col("event_type").alias("stage"), F.col("ts").alias("started_at")), seg, store.finding_ids(li),
    )
    joined = lambda c, f, by: F.array_join(F.transform(c, f), by)
    return out.select(
        "doc_id", "job.job_id", joined("timings", lambda t: t["stage"], ",").alias("stages"), "n_segments",
        F.md5(joined("segments", lambda s: s["target"], "|").cast("binary")).alias("targets"),
        joined("findings", lambda f: F.concat(f["id"], F.lit(":"), f["severity"]), ",").alias("findings"), F.col("by_severity")["critical"].alias("n_critical"),
    )


# Streams


def _in_parts(spark: SparkSession, d: str, transform: Callable[[DataFrame], DataFrame], parts: int = 3) -> DataFrame:
    """The events as they would come in, a part of their ids at a time, through a stream that keeps its state from run to run."""
    base = scratch.new_path(spark, "stream")
    events = table(spark, d, "events")
    least, most = events.agg(F.min("event_id"), F.max("event_id")).first()
    if least is None:
        return transform(events)
    for i in range(parts):
        low, high = (least + (most + 1 - least) * k // parts for k in (i, i + 1))
        events.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        made = transform(stream)
        q = made.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
        q.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/out")


@query("""with s as (select user_id, event_id, event_type = 'purchase' and value > 97 as final from events),
f as (select user_id, min(event_id) as seq from s where final group by 1)
select cast(s.user_id as varchar) as key, case when f.seq is null then 'draft' else 'final' end as status, coalesce(f.seq, max(s.event_id)) as seq
from s left join f on s.user_id = f.user_id group by s.user_id, f.seq""")
def stream_results(spark: SparkSession, d: str) -> DataFrame:
    """Drafts and finals of users as a stream; what is shown last of each."""
    def transform(e: DataFrame) -> DataFrame:
        e = e.withColumn("status", F.when((F.col("event_type") == "purchase") & (F.col("value") > 97), "final").otherwise("draft"))
        return state.progressive(e, "user_id", "status", "event_id", "props")

    shown = _in_parts(spark, d, transform)
    return shown.groupBy("key").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


@query("""with p as (select user_id, event_id, event_type as stage, cast(floor(value / 20 + 0.5) as int) as percent from events where event_type in ('view', 'click')),
l as (select *, lag(stage) over w as s, lag(percent) over w as p from p window w as (partition by user_id order by event_id))
select cast(user_id as varchar) as key, stage, percent, event_id as seq from l where s is null or s <> stage or p <> percent""")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress of users in two stages, given when stage or whole percent changes."""
    def transform(e: DataFrame) -> DataFrame:
        return state.throttled(e.filter("event_type in ('view', 'click')"), "user_id", "event_type", F.col("value") / 20, "event_id")

    return _in_parts(spark, d, transform)


@query("""with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hours or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as run from g),
r as (select user_id, min(ts) as started, max(ts) + interval 6 hours as ended, count(*) as n from s group by user_id, run)
select user_id, started, ended, n from r where ended <= (select date_trunc('millisecond', max(ts)) - interval 1 hour from events)""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events without a pause of six hours, given once they are over."""
    return _in_parts(spark, d, lambda e: state.sessions(e, "user_id", "ts", "6 hours", "1 hour"))


@query("""with l as (select user_id, max(ts) as ts, arg_max(event_type, (ts, event_id)) as event_type from events group by 1)
select user_id, ts + case event_type when 'error' then interval 1 day else interval 2 days end as deadline from l
where ts + case event_type when 'error' then interval 1 day else interval 2 days end < timestamp '2024-01-31 00:00:00' and event_type <> 'purchase'""")
def over_time(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last stage has gone on for longer than its kind may."""
    last = jobs.latest_job(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").filter("event_type <> 'purchase'")
    limit = F.when(F.col("event_type") == "error", F.expr("interval 1 day")).otherwise(F.expr("interval 2 day"))
    return state.over_time(last, "user_id", "ts", F.lit("2024-01-31 00:00:00").cast(last.schema["ts"].dataType), limit).select("user_id", "deadline")


@query("""select doc_id, case when doc_id % 3 = 0 then 'new' else lang end as lang, case when doc_id % 3 = 0 then n_chars + part else n_chars end as n_chars
from documents, (select unnest([0, 1]) as part) where doc_id % 5 <> 2 and (part = 0 or doc_id % 3 = 0)""")
def documents_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A stored table in which every third document's rows are replaced by two, and every fifth document is removed."""
    path = scratch.new_path(spark, "table")
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    writers.replace_documents(docs, path)
    third = docs.filter("doc_id % 3 = 0")
    new = third.select("doc_id", F.lit("new").alias("lang"), F.explode(F.array(F.col("n_chars"), F.col("n_chars") + 1)).alias("n_chars"))
    writers.replace_documents(new, path)
    writers.replace_documents(new.limit(0), path, removed=docs.filter("doc_id % 5 = 2").select("doc_id"))
    return writers.documents(spark, path, docs.schema)
