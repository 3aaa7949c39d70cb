"""Queries of stored tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups, repair, report, store
from ..rules import statutes
from . import oracles, queries
from .views import BITEXT, bitext, numbered, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _status(c: str) -> Column:
    return F.element_at(F.array(*map(F.lit, ("running", "queued", "failed", "done"))), (F.col(c) % 4 + 1).cast("int"))


_JOBS = "jobs as (select *, ['running', 'queued', 'failed', 'done'][1 + event_id % 4] as status from events)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("status", _status("event_id"))


@query("select o_orderkey as doc_id, o_orderdate from orders")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    return store.document_list(o, "o_orderdate")


@query("select doc_id, lang, n_chars from documents where doc_id = 17")
def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    return store.document(table(spark, d, "documents"), 17).select("doc_id", "lang", "n_chars")


def _stored_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = bitext(spark, d)
    confidence = F.when(F.col("block_ord") % 2 == 1, F.lit(0.9))
    return b.withColumns({"block_id": F.concat(F.lit("b"), F.col("block_ord") + 1), "page_no": (F.col("block_ord") % 3).cast("int"), "page_confidence": confidence})


@query(f"with {BITEXT} select doc_id, block_ord, cast(block_ord as int) as place, target_text from bitext")
def blocks_in_order(spark: SparkSession, d: str) -> DataFrame:
    return store.blocks_in_order(_stored_blocks(spark, d)).select("doc_id", "block_ord", "place", "target_text")


@query(f"with {BITEXT} select doc_id, cast(block_ord % 3 as int) as page_no, cast(0.9 as double) as page_confidence from bitext where block_ord % 2 = 1 group by all")
def page_confidences(spark: SparkSession, d: str) -> DataFrame:
    return store.page_confidences(_stored_blocks(spark, d))


@query(f"""with {BITEXT} select doc_id, cast(block_ord as int) as seg_idx, 'b' || (block_ord + 1) as block_id, target_text as target,
  case when doc_id % 2 = 0 then 0.8 else 1.0 end as confidence, doc_id % 2 = 0 and block_ord = 0 as locked from bitext""")
def stored_translation(spark: SparkSession, d: str) -> DataFrame:
    b = _stored_blocks(spark, d)
    s = b.filter("doc_id % 2 = 0").select(
        "doc_id", F.col("block_ord").alias("seg_idx"), "block_id", "page_no", F.col("source_text").alias("source"), F.col("target_text").alias("target"),
        F.lit(0.8).alias("confidence"), (F.col("block_ord") == 0).alias("locked"),
    )
    return store.stored_translation(s, b).drop("source")


@query(f"""with {oracles._FACTS} select doc_id, block_ord, "check", cast(row_number() over (partition by doc_id order by block_ord) as int) as place from finds""")
def findings_in_order(spark: SparkSession, d: str) -> DataFrame:
    return store.findings_in_order(queries._findings(spark, d), "block_ord").select("doc_id", "block_ord", "check", "place")


@query(f"""with {oracles._FACTS} select doc_id, block_ord, kind, cast(row_number() over (partition by doc_id order by block_ord % 2, block_ord, start) as int) as place from src""")
def datums_in_order(spark: SparkSession, d: str) -> DataFrame:
    found = queries.datums.extract_datums(bitext(spark, d), "source_text", "s", queries.KEYS)
    return store.datums_in_order(found.withColumn("page_no", F.col("block_ord") % 2), "block_ord", "start").select("doc_id", "block_ord", "kind", "place")


@query("""with p as (select l_orderkey as doc_id, case when l_linenumber % 4 <> 0 then case when l_linenumber % 2 = 1 then 0.5 else 0.875 end end as c from lineitem)
select doc_id, avg(c) as mean_ocr, coalesce(avg(c) < 0.72, false) as warned from p group by 1""")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    c = F.when(n % 4 != 0, F.when(n % 2 == 1, 0.5).otherwise(0.875))
    return store.mean_confidence(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), c.alias("confidence")))


@query("""select l_orderkey, l_linenumber, l_linenumber % 2 = 0 and coalesce(case when l_linenumber % 4 = 0 then 0.5 end, 1) < 0.8 as review from lineitem""")
def page_review(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    flag = store.to_review(F.when(n % 2 == 0, "scanned").otherwise("text"), F.when(n % 4 == 0, 0.5))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("review"))


@query(f"with {_JOBS} select event_id, status from jobs where status in ('queued', 'running')")
def open_jobs(spark: SparkSession, d: str) -> DataFrame:
    return store.open_jobs(_jobs(spark, d)).select("event_id", "status")


@query(f"""with {_JOBS}, q as (select event_id, row_number() over (order by ts, event_id) as position from jobs where status = 'queued')
select event_id, position, case when position = 1 then 'Queued — next in line' else 'Queued — ' || (position - 1) || ' ahead' end as detail from q""")
def queue_positions(spark: SparkSession, d: str) -> DataFrame:
    return store.queue_positions(_jobs(spark, d), "status", "ts", "event_id").select("event_id", "position", "detail")


@query(" union all ".join(f"select '{t}' as \"table\", count(*) as n from {t}" for t in ("documents", "pages", "events")))
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.row_counts({t: table(spark, d, t) for t in ("documents", "pages", "events")})


@query("select event_id, event_type from events order by ts desc, event_id desc limit 25")
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return store.recent_activity(table(spark, d, "events"), "ts", "event_id").select("event_id", "event_type")


@query("select doc_id, case when doc_id % 3 <> 0 then lang end as lang from documents")
def parsed_report(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("doc_id") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("doc_id", "lang")))
    docs = table(spark, d, "documents").select("doc_id", body.alias("body"))
    return store.parsed_report(docs, "body", "doc_id long, lang string").select("doc_id", "report.lang")


@query("select doc_id, coalesce(case when doc_id % 3 = 0 then 'affidavit' end, case when doc_id % 2 = 0 then 'contract' end, 'other_legal') as type from documents")
def document_types(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.when(n % 3 == 0, "affidavit").alias("declared"), F.when(n % 2 == 0, "contract").alias("detected"))
    return store.document_types(docs, "declared", "detected").select("doc_id", "type")


@query(f"""with {oracles._FACTS} select doc_id, '{{"critical":' || count(*) || ',"major":0,"minor":0,"info":0,"total":' || count(*) || '}}' as counts from finds group by 1""")
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.run_counts(queries._findings(spark, d))


@query(f"""with {oracles._FACTS} select doc_id, sum(case k when 4 then 0 when 0 then 1 when 1 then 1 else 2 end)::bigint as n_agreed, count(*) filter (k = 0) as n_changed,
  sum(case k when 4 then 2 when 1 then 1 else 0 end)::bigint as n_missing, cast(0 as bigint) as n_added from bitext group by 1""")
def datum_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.datum_counts(queries._matched(spark, d))


@query(f"""with {oracles._FACTS}, {_JOBS}, j as (select event_id % 500 as doc_id, arg_max(status, struct_pack(ts := ts, e := event_id)) as job_status from jobs group by 1),
f as (select doc_id, count(*) as n from finds group by 1)
select o_orderkey as doc_id, job_status, coalesce(n, 0) as n_critical from orders left join j on j.doc_id = o_orderkey left join f on f.doc_id = o_orderkey""")
def document_summary(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d).select((F.col("event_id") % 500).alias("doc_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("job_id"), "status")
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return store.document_summary(docs, jobs, queries._findings(spark, d)).select("doc_id", "job_status", "n_critical")


@query(f"with {_JOBS} select true as ok, count(*) filter (status in ('queued', 'running')) as n_open from jobs")
def health(spark: SparkSession, d: str) -> DataFrame:
    return store.health(_jobs(spark, d))


@query("select c_custkey, c_custkey || '' as own from customer")
def block_ids(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("c_nationkey")
    return table(spark, d, "customer").select("c_custkey", store.without_prefix(F.concat(doc.cast("string"), F.lit(":"), F.col("c_custkey").cast("string")), doc).alias("own"))


_TOKENS = ["IPC", "i.p.c.", "CrPC", "NI ACT", "NIACT", "PMLA ACT", "SARFAESIACT", "XYZ", "bsa"]


@query("select s_suppkey, ['BNS', 'BNS', 'BNSS', 'NI Act', null, null, 'SARFAESI', null, null][1 + s_suppkey % 9] as new_token from supplier")
def statute_lookup(spark: SparkSession, d: str) -> DataFrame:
    token = F.element_at(F.array(*map(F.lit, _TOKENS)), (F.col("s_suppkey") % 9 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", lookups.statute(token)["new_token"].alias("new_token"))


_TYPES = [*(r[0] for r in statutes.DOC_TYPES), "unheard_of"]
_META = ", ".join(f"({i}, '{k}', '{label}', '{register}')" for i, (k, label, register) in enumerate([*((r[0], r[1], r[4]) for r in statutes.DOC_TYPES), ("unheard_of", "unheard_of", "instrument")]))


@query(f"select p_partkey, m.type, m.label, m.register from part join (values {_META}) as m(i, type, label, register) on p_partkey % 16 = m.i")
def type_metadata(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % 16 + 1).cast("int"))
    return lookups.described(table(spark, d, "part").select("p_partkey", kind.alias("type"))).select("p_partkey", "type", "label", "register")


@query(f"""with {BITEXT}, e as (select *, count(*) over w as n, count(*) filter (k = 4) over w as bad from bitext window w as (partition by doc_id)),
r as (select doc_id, block_ord as seg_idx, row_number() over (partition by doc_id order by block_ord) - 1 as i from e where k = 4 and bad * 2 <= n)
select doc_id, seg_idx, cast(i // 7 as int) as chunk_id from r where i // 7 < 8""")
def empty_retry(spark: SparkSession, d: str) -> DataFrame:
    s = bitext(spark, d).select("doc_id", F.col("block_ord").alias("seg_idx"), F.col("source_text").alias("source"), F.col("target_text").alias("target"))
    return repair.empty_retry(s).select("doc_id", "seg_idx", "chunk_id")


@query(f"""with {BITEXT} select doc_id, cast(block_ord as int) as seg_idx, cast(row_number() over (partition by doc_id order by block_ord) - 1 as int) // 7 as chunk_id from bitext""")
def failed_retry(spark: SparkSession, d: str) -> DataFrame:
    s = bitext(spark, d).select("doc_id", F.col("block_ord").alias("seg_idx"), F.col("source_text").alias("source"))
    return repair.failed_retry(s).select("doc_id", "seg_idx", "chunk_id")


@query(f"""with {BITEXT}, c as (select doc_id, block_ord, k in (0, 4) as failed from bitext),
s as (select *, coalesce(lag(failed) over w, false) and coalesce(lag(failed, 2) over w, false) as ended from c window w as (partition by doc_id order by block_ord)),
e as (select *, max(ended) over (partition by doc_id order by block_ord) as over from s)
select doc_id, cast(block_ord as int) as chunk_id, failed from e where not over""")
def retry_stop(spark: SparkSession, d: str) -> DataFrame:
    chunks = bitext(spark, d).join(numbered(spark, d).select(F.col("l_orderkey").alias("doc_id"), "block_ord", (F.col("l_linenumber") % 5).alias("k")), ["doc_id", "block_ord"])
    return repair.stopped_after(chunks.select("doc_id", F.col("block_ord").alias("chunk_id"), F.col("k").isin(0, 4).alias("failed")))


@query(f"""with {BITEXT} select doc_id, block_ord as seg_idx, case when k = 4 then 'again ' || block_ord else target_text end as target, k = 4 as replaced from bitext""")
def retry_merge(spark: SparkSession, d: str) -> DataFrame:
    s = bitext(spark, d).select("doc_id", F.col("block_ord").alias("seg_idx"), F.col("target_text").alias("target"))
    new = s.select("doc_id", "seg_idx", F.when(F.col("target") == "", F.concat(F.lit("again "), F.col("seg_idx").cast("string"))).otherwise("").alias("target"))
    return repair.replaced(s, new).select("doc_id", "seg_idx", "target", "replaced")


@query(f"""with {BITEXT}, q as (select doc_id, block_ord, cast(block_ord // 2 as int) as batch from bitext)
select doc_id, block_ord as seg_idx, 'x' || block_ord as candidate, doc_id % 2 = 0 as by_id from q""")
def placed_answers(spark: SparkSession, d: str) -> DataFrame:
    q = bitext(spark, d).select("doc_id", F.col("block_ord").alias("seg_idx"), F.floor(F.col("block_ord") / 2).cast("int").alias("batch"), F.col("block_ord").alias("place"))
    shown = F.when(F.col("doc_id") % 2 == 0, F.col("seg_idx")).otherwise(F.col("seg_idx") + 1000)
    a = q.select("doc_id", "batch", F.col("place").alias("pos"), shown.alias("id"), F.concat(F.lit(" x"), F.col("seg_idx").cast("string")).alias("target"))
    return repair.placed_answers(q, a)


@query("""with l as (select l_orderkey as doc_id, l_linenumber as pos, cast(100 + l_linenumber as varchar) as entry, l_shipdate as day from lineitem),
m as (select doc_id, max(struct_pack(day := day, entry := entry)) as l from l group by 1)
select doc_id, 'Note: the latest revenue entry recited is Mutation Entry No. ' || l.entry || ' dated ' || strftime(l.day, '%d/%m/%Y') || ', which predates the conveyance dated 01/01/1997. No entry recording that conveyance in the name of Owner is recited; whether the purchaser''s name has since been mutated is to be confirmed from the current Record of Rights.' as gap
from m where l.day < date '1997-01-01'""")
def mutation_gap(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    entries = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") + 100).cast("string").alias("entry"), F.date_format("l_shipdate", "dd/MM/yyyy").alias("dated"))
    docs = li.select(F.col("l_orderkey").alias("doc_id"), F.lit("01/01/1997").alias("deed_date"), F.lit("Owner").alias("owner")).distinct()
    return report.mutation_gap(docs, entries)


@query("""select p_partkey as doc_id, 'All that piece and parcel of immovable property ' || case when p_size % 2 = 0 then 'bearing Revenue Survey No. ' || p_size || case when p_size % 3 = 0 then ', old Block No. ' || p_partkey || ' (now new Block No. 9)' else '' end || ', ' when p_size % 3 = 0 then 'bearing old Block No. ' || p_partkey || ' (now new Block No. 9), ' else 'bearing Block No. 9, ' end
  || 'situate at Village ' || p_brand || ', together with all rights, title and interest therein.' as text from (select * replace (p_size as p_size) from part) where p_size % 2 <> 0 or p_size % 3 = 0
union all select p_partkey, 'All that piece and parcel of immovable property bearing Revenue Survey No. ' || p_size || ', Block No. 9, situate at Village ' || p_brand || ', together with all rights, title and interest therein.' from part where p_size % 2 = 0 and p_size % 3 <> 0""")
def property_sentence(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    facts = table(spark, d, "part").select(
        F.col("p_partkey").alias("doc_id"), F.when(n % 2 == 0, n.cast("string")).otherwise("").alias("rsn"),
        F.when(n % 3 == 0, F.col("p_partkey").cast("string")).otherwise("").alias("old_block"), F.lit("9").alias("new_block"),
        F.col("p_brand").alias("village"), F.lit("").alias("khata"), F.lit("").alias("area"), F.lit("").alias("consideration"),
    )
    return facts.select("doc_id", report.property_sentence(facts).alias("text"))


@query(f"""with {oracles._SCORES} select doc_id, 'Automated checks compared ' || 2 * n || ' data item(s) and ' || n || ' terminology occurrence(s) across ' || n || ' block(s), producing ' || n || ' English segment(s). '
  || (crit + empty) || ' finding(s) were raised: ' || crit || ' critical, ' || empty || ' major and 0 minor. The meaning-level review covered every block.' as summary,
  case when crit + empty = 0 then 1 else 2 end as n_focus from graded""")
def narrative(spark: SparkSession, d: str) -> DataFrame:
    return report.narrative(queries._scored(spark, d)).select("doc_id", "summary", F.size("focus").alias("n_focus"))


@query("""select o_orderkey as doc_id, case when o_orderkey % 2 = 0 then 'final' else 'draft' end as status,
  case when o_orderkey % 2 = 1 then 'pending' when o_orderkey % 3 = 0 then 'skipped' when o_orderkey % 5 = 0 then 'complete' else 'partial' end as semantic_audit from orders""")
def report_status(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    status = report.report_status(n % 2 == 0, n % 3 != 0, n % 5 == 0)
    return table(spark, d, "orders").select(n.alias("doc_id"), status.alias("s")).select("doc_id", "s.status", "s.semantic_audit")
