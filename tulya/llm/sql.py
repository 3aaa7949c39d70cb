"""DuckDB SQL for the operators that SQL can express."""

OP1 = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(10, len(w)) as n, w[i : i + least(10, len(w)) - 1] as ws
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from iw where len(w) > 0)),
sizes as (select distinct n from win),
dwin as (
  select doc_id, n, i, w[i : i + n - 1] as ws
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
hit as (select d.doc_id, d.i, d.n, x.item_id from dwin d join win x on d.n = x.n and d.ws = x.ws),
pos as (select doc_id, count(*) as n_hit from (
  select distinct doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (
  select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select dw.doc_id, cast(len(dw.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos on pos.doc_id = dw.doc_id left join its on its.doc_id = dw.doc_id
"""

OP5 = """
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex,
    min(page_id) over (partition by coalesce(html, '')) as first_id from pages),
d as (
  select *, [cast('0x' || substr(hex, 1 + 10 * cast(i as int), 10) as bigint) for i in range(4)] as quarters from p)
select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((quarters[1 + i // 8] >> (35 - 5 * (i % 8))) & 31) as int), 1)
    for i in range(32)], '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from d
"""

#: Full sets, pairs by the shingles that they share, components by the transitive closure of links.
OP9 = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + 2], ' ') as shingle
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from shared join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
edges as (select a, b from links union all select b, a from links),
reach as (
  with recursive r(doc_id, other) as (
    select doc_id, doc_id from w union select r.doc_id, e.b from r join edges e on r.other = e.a)
  select doc_id, min(other) as component_id from r group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, component_id, w.doc_id = component_id as kept
from w left join n on w.doc_id = n.doc_id join reach on w.doc_id = reach.doc_id
"""

#: CRC-32 by the byte: the table by its rule, then one step a byte of "<doc_id>:<run>".
OP13 = r"""
with crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
seen as (
  select doc_id, run, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents)
  group by all),
summed as (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [195, unicode(c) - 64] end))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as h from seen, crc),
words as (
  select word, cast(sum(n) as bigint) as n from (
    select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n
    from summed)
  where length(word) >= 5 group by word having sum(n) >= 3),
holes as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest
  from (select word, n, unnest(range(0, length(word))) as i from words)),
near as (
  select a.word, b.word as other, b.n as other_n from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from holes a join words b on a.rest = b.word
  union select b.word, a.word, a.n from holes a join words b on a.rest = b.word),
best as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * w.n then other end as form,
    case when other_n >= 2 * w.n then other_n end as form_n
  from words w left join best b on w.word = b.word),
walk as (
  with recursive steps(word, place) as (
    select word, word from forms union all select s.word, f.form from steps s join forms f on s.place = f.word where f.form is not null)
  select word, place from steps),
roots as (select w.word, w.place as root from walk w join forms f on w.place = f.word where f.form is null)
select f.word, f.form, r.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n from forms f join roots r on f.word = r.word
"""

#: Documents folded by what they fail, then every order of the filters step by step.
OP12 = r"""
with words as (
  select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
flags as (
  select part,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by text), false)] as fails,
    coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from words left join (
    select doc_id as of, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by doc_id)
  on doc_id = of),
folded as (select part, fails, good, toxic, count(*) as n from flags group by all),
parts as (select distinct part from flags),
letter as (select unnest(range(1, 6)) as f),
orders as (
  select [a.f, b.f, c.f, d.f, e.f] as fs from letter a, letter b, letter c, letter d, letter e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select fs, step, fs[step] as f, fs[: step - 1] as before from orders, (select unnest(range(1, 6)) as step)),
seen as (
  select part, fs, step, f, fails[f] as failing, good, toxic, n,
    len(list_filter(before, lambda x: fails[x])) > 0 as gone,
    len(list_filter(fails, lambda x: x)) = 1 as single
  from folded, steps),
summed as (
  select part, fs, step, f,
    sum(case when not gone and not failing then n else 0 end) as kept,
    sum(case when not gone and failing then n else 0 end) as removed,
    sum(case when gone and failing then n else 0 end) as redundant,
    sum(case when failing and single then n else 0 end) as unique_fails,
    sum(case when not gone and failing and good then n else 0 end) as good_lost,
    sum(case when not gone and failing and toxic then n else 0 end) as toxic_lost
  from seen group by all)
select part, array_to_string(list_transform(fs, lambda x: substr('ABCDE', cast(x as int), 1)), '') as filter_order, cast(step as int) as step,
  cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, f) as bigint) as shapley
from summed
"""

ORACLES = {
    "op5_warc": OP5,
    "op1_decontaminate": OP1,
    "op9_minhash": OP9,
    "op12_filter_audit": OP12,
    "op13_spelling": OP13,
}
