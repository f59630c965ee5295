"""DuckDB SQL of the training-data queries that SQL can express."""

TOOL_CALLS = """
with recursive t as (select *, (conv_id * 7 + turn) % 16 as k from conversations),
calls0 as (
  select *, 'call-' || case when k = 5 then turn - 2 else turn end as call_id,
    case when k = 4 then 'draw' when instr(text, 'e.') > 0 then 'ask' when length(text) > 200 then 'write' else 'say' end as name
  from t where role = 'user'),
calls1 as (
  select *, row_number() over (partition by conv_id, call_id order by turn) as nth,
    case when k > 1 then cast(case when name = 'write' then length(text) else turn end as varchar)
         when k = 1 then '"' || case when name = 'write' then length(text) else turn end || '"' end as num
  from calls0),
calls as (
  select *, case when k <> 3 then '{' || concat_ws(',', case when name = 'write' then '"length":' || num end, case when k = 2 then '"mood":null' end,
      '"text":' || cast(to_json(text) as varchar), case when name = 'write' and k = 7 then '"title":"note"' end, case when name <> 'write' then '"turn":' || num end) || '}'
      else cast(to_json(text) as varchar) end as args
  from calls1),
results as (
  select conv_id, turn, text as content, 'call-' || (turn - 1) as call_id, row_number() over (partition by conv_id, turn order by text) as nth from t where role = 'assistant'),
own as (select * from calls where nth = 1),
needs as (
  select conv_id, call_id, 'call-' || (turn // 2 // 2 * 2 + turn % 2) as need from own where turn > 1
  union select conv_id, call_id, 'call-' || turn from own where k = 9
  union select conv_id, call_id, 'call-' || (turn + 2) from own where turn < 2 and k = 10),
edges as (select n.* from needs n join own o on o.conv_id = n.conv_id and o.call_id = n.need),
walk(conv_id, call_id, spot, depth) as (
  select conv_id, call_id, call_id, 0 from own
  union select w.conv_id, w.call_id, e.need, w.depth + 1 from walk w join edges e on e.conv_id = w.conv_id and e.call_id = w.spot where w.depth < 40),
level as (select conv_id, call_id, max(depth) as level from walk group by all having max(depth) < 40),
errs as (
  select o.*, case when name = 'draw' then 'unknown tool' || case when k = 3 then '; not an object' else '' end when k = 3 then 'not an object'
    else concat_ws('; ', case when k = 0 then 'missing ' || f end, case when k = 1 then 'not bigint: ' || f end, case when k = 2 then 'unknown field mood' end) end as errors
  from (select *, case when name = 'write' then 'length' else 'turn' end as f from own) o),
linked as (
  select coalesce(o.conv_id, r.conv_id) as conv_id, coalesce(o.turn, r.turn) as turn, coalesce(o.call_id, r.call_id) as call_id, o.name,
    case when o.conv_id is null then 'orphan' when r.conv_id is null then 'unanswered' else 'linked' end as status,
    o.errors = '' as valid, coalesce(o.errors, '') as errors, o.args, r.content
  from errs o full join (select * from results where nth = 1) r on o.conv_id = r.conv_id and o.call_id = r.call_id),
rows as (
  select l.*, v.level from linked l left join level v on v.conv_id = l.conv_id and v.call_id = l.call_id
  union all by name
  select conv_id, turn, call_id, name, 'duplicate' as status, null::boolean as valid, '' as errors, cast(to_json(raw) as varchar) as args, null as content, null as level
  from (select *, case when k = 3 then text else RAW end as raw from calls where nth > 1))
select conv_id, turn, call_id, name, cast(level as int) as level, status, valid, errors,
  '{"arguments":' || coalesce(args, 'null') || ',"call_id":' || cast(to_json(call_id) as varchar) || ',"content":' || coalesce(cast(to_json(content) as varchar), 'null')
  || ',"name":' || coalesce(cast(to_json(name) as varchar), 'null') || ',"status":"' || status || '"}' as json
from rows
"""
#: A duplicate call's arguments stay as they were given, fields in the order of writing.
RAW = """'{' || concat_ws(',', case when name <> 'write' then '"turn":' || num end, case when name = 'write' and k = 7 then '"title":"note"' end,
      '"text":' || cast(to_json(text) as varchar), case when k = 2 then '"mood":null' end, case when name = 'write' then '"length":' || num end) || '}'"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

#: Links are confirmed by counting shared shingles of each two documents; components by the least id reached.
NEAR_DEDUP = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
reach(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, l.b from reach r join links l on l.a = r.other),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(l.component_id, d.doc_id) as component_id, d.doc_id = coalesce(l.component_id, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join least l on l.doc_id = d.doc_id
"""

#: Words by place; phrases as windows over the words of a piece; each candidate's cuts looked up among the phrases' counts.
COLLOCATIONS = """
with d as (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as p from d),
q as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from p),
g as (
  select lang, 1 as k, unnest(w) as g from q
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from q where len(w) > 1
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from q where len(w) > 2),
f as materialized (select lang, k, g, count(*) as f from g group by all having count(*) >= 10),
n as (select lang, count(*) as n from g where k = 1 group by lang),
c as (select lang, k, g, f as a, string_split(g, ' ') as w from f where k > 1),
cut as (
  select lang, k, g, a, w, 1 as spot, w[1] as x, array_to_string(w[2:], ' ') as y from c
  union all select lang, k, g, a, w, 2, w[1] || ' ' || w[2], w[3] from c where k = 3),
scored as (
  select c.lang, c.k, c.g, c.a, c.spot, l.f as l, r.f as r, cast(1000000::hugeint * c.a * c.a // (l.f::hugeint * r.f) as bigint) as score
  from cut c join f l on l.lang = c.lang and l.g = c.x and l.k = c.spot join f r on r.lang = c.lang and r.g = c.y and r.k = c.k - c.spot),
low as (select * from scored qualify row_number() over (partition by lang, k, g order by score, spot) = 1),
around as (
  select lang, g, max(a) as a from (
    select lang, w[1] || ' ' || w[2] as g, a from c where k = 3 union all select lang, w[2] || ' ' || w[3], a from c where k = 3) group by all),
ranked as (
  select s.*, row_number() over (partition by s.lang order by score desc, s.a desc, s.g) as rank
  from low s left join around o on s.k = 2 and o.lang = s.lang and o.g = s.g where o.a is null or 100 * o.a < 50 * s.a)
select r.lang, r.rank, r.g as phrase, r.a, r.l, r.r, n.n, r.score from ranked r join n on n.lang = r.lang where r.rank <= 2000
"""

_ROUND = """
near{i} as materialized (
  select vec_id, v, cluster, distance from (
    select v.vec_id, v.v, c.cluster, list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as distance from v cross join c{i} c)
  qualify row_number() over (partition by vec_id order by distance, cluster) = 1)"""
_MOVE = """
m{j} as (select cluster, spot, floor(sum(x)::double / count(*)) as x from (select cluster, unnest(v) as x, unnest(range(1, 65)) as spot from near{i}) group by all),
c{j} as materialized (select c.cluster, coalesce(m.c, c.c) as c from c{i} c left join (select cluster, list(x::bigint order by spot) as c from m{j} group by cluster) m on m.cluster = c.cluster)"""
#: Ten rounds written out. Sums stay below 2**53 here, where doubles are exact.
CLUSTERS = (
    """
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (
  select cast(row_number() over (order by sha256('3:' || vec_id)) - 1 as int) as cluster, v as c from v order by sha256('3:' || vec_id) limit 8),"""
    + ",".join(_ROUND.format(i=i) + "," + _MOVE.format(i=i, j=i + 1) for i in range(10))
    + ","
    + _ROUND.format(i=10)
    + """
select n.vec_id, n.cluster, cast(n.distance as bigint) as distance, cast(sum(n.distance) over (partition by n.cluster) as bigint) as cluster_inertia,
  cast(sum(n.distance) over () as bigint) as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256
from near10 n join c10 c on c.cluster = n.cluster
"""
)

LINE_DEDUP = """
with d as (select row_number() over () as d, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
k as (
  select d, doc_id, l, list_transform(l, lambda x: translate(regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as k from d),
often as (select key from (select distinct d, unnest(k) as key from k) where length(key) >= 1 group by key having count(*) >= 10),
x as (select d, doc_id, unnest(l) as line, unnest(k) as key, unnest(range(len(l))) as spot from k)
select doc_id, count(*) as n_lines, count(o.key) as n_dropped, sha256(coalesce(string_agg(case when o.key is null then line end, chr(10) order by spot), '')) as kept_sha256
from x left join often o on o.key = x.key group by d, doc_id
"""

SQL = {
    "op4_near_dedup": NEAR_DEDUP, "op6_tool_calls": TOOL_CALLS.replace("RAW", RAW), "op10_kd_top_k": TOP_K, "op11_collocations": COLLOCATIONS,
    "op12_centroid_clusters": CLUSTERS, "op13_line_dedup": LINE_DEDUP,
}
