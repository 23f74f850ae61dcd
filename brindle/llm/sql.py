r"""DuckDB SQL for the queries of this subpackage, written from the contracts, not from the Spark code."""

WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t as (
  select *, len(regexp_extract_all(text, '{WORD}')) + 4 as tokens,
    row_number() over (partition by conv_id order by turn, role, text) - 1 as pos,
    24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) as chars from c),
p as (select *, sum(tokens) over (partition by conv_id order by pos) as e,
    greatest(384 - first_value(case when role = 'system' then tokens else 0 end) over (partition by conv_id order by pos), 128) as room from t),
k as (select *, e - tokens as s, cast(e - 1 as bigint) // room as stretch from p),
w as (select *, 2 * stretch + case when cast(s as bigint) // room = stretch or max(e) over (partition by conv_id, stretch) - min(s) over (partition by conv_id, stretch) <= room then 1 else 0 end as win from k),
f as (select conv_id, win, min(s) as first from w group by all having min(s) > 0),
again as (
  select f.conv_id, sum(chars) as chars from f join w on f.conv_id = w.conv_id
  where (w.pos = 0 and w.role = 'system') or (w.s >= f.first - 128 and w.s < f.first) group by all)
select w.conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(w.chars) + coalesce(any_value(again.chars), 0) as bigint) as formatted_chars
from w left join again on w.conv_id = again.conv_id group by w.conv_id
"""

OP2 = rf"""
with d as (
  select doc_id, source, coalesce('s' || source, 'n') as key, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as size from documents),
g as (select sum(size) as total, greatest(1, cast(floor(sqrt(sum(size)) / 16) as bigint)) as n from d),
d2 as (select d.*, cast('0x' || substr(md5('mix/' || coalesce(doc_id::varchar, '')), 1, 8) as bigint) % g.n as shard from d, g),
sh as (select key, any_value(source) as source, shard, cast(sum(size) as bigint) as words from d2 group by key, shard),
so as (select key, any_value(source) as source, cast(sum(words) as bigint) as source_size from sh group by key),
so1 as (select *, cast([3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight, 2e0 * source_size as cap from so),
so2 as (
  select *, (15e-1 * (select total from g)::double - coalesce(sum(cap) over (order by cap / weight, key rows between unbounded preceding and 1 preceding), 0e0))
    / sum(weight) over (order by cap / weight, key rows between current row and unbounded following) as level from so1),
so3 as (select key, source_size, least(cap, max(level) over () * weight) as target from so2),
seats as (select so3.*, v.j, target / (2 * v.j + 1) as q, row_number() over (order by target / (2 * v.j + 1) desc, key, v.j) as r
  from so3, unnest(range(0, cast(ceil(target / 16) as bigint) + 2)) as v(j)),
so4 as (select key, source_size, target, count(*) filter (where r <= round(15e-1 * (select total from g)::double / 16) and target > 0) as quota from seats group by all),
sh2 as (select sh.*, source_size, target, quota from sh join so4 using (key)),
seats2 as (select sh2.*, row_number() over (partition by key order by words::double / (2 * v.j + 1) desc, shard, v.j) as r
  from sh2, unnest(range(0, cast(ceil(words * quota::double / greatest(source_size, 1)) as bigint) + 3)) as v(j)),
sh3 as (select key, shard, words, source_size, target, count(*) filter (where r <= quota and words > 0) as blocks from seats2 group by all),
p as (select d2.*, sum(size) over (partition by key, shard order by md5('mix/order/' || coalesce(doc_id::varchar, '')), doc_id, size rows between unbounded preceding and current row) as e from d2),
x as (select p.*, p.e - p.size as s, words, source_size, target, least(blocks * 16, 2 * words) as run,
    (cast('0x' || substr(md5('mix/start/' || key || '/' || shard::varchar), 1, 8) as bigint) * 16) % greatest(2 * words, 1) as r from p join sh3 using (key, shard))
select doc_id, size, source_size, target, cast(
    greatest(0, least(e, r + run) - greatest(s, r)) + greatest(0, least(e, r - 2 * words + run) - greatest(s, r - 2 * words))
  + greatest(0, least(e + words, r + run) - greatest(s + words, r)) + greatest(0, least(e + words, r - 2 * words + run) - greatest(s + words, r - 2 * words)) as bigint) as taken
from x
"""

OP7 = rf"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as pos from documents),
k as (select *, translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, min(doc_id) as keeper from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.*, s.keeper is null or s.keeper = k.doc_id as stays from k left join s using (key))
select doc_id, count(*) as n_lines, count(*) filter (where not stays) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where stays), '')) as kept_sha256
from m group by doc_id
"""

OP8 = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from documents),
s as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) end) as sh from w),
x as (select doc_id, len(sh) as n, unnest(sh) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from p where 100 * c >= 80 * (na + nb - c)),
u as (select a, b from e union all select b, a from e),
r(doc_id, other) as (select doc_id, doc_id from s union select r.doc_id, u.b from r join u on r.other = u.a)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, min(r.other) as component_id, min(r.other) = s.doc_id as kept
from s join r using (doc_id) group by s.doc_id, len(sh)
"""

OP12 = r"""
with d as (
  select row_number() over () as id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
q as (
  select item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark),
t as (select count(*) filter (where len(ts) > 0) as n_docs, cast(sum(len(ts)) as bigint) as n_terms from d),
c as (select id, doc_id, len(ts) as n, term, count(*) as tf from (select id, doc_id, ts, unnest(ts) as term from d) group by id, doc_id, len(ts), term),
w as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1))) as bigint) as w from c, t group by term),
s as (
  select item_id, id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) as bigint) as score
  from q join c using (term) join w using (term), t group by item_id, id, doc_id),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id, id) as integer) as rank, doc_id, score from s where score > 0)
select * from r where rank <= 50
"""

OP13 = rf"""
with n as (select doc_id, coalesce(length(text), 0) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over own as keep_id, count(*) over (partition by t) as group_size,
  row_number() over own = 1 as kept, sha256(t) as text_sha256
from n window own as (partition by t order by points desc, doc_id)
"""

SQL = {"op1_chat_format": OP1, "op2_mix_sources": OP2, "op7_line_dedup": OP7, "op8_near_duplicates": OP8, "op12_ranked_search": OP12, "op13_exact_dedup": OP13}
