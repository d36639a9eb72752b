"""Independent DuckDB forms of the queries that SQL can express.

Fixed sentences, rules and curve steps are written into the SQL from the operators' own tables, since they are
data; everything else is said anew.
"""
from __future__ import annotations

from .licences import RULES, SENTENCES
from .sharding import BITS, curve_steps

ORACLE: dict[str, str] = {}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# every rule in turn: a run of identifiers found in the sequence is named and taken out
_RULE_STEPS, _prev = [], "seqs"
for _i, (_name, _run) in enumerate(RULES):
    _text = "|".join(f"<{x}>" for x in _run)
    _RULE_STEPS.append(f"""r{_i} as (select doc_id, text, ids,
      case when contains(rest, '|{_text}|') then replace(rest, '{_text}', '#') else rest end as rest,
      case when contains(rest, '|{_text}|') and not list_contains(found, {_quoted(_name)}) then list_append(found, {_quoted(_name)}) else found end as found from {_prev})""")
    _prev = f"r{_i}"

ORACLE["op3_licence_scan"] = f"""
with known(sentence, id) as (values {", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in SENTENCES)}),
docs as (select distinct doc_id, text from documents where text is not null),
marked as (select doc_id, text, string_split_regex(regexp_replace(text, '([.!?;:])\\s+', '\\1' || chr(10), 'g'), '\\n+') as parts from docs),
parts as (select doc_id, text, unnest(parts) as s, generate_subscripts(parts, 1) as place from marked),
plain as (select doc_id, text, place, regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}.-]+', ' ', 'g') as s from parts),
-- no look-around here: take '.' and '-' off the ends of the words one by one
normal as (select doc_id, text, place, array_to_string(list_filter(list_transform(string_split(s, ' '), lambda w:
    regexp_replace(regexp_replace(w, '^[.-]+', ''), '[.-]+$', '')), lambda w: w <> ''), ' ') as sentence from plain),
hits as (select doc_id, text, place, id from normal join known using (sentence)),
per as (select doc_id, text, list(id order by place) as ids from hits group by doc_id, text),
seqs as (select doc_id, text, ids, '|' || array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '|') || '|' as rest, []::varchar[] as found from per),
{", ".join(_RULE_STEPS)}
select d.doc_id, coalesce(array_to_string(r.ids, ','), '') as sentence_ids, coalesce(array_to_string(list_sort(r.found), ','), '') as licences,
  case when r.ids is null then 'none' when len(r.found) > 0 then 'known' else 'unmatched' end as status
from documents d left join {_prev} r on d.doc_id is not distinct from r.doc_id and d.text = r.text
"""

# CRC-32 by its bitwise definition: a table of 256 remainders, then one step for each byte.
_CRC_STEP = "case when {0} % 2 = 1 then xor({0} >> 1, 3988292384::ubigint) else {0} >> 1 end"
_crc = "n"
_CRC_LEVELS = ["c0 as (select n::ubigint as n, n::ubigint as v from range(256) t(n))"]
for _k in range(8):
    _CRC_LEVELS.append(f"c{_k + 1} as (select n, {_CRC_STEP.format('v')} as v from c{_k})")

_SIZE_LEVEL = ("least((length(bin(size)) - 1) * 4 + (case when length(bin(size)) >= 3 then size // (1::bigint << (length(bin(size)) - 3)) "
               "else size * (1::bigint << (3 - length(bin(size)))) end)::int - 4, 63)")
_CELL = "((((a >> l) & 1) * 2 + ((b >> l) & 1)) * 2 + ((c >> l) & 1))"

ORACLE["op4_hilbert_shards"] = f"""
with recursive {", ".join(_CRC_LEVELS)},
crc_table as (select list(v order by n) as t from c8),
raw as (select row_number() over () as r, doc_id, source, lang, coalesce(text, '') as text from documents),
bytes as (select r, list_transform(range(octet_length(encode(text))), lambda i: ('0x' || substr(hex(encode(text)), (2 * i + 1)::int, 2))::ubigint) as b from raw),
crcs as (select r, xor(list_reduce(b, lambda acc, x: xor(acc >> 8, t[((xor(acc, x) & 255) + 1)::bigint]), 4294967295::ubigint), 4294967295::ubigint)::bigint as text_crc32
         from bytes, crc_table),
s as (select source, (row_number() over (order by source nulls first) - 1) * 64 // greatest(count(*) over (), 64) as a from (select distinct source from documents)),
g as (select lang, (row_number() over (order by lang nulls first) - 1) * 64 // greatest(count(*) over (), 64) as b from (select distinct lang from documents)),
facts as (select raw.r, doc_id, (octet_length(encode(text)) + 1)::bigint as size, text_crc32, a::int as a, b::int as b
          from raw join crcs using (r) join s on raw.source is not distinct from s.source join g on raw.lang is not distinct from g.lang),
cells as (select *, {_SIZE_LEVEL}::int as c from facts),
steps as (select {curve_steps(3)} as t),
walk(a, b, c, l, state, h) as (
  select distinct a, b, c, {BITS - 1}, 0, 0::bigint from cells
  union all
  select a, b, c, l - 1, (t[state * 8 + {_CELL} + 1] % 256)::int, h * 8 + t[state * 8 + {_CELL} + 1] // 256 from walk, steps where l >= 0),
indexed as (select cells.*, h as curve from cells join walk using (a, b, c) where l = -1),
placed as (select *, row_number() over (order by curve, doc_id nulls first, text_crc32, size) - 1 as p, count(*) over () as n from indexed),
cut as (select *, p * 16 // n as shard from placed)
select doc_id, size, text_crc32, 'rows' as law, shard::int as shard, (p - (shard * n + 15) // 16)::bigint as slot, null::int as grown_shard, curve from cut
"""

ORACLE["op5_line_dedup"] = """
with docs as (select distinct doc_id, text, string_split(text, chr(10)) as l from documents where text is not null),
w as (select doc_id, text, unnest(range(len(l) - 2)) as p, l from docs where len(l) >= 3),
h as (select doc_id, text, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] as t from w),
real as (select doc_id, text, md5(text) as g, p, t from h where regexp_matches(t, '[^ \\t\\n\\x0B\\f\\r]')),
ranked as (select *, first_value(doc_id) over o as d0, first_value(g) over o as g0, first_value(p) over o as p0, row_number() over o as k
           from real window o as (partition by t order by doc_id nulls first, g, p)),
later as (select doc_id, text, case when doc_id is not distinct from d0 and g = g0 then greatest(p, p0 + 3) else p end as a, p + 3 as z from ranked where k > 1),
gone as (select doc_id, text, list_distinct(flatten(list(range(a, z)))) as lines from later group by doc_id, text)
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines, coalesce(len(g.lines), 0) as n_removed,
  case when g.lines is null then d.text else array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: not list_contains(g.lines, i - 1)), chr(10)) end as text
from documents d left join gone g on d.doc_id is not distinct from g.doc_id and d.text = g.text
"""

ORACLE["op8_fair_mix"] = """
with recursive sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
src as (select source, source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] as w from per),
-- the level at which what is left is shared by weight among the sources that have not reached their limit
fill(n, level, stopped) as (
  select 0, null::double, -1::bigint
  union all
  select n + 1, (select (1.5 * sum(source_size) - coalesce(sum(2 * source_size) filter (level is not null and 2 * source_size <= w * level), 0))
                        / nullif(sum(w) filter (level is null or 2 * source_size > w * level), 0) from src),
         (select count(*) filter (level is not null and 2 * source_size <= w * level) from src)
  from fill where n < 40),
final as (select coalesce(max_by(level, n), 0) as level from fill where level is not null),
t as (select source, source_size, w, case when 2 * source_size <= w * level then (2 * source_size)::double else w * level end as target,
             row_number() over (order by source nulls last) - 1 as rank from src, final),
q as (select doc_id, s.source, size, source_size, target, rank, md5('mix-1|' || coalesce(doc_id::varchar, 'null')) as m, row_number() over () as r
      from sized s join t on s.source is not distinct from t.source),
line as (select *, sum(size) over (partition by source order by m, doc_id nulls first, size rows unbounded preceding)::bigint as after from q),
entry as (select r, size, rank, (after + i * source_size) / target as finish from line, (values (0), (1)) e(i) where size > 0),
run as (select *, sum(size) over (order by finish, rank rows unbounded preceding) as total from entry),
took as (select r, count(*) as copies from run where total <= (select 1.5 * sum(size) from sized) group by r)
select doc_id, size, source_size, target, (coalesce(copies, 0) * size)::bigint as taken from line left join took using (r)
"""

_WORDS = f"list_filter(string_split_regex({_ASCII_LOWER.format('coalesce(text, chr(32))')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

ORACLE["op9_decontaminate"] = f"""
with item as (select item_id, {_WORDS} as w from benchmark),
sized as (select item_id, w, least(len(w), 13) as k from item where len(w) > 0),
win as (select distinct item_id, k, array_to_string(w[i + 1:i + k], ' ') as t from (select item_id, w, k, unnest(range(len(w) - k + 1)) as i from sized)),
docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
lens as (select distinct k from win),
places as (select r, w, k, unnest(range(len(w) - k + 1)) as i from docs, lens where len(w) >= k),
cand as (select r, k, i, array_to_string(w[i + 1:i + k], ' ') as t from places),
hit as (select r, i, cand.k, item_id from cand join win on cand.k = win.k and cand.t = win.t),
cover as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from hit) group by r),
items as (select r, count(distinct item_id) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from hit) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join cover using (r) left join items using (r)
"""

ORACLE["op10_top_k"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
pair as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint as score
         from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pair)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
"""

# every order is run over the failure masks, and Shapley values are sums over all orders
ORACLE["op12_filter_audit"] = """
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as x from documents),
w as (select *, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') as ws, min(doc_id) over (partition by x) as first from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select part, case when len(ws) < 100 then 'A' else '' end
        || case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 'B' else '' end
        || case when 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x) then 'C' else '' end
        || case when regexp_matches(x, '[#$%&*|]') then 'D' else '' end
        || case when w.doc_id > first then 'E' else '' end as fails,
        coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join l on w.doc_id = l.doc_id),
g as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
c(a) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o as (select v.a || w.a || x.a || y.a || z.a as filter_order from c v, c w, c x, c y, c z
      where len(list_distinct([v.a, w.a, x.a, y.a, z.a])) = 5),
s as (select filter_order, step, filter_order[step] as own, filter_order[1:step - 1] as before from o, range(1, 6) t(step)),
r as (select part, filter_order, step, own, n, good, toxic, fails,
        contains(fails, own) as fail, before <> '' and regexp_matches(fails, '[' || before || '!]') as gone from g, s),
t as (select part, filter_order, step, own,
        sum(case when not gone and not fail then n else 0 end) as kept,
        sum(case when not gone and fail then n else 0 end) as removed,
        sum(case when gone and fail then n else 0 end) as redundant,
        sum(case when fails = own then n else 0 end) as unique_fails,
        sum(case when not gone and fail then good else 0 end) as good_lost,
        sum(case when not gone and fail then toxic else 0 end) as toxic_lost from r group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) as shapley from t"""


def _codebook_rounds(rounds: int) -> str:
    """Assignments and updates in turn: parts x(vec_id, p, v), entries b<r>(p, e, c)."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""
a{r} as materialized (select k, p, v, arg_min(e, (d, e)) as e, min(d) as d from (
  select k, x.p, v, e, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) as d from x join b{r} on x.p = b{r}.p) group by k, p, v)""")
        if r < rounds:
            out.append(f"""
u{r} as (select p, e, list(m order by i) as c from (select p, e, i, floor(sum(v[i]) / count(*)) as m from a{r}, range(1, 17) t(i) group by p, e, i) group by p, e),
b{r + 1} as materialized (select b.p, b.e, coalesce(u.c, b.c) as c from b{r} b left join u{r} u on b.p = u.p and b.e = u.e)""")
    return ",".join(out)


ORACLE["op13_ball_codes"] = f"""
with kept as (select row_number() over (order by vec_id) as k, vec_id, label, [floor(1024 * cast(z as double)) for z in embedding] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0),
x as materialized (select k, p, v[16 * p + 1:16 * p + 16] as v from kept, range(0, 4) t(p)),
b0 as materialized (select p, k - 1 as e, v as c from x where k <= 256),{_codebook_rounds(4)},
coded as (select k, string_agg(printf('%02x', e), '' order by p) as code, sum(d) as error from a4 group by k),
book as (select sha256(string_agg(array_to_string([cast(cast(z as bigint) as varchar) for z in c], ','), ',' order by p, e)) as s from b4)
select vec_id, code, cast(error as bigint) as error, cast(sum(error) over (partition by label) as bigint) as label_error, s as codebooks_sha256
from coded join kept using (k), book"""
