"""DuckDB SQL of the queries that SQL can express."""

_OP1 = r"""
with d as (
  select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
w as (
  select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
win as (
  select r, unnest(range(1, greatest(len(w) - 3, 1))) as i, w from w),
k as (
  select r, i, array_to_string(w[i:i+4], ' ') as k from win),
c as (
  select r, i, count(*) over (partition by r, k) as n from k),
cov as (
  select r, count(distinct p) as n_repeat from (select r, unnest(range(i, i + 5)) as p from c where n > 1) group by r),
ln as (
  select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup
  from (select r, unnest(string_split(t, chr(10))) as l from w)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
m as (
  select w.doc_id, cast(len(w.w) as bigint) as n_words,
    cast(length(array_to_string(w.w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_dup, 0) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat, 0) as bigint) as n_repeat_words
  from w left join cov using (r) left join ln using (r)),
b as (
  select *, cast((case when n_words < 10 then 1 else 0 end) + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when 5 * n_dup_lines > 2 * n_lines then 8 else 0 end)
    + (case when word_chars < 2 * n_words then 16 else 0 end) + (case when word_chars > 25 * n_words then 32 else 0 end) as bigint)
    as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 as base_failed,
  failed_bits = 0 as kept, failed_bits from b
"""

_OP2 = r"""
with d as (
  select doc_id, source, text, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as bigint) as size
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
w as (
  select *, case k % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, 2.0::double * source_size as lim from s),
v as (
  select *, lim / weight as ratio,
    (1.5 * sum(source_size) over () - coalesce(sum(lim) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by lim / weight, source nulls last rows between current row and unbounded following) as level from w),
f as (
  select *, first_value(case when level <= ratio then level end ignore nulls) over (order by ratio, source nulls last rows between unbounded preceding and current row) as common from v),
t as (
  select source, source_size, least(coalesce(weight * common, lim), lim) as target,
    ('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 12))::bigint % 1000000000000 as u,
    cast(floor(coalesce(least(coalesce(weight * common, lim), lim) / nullif(source_size, 0), 0) * 1e12 + 0.5) as hugeint) as rate from f),
o as (
  select doc_id, source, size, md5(coalesce(cast(doc_id as varchar), 'null')) as h,
    length(bin(size)) * 16 + (('0x' || hex(substr(rpad(bin(size), 4, '0'), 1, 4)))::bigint * 0) as cl,
    substr(rpad(bin(size), 4, '0'), 1, 4) as top from d),
p as (
  select *, row_number() over (partition by source order by length(bin(size)) desc, top desc, h, doc_id) as place from o)
select doc_id, size, t.source_size, t.target,
  size * cast((rate * place + u) // 1000000000000 - (rate * (place - 1) + u) // 1000000000000 as bigint) as taken
from p join t on p.source is not distinct from t.source
"""

_OP9 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (
  select *, '### ' || replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') || ': '
    || replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') || ' </turn>' || chr(10) as f,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n from c),
x as (
  select *, sum(length(f)) over (partition by conv_id order by i) as upto from e),
g as (
  select conv_id, cast(count(*) as bigint) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
    coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '') as loss,
    cast(sum(upto) filter (role = 'assistant' or i = n) as bigint) as formatted_chars from x group by conv_id)
select conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""

_OP10 = r"""
with d as (
  select row_number() over (order by doc_id nulls last) as r, doc_id, text, string_split(text, chr(10)) as l from documents),
w as (
  select r, i - 1 as pos, l[i:i+2] as k from (select r, l, unnest(range(1, greatest(len(l) - 1, 1))) as i from d where text is not null)),
k as (
  select r, pos, row_number() over (partition by k order by r, pos) as n from w
  where regexp_matches(array_to_string(k, ''), '[^\x20\x09-\x0D]')),
gone as (
  select distinct r, unnest(range(pos, pos + 3)) as p from k where n > 1),
g as (select r, list(p) as p from gone group by r)
select doc_id, cast(coalesce(len(l), 0) as bigint) as n_lines, cast(coalesce(len(p), 0) as bigint) as n_removed,
  sha256(case when p is null then coalesce(text, '') else
    array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: not list_contains(p, i - 1)), lambda i: l[i]), chr(10)) end) as kept_sha256
from d left join g on d.r = g.r
"""

_OP11 = r"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
t as (select count(*) as nn, cast(sum(len(t)) as bigint) as ll from d where len(t) > 0),
p as (
  select r, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf
  from (select r, doc_id, len(t) as n, unnest(t) as term from d) group by r, term),
w as (
  select term, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double)) as bigint) as w
  from (select term, count(*) as df from p group by term), t),
q as (
  select row_number() over () as i, item_id,
    list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
s as (
  select i, item_id, r, any_value(doc_id) as doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) as bigint) as score
  from (select i, item_id, unnest(t) as term from q) join p using (term) join w using (term), t group by i, item_id, r),
k as (select *, row_number() over (partition by i order by score desc, doc_id nulls last, r) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from k where rank <= 50
"""

_OP12 = r"""
with recursive bits as (
  select i, 0 as step, i as c from range(256) as r(i)
  union all select i, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where step < 8),
crc as (select list(c order by i) as t from bits where step = 8),
d as (
  select row_number() over () as r, *, coalesce('s' || source, '') as g,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, crc.t[cast(xor(c, b) & 255 as integer) + 1])), 4294967295) % 2 = 0 as hit from documents, crc),
f as (
  select *, coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars, '-') as head,
    case when hit then replace(text, chr(10), '') else text end as changed from d),
l as (
  select r, doc_id, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) as now from f),
o as (select *, row_number() over (partition by g order by doc_id nulls first, leaf, r) - 1 as i, count(*) over (partition by g) as n from l),
up as (
  select g, 0 as lv, i, n, leaf as h from o
  union all
  select g, lv + 1, i // 3, cast(ceil(n / 3) as bigint), sha256(string_agg(h, '' order by i)) from up where n > 1 group by g, lv, i // 3, n),
sub as (select g, h as subroot, max(lv) as levels from up where n = 1 group by g, h),
so as (select *, row_number() over (order by g) - 1 as i, count(*) over () as n from sub),
top as (
  select 0 as lv, i, n, subroot as h from so
  union all
  select lv + 1, i // 3, cast(ceil(n / 3) as bigint), sha256(string_agg(h, '' order by i)) from top where n > 1 group by lv, i // 3, n),
nodes as (select g, lv, i, h from up union all select '*', lv, i, h from top),
steps as (
  select r, g, lv, lv as k, o.i // cast(pow(3, lv) as bigint) as i from o join sub using (g), range(20) as x(lv) where lv < levels
  union all
  select r, '*', lv, levels + lv, so.i // cast(pow(3, lv) as bigint) from o join so using (g), range(20) as x(lv)
  where lv < (select max(lv) from top)),
beside as (
  select r, s.k, coalesce(string_agg(case when n.i < s.i then h end, '' order by n.i), '') as before,
    coalesce(string_agg(case when n.i > s.i then h end, '' order by n.i), '') as behind
  from steps s join nodes n on n.g = s.g and n.lv = s.lv and n.i // 3 = s.i // 3 group by r, s.k),
fold as (
  select r, 0 as k, now as h from o
  union all
  select f.r, f.k + 1, sha256(before || h || behind) from fold f join beside b on b.r = f.r and b.k = f.k),
ends as (select r, arg_max(h, k) as folded_root from fold group by r),
proofs as (select r, sha256(string_agg(before || behind, '' order by k)) as proof_sha256 from beside group by r)
select doc_id, leaf, subroot, (select h from top where n = 1) as root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root,
  folded_root = (select h from top where n = 1) as verified
from o join sub using (g) join ends using (r) left join proofs using (r)
"""

SQL = {"op1_quality_rules": _OP1, "op2_mix_sources": _OP2, "op9_chat_format": _OP9, "op10_line_dedup": _OP10, "op11_lexical_search": _OP11, "op12_manifest": _OP12}
