"""DuckDB SQL of line dedup, vector codes and fill-in-middle."""

from __future__ import annotations

from .fill_in_middle import SENTINELS

_SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = f"""with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
 l as (select rid, doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from d),
 k as (select *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') as key from l),
 owner as (select key, min(doc_id) as doc_id from k where length(key) >= 10 group by key),
 judged as (select k.*, o.key is not null and k.doc_id is distinct from o.doc_id as gone from k left join owner o on k.key = o.key)
 select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from judged group by rid, doc_id"""

_p, _s, _m = (f"'{x}'" for x in SENTINELS)

FILL = f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
 u as (select *, string_split(t, chr(10)) as ls, length(t) - length(replace(t, chr(10), '')) + case when t = '' or right(t, 1) = chr(10) then 0 else 1 end as n,
  ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
 r as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as z,
  case when t = '' or contains(t, {_p}) or contains(t, {_s}) or contains(t, {_m}) or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
 c as (select *, case when a >= n then length(t) else coalesce(list_sum(list_transform(ls[1:a], lambda x: length(x) + 1)), 0) end::bigint as i, case when z >= n then length(t) else coalesce(list_sum(list_transform(ls[1:z], lambda x: length(x) + 1)), 0) end::bigint as j from r),
 o as (select *, t[1:i] as prefix, t[i + 1:j] as middle, t[j + 1:] as suffix from c),
 w as (select *, case form when 'plain' then t when 'spm' then {_s} || suffix || {_p} || prefix || {_m} || middle else {_p} || prefix || {_s} || suffix || {_m} || middle end as output,
  prefix || middle || suffix as restored from o)
 select doc_id, n::bigint as n, form, case when form <> 'plain' then i end as prefix_chars, case when form <> 'plain' then j - i end as middle_chars, sha256(output) as output_sha256, sha256(restored) as restored_sha256 from w"""


def _nearest(name: str, books: str) -> str:
    """The nearest entry of each part: squared distances of all its entries, then the least (distance, index)."""
    return f"""
 {name}_far as (select x.rid, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) as d from x join {books} b on b.part = x.part and b.c = x.c group by all),
 {name} as (select rid, part, min(d) as d, arg_min(entry, d * 1000 + entry) as entry from {name}_far group by all)"""


def _moved(name: str, near: str, books: str) -> str:
    """Entries as the floored means of their parts; unused ones stay. // truncates, so a negative remainder takes one off."""
    return f"""
 {name} as (select b.part, b.entry, b.c, case when m.n is null then b.v else (m.s - (m.s % m.n + m.n) % m.n) // m.n end as v from {books} b
  left join (select x.part, a.entry, x.c, sum(x.v)::bigint as s, count(*) as n from x join {near} a on a.rid = x.rid and a.part = x.part group by all) m on m.part = b.part and m.entry = b.entry and m.c = b.c)"""


CODES = f"""with e as (select row_number() over (order by vec_id nulls last, embedding) - 1 as rid, * from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
 y as (select rid, len(embedding) // 16 as w, unnest(embedding)::double as f, unnest(range(len(embedding))) as k from e),
 x as (select rid, k // w as part, k % w as c, floor(256 * f)::bigint as v from y),
 b0 as (select part, rid as entry, c, v from x where rid < 64),{_nearest('n1', 'b0')},{_moved('b1', 'n1', 'b0')},{_nearest('n2', 'b1')},{_moved('b2', 'n2', 'b1')},{_nearest('n3', 'b2')},
 coded as (select rid, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from n3 group by rid)
 select e.vec_id, code, error, (sum(error) over (partition by e.label))::bigint as label_error, (select sha256(string_agg(v::varchar, ',' order by part, entry, c)) from b2) as codebooks_sha256 from coded join e using (rid)"""
