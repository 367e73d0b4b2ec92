"""DuckDB SQL with the rows of op2: the same counts, references and verdict, in relational form."""

from __future__ import annotations

from .quality_rules import CLASSES, COMMON_WORDS

_q = lambda s: "'" + s.replace("'", "''") + "'"
_left = lambda c: f"length(rest) - length(regexp_replace(rest, {_q(f'[{CLASSES[c]}]+')}, '', 'g'))"
_CLASS = {"lower": "word_chars - length(rest)", "upper": _left("upper"), "digit": _left("digit"), "space": "chars - word_chars", "mark": _left("mark")}
_LISTED = ", ".join(f"({_q(lang)}, {i}, {_q(w)})" for lang, words in COMMON_WORDS.items() for i, w in enumerate(words))
_term = lambda p, q: f"(case when {p} > 0 then {p} / 2 * log2({p} / (({p} + {q}) / 2)) else 0 end + case when {q} > 0 then {q} / 2 * log2({q} / (({p} + {q}) / 2)) else 0 end)"


def _references(name: str, rows: str) -> str:
    """Per language, shares of classes (kind c) and listed words (kind w) over some rows."""
    return f"""
 {name}_size as (select lang, greatest(sum(chars), 1) as c, greatest(sum(n_words), 1) as w, sum(n_words) as ref_words from base where rid in ({rows}) group by lang),
 {name} as (select n.lang, n.kind, n.k, sum(n.v) / (case n.kind when 'c' then any_value(s.c) else any_value(s.w) end)::double as share, any_value(s.ref_words) as ref_words
  from counts n join {name}_size s on n.lang is not distinct from s.lang where n.rid in ({rows}) group by n.lang, n.kind, n.k)"""


def _diverged(name: str, refs: str, min_chars: int, min_words: int, min_reference_words: int) -> str:
    return f"""
 {name}_terms as (select n.rid, n.kind, sum({_term('n.share', 'r.share')}) as js, greatest(0, 1 - sum(n.share)) as p, greatest(0, 1 - sum(r.share)) as q
  from counts n join {refs} r on n.lang is not distinct from r.lang and n.kind = r.kind and n.k = r.k where r.ref_words >= {min_reference_words} group by n.rid, n.kind),
 {name} as (select b.*, case when b.chars >= {min_chars} then round(c.js + {_term('c.p', 'c.q')}, 6) end as char_js, case when b.n_words >= {min_words} then round(w.js + {_term('w.p', 'w.q')}, 6) end as word_js
  from base b left join {name}_terms c on c.rid = b.rid and c.kind = 'c' left join {name}_terms w on w.rid = b.rid and w.kind = 'w')"""


def quality_sql(max_char_js: float = 0.025, max_word_js: float = 0.085, min_chars: int = 200, min_words: int = 100, min_reference_words: int = 1000) -> str:
    fits = lambda x: f"coalesce(char_js, 0) <= {x} * {max_char_js} * (1 + 600 / greatest(chars, 1)::double) and coalesce(word_js, 0) <= {x} * {max_word_js}"
    guards = (min_chars, min_words, min_reference_words)
    sound = "select rid from base where not base_failed"
    return rf"""with texts as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
 split as (select *, [x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> ''] as ws, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ls, regexp_replace(t, '[{CLASSES['lower']}{CLASSES['space']}]+', '', 'g') as rest from texts),
 windows as (select rid, unnest(range(1, len(ws) - 1)) as i, unnest([ws[i] || chr(31) || ws[i + 1] || chr(31) || ws[i + 2] for i in range(1, len(ws) - 1)]) as k from split),
 again as (select rid, i from windows qualify count(*) over (partition by rid, k) > 1),
 repeated as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from again) group by rid),
 sized as (select s.*, length(t)::bigint as chars, len(ws)::bigint as n_words, coalesce(list_sum([length(x) for x in ws]), 0)::bigint as word_chars, coalesce(r.n, 0)::bigint as n_repeat_words from split s left join repeated r using (rid)),
 base as (select rid, doc_id, lang, ws, chars, n_words, word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {', '.join(f'({sql})::bigint as c_{c}' for c, sql in _CLASS.items())} from sized),
 listed(lang, k, word) as (values {_LISTED}),
 found as (select rid, lang, lower(w) as word, count(*) as v from (select rid, lang, unnest(ws) as w from base) group by all),
 counts as (select b.rid, b.lang, 'c' as kind, u.k, u.v, u.v / greatest(b.chars, 1)::double as share from base b, lateral (select unnest(range({len(CLASSES)})) as k, unnest([{', '.join(f'b.c_{c}' for c in CLASSES)}]) as v) u
  union all select b.rid, b.lang, 'w', l.k, coalesce(f.v, 0), coalesce(f.v, 0) / greatest(b.n_words, 1)::double from base b join listed l on b.lang = l.lang left join found f on f.rid = b.rid and f.word = l.word),
 {_references('first_refs', sound)},{_diverged('first_js', 'first_refs', *guards)},
 {_references('refs', f'select rid from first_js where not base_failed and {fits(2)}')},{_diverged('js', 'refs', *guards)}
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_js, word_js, not base_failed and {fits(1)} as kept from js"""
