"""What DuckDB can say of an operator's whole result.

Token ids, 64-bit hashes with a seed, tilts that solve equations, learned parts and positions of
matches are beyond it; those queries are held against brute force in tests/llm."""

from __future__ import annotations

# The white space of the contracts, and words between it.
SPACE = r"[^\x20\x09-\x0D]"
WORDS = rf"regexp_extract_all(coalesce(text, ''), '{SPACE}+')"

PHRASES = f"""
with d as (select row_number() over () as rid, doc_id, {WORDS} as w from documents),
win as (select rid, doc_id, i, array_to_string(w[i:i + 12], ' ') as x
        from (select rid, doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
least as (select x, min(doc_id) as m from win group by x),
gone as (select rid, i from win join least using (x) where m < doc_id),
covered as (select distinct rid, i + k as p from gone, range(13) r(k)),
words as (select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select rid, count(*) as n, string_agg(word, ' ' order by p) as t
         from words anti join covered using (rid, p) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (rid)"""

QUALITY = rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, {WORDS} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{SPACE}')) as lines
  from documents),
win as (select rid, i, array_to_string(w[i:i + 7], ' ') as x
        from (select rid, w, unnest(range(1, len(w) - 6)) as i from d)),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, x) as c from win) where c > 1),
covered as (select rid, count(distinct i + k) as n from again, range(8) r(k) group by rid),
counted as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
    len(lines) as n_lines, len(list_filter(w, lambda x: not regexp_matches(x, '\p{{L}}'))) as letterless,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') and not regexp_matches(x, '\p{{Ll}}'))) as shouted
  from d left join covered using (rid)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (100 * n_symbols > 10 * n_words or word_chars < 2 * n_words or word_chars > 12 * n_words
    or 100 * n_dup_lines > 50 * n_lines or 100 * letterless > 30 * n_words or 100 * shouted > 30 * n_words) as kept
from judged"""

# What separates the words of the contract.
APART = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LEAKS = f"""
with items as (select item_id, regexp_extract_all({LOWER}, '{APART}') as w from benchmark),
wanted as (
  select distinct item_id, least(len(w), 10) as size,
    array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as x
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
d as (select row_number() over () as rid, doc_id, regexp_extract_all({LOWER}, '{APART}') as w from documents),
win as (
  select rid, size, i, array_to_string(w[i:i + size - 1], ' ') as x
  from (select rid, size, w, unnest(range(1, len(w) - size + 2)) as i
        from d, (select distinct size from wanted) where len(w) >= size)),
found as (select rid, size, i, item_id from win join wanted using (size, x)),
hit as (select rid, count(distinct i + k) as n from (select distinct rid, size, i from found), range(10) r(k) where k < size group by rid),
named as (select rid, count(distinct item_id) as n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as t
          from found group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items,
  sha256(coalesce(t, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (rid) left join named using (rid)"""

NEGATIVES = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as hugeint)) as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id,
  cast(row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as integer) as rank,
  s.vec_id as negative_id, cast(p.score as bigint) as positive_score, cast(s.score as bigint) as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same
  and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
qualify row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) <= 5"""

ORACLE_SQL = {"op13_hard_negatives": NEGATIVES, "op11_decontamination": LEAKS, "op3_phrase_dedup": PHRASES, "op6_quality_cascade": QUALITY}
