"""DuckDB SQL for the queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {}

SQL["op10_exact_dedup"] = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
    as text_sha256
  from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256
from d join g using (text_sha256)
"""

SQL["op1_warc"] = """
with p as (select page_id, url, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
d as (
  select page_id, url, strlen(body) as payload_bytes,
         array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31), 1)), '')
           as payload_digest
  from p),
g as (select payload_digest, min(page_id) as first from d group by 1)
select page_id, payload_bytes, payload_digest,
       case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from first then first end as refers_to,
       regexp_replace(url, '[\\x00-\\x20\\x7F]', '%20', 'g') as url
from d join g using (payload_digest)
"""

SQL["op2_near_dedup"] = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
sh as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
                                 else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as s from d),
n as (select doc_id, count(*) as n from sh group by 1),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id
  group by 1, 2),
links as (
  select a, b from common join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
sym as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as r from d union select reach.doc_id, b from reach join sym on r = a)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n using (doc_id) join (select doc_id, min(r) as component_id from reach group by 1) using (doc_id)
"""

# levenshtein() counts bytes, so characters are numbered first; right for tables of up to 127 different ones.
# Rows of pairs are held down by the lengths and by the numbers of five characters, of which an edit changes two by one.
SQL["op3_line_dedup"] = rf"""
with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
l as (
  select * from (select doc_id, unnest(range(len(lines))) as no, unnest(lines) as line from d)
  where regexp_matches(line, '{_WORD}')),
u as (select line, min(row(doc_id, no)) as pos, length(line) as n from l group by line),
chars as (
  select string_agg(c, '' order by c) as c, string_agg(chr(i::int), '' order by c) as code
  from (select c, row_number() over (order by c) as i
        from (select distinct unnest(string_split(line, '')) as c from u))),
coded as (
  select pos, n, translate(line, chars.c, chars.code) as x, least(2, n // 20) as edits,
         n - length(replace(line, 'e', '')) as e, n - length(replace(line, ' ', '')) as s,
         n - length(replace(line, 'n', '')) as k, n - length(replace(line, 'a', '')) as q,
         n - length(replace(line, 't', '')) as t
  from u, chars where n >= 20),
asked as (select *, unnest(range(edits + 1)) as more from coded),
met as materialized (
  select a.x as x, b.x as y, a.edits as edits, greatest(a.pos, b.pos) as pos
  from asked a join coded b on b.n = a.n + a.more
  where a.pos <> b.pos and (a.more > 0 or a.pos < b.pos)
    and abs(a.e - b.e) + abs(a.s - b.s) + abs(a.k - b.k) + abs(a.q - b.q) + abs(a.t - b.t) <= 2 * a.edits),
close as (select pos from met where levenshtein(x, y) <= edits),
gone as (
  select doc_id, no from l join u using (line) where row(doc_id, no) <> pos or row(doc_id, no) in (select pos from close)),
every as (select doc_id, unnest(range(len(lines))) as no, unnest(lines) as line from d),
kept as (
  select doc_id, count(*) as n, string_agg(line, chr(10) order by no) as text
  from every anti join gone using (doc_id, no) group by doc_id)
select doc_id, coalesce(len(lines), 0) as n_lines, coalesce(len(lines), 0) - coalesce(n, 0) as n_removed,
       sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (doc_id)
"""

SQL["op6_mixture"] = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as size,
         md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as key
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from d group by source),
levels as (
  select *, 3.0::double * source_size / weight as full_at,
         coalesce(sum(source_size) over w, 0) as stopped, coalesce(sum(weight) over w, 0) as gone
  from s window w as (order by source_size::double / weight, source nulls last
                      rows between unbounded preceding and 1 preceding)),
total as (select sum(source_size) as words, sum(weight) as weights from s),
per as (
  select (words - 3 * stopped)::bigint as num, (weights - gone)::bigint as den
  from levels, total
  where (words - 3 * stopped)::double <= full_at * (weights - gone)
  order by stopped, gone limit 1),
t as (
  select source, source_size,
         case when weight * num > 3 * source_size * den then (3 * source_size)::double
              else (weight * num)::double / den::double end as target
  from s, per),
p as (
  select doc_id, size, source_size, target, round(target)::bigint as budget,
         coalesce(sum(size) over (partition by d.source order by key, size
                                  rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from p)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::bigint as taken
from e
"""

SQL["op7_quality_cascade"] = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
a as (
  select doc_id, text, regexp_extract_all(text, '{_WORD}') as words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from d),
wins as (
  select doc_id, unnest(range(1, greatest(len(words) - 7, 0) + 1)) as i,
         unnest(list_transform(range(1, greatest(len(words) - 7, 0) + 1), lambda k: words[k:k + 7])) as win from a),
twice as (select doc_id, i, count(*) over (partition by doc_id, win) as n from wins),
covered as (
  select doc_id, count(distinct i + k) as n_repeat_words
  from twice, range(8) as r(k) where n > 1 group by doc_id),
m as (
  select doc_id, len(words) as n_words, len(lines) as n_lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) as n_letter_words,
         coalesce(n_repeat_words, 0) as n_repeat_words
  from a left join covered using (doc_id)),
v as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed
       and not (word_chars < 2 * n_words or word_chars > 20 * n_words)
       and not 10 * n_symbols > 3 * n_words
       and not (n_dup_lines >= 2 and 10 * n_dup_lines > 3 * n_lines)
       and not 2 * n_letter_words < n_words as kept
from v
"""

SQL["op8_substring_dedup"] = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
words as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
wins as (
  select doc_id, unnest(range(1, len(w) - 33)) as i,
         unnest(list_transform(range(1, len(w) - 33), lambda k: w[k:k + 34])) as win from d where len(w) >= 35),
twice as (select doc_id, i from wins qualify count(*) over (partition by win) > 1),
gone as (select distinct doc_id, i + k as i from twice, range(35) as r(k)),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by i) as text
  from words anti join gone using (doc_id, i) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (doc_id)
"""
