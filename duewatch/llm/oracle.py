"""DuckDB SQL over the same tables for the operators that SQL can express."""

from __future__ import annotations

#: Words are runs of bytes that are no ASCII white space; only A-Z are lower-cased.
JACCARD = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) >= 5
    then list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from words),
tokens as (select doc_id, unnest(s) as token from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from tokens a join tokens b on a.token = b.token and a.doc_id < b.doc_id group by all),
links as (
  select a, b from pairs join sets x on x.doc_id = a join sets y on y.doc_id = b
  where 100 * shared >= 80 * (len(x.s) + len(y.s) - shared)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id, doc_id as other from sets
  union select r.doc_id, l.b from reach r join both_ways l on l.a = r.other)
select s.doc_id, len(s.s) as n_shingles, min(r.other) as component_id
from sets s join reach r on r.doc_id = s.doc_id group by s.doc_id, s.s
"""

#: The rules and the host verdicts; the host of a document is its source.
QUALITY = r"""
with texts as (
  select row_number() over () as row, doc_id, source, coalesce(text, '') as text from documents),
words as (
  select row, doc_id, source, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from texts),
windows as (
  select row, i, array_to_string(w[i:i+2], ' ') as three
  from words, unnest(case when len(w) >= 3 then generate_series(1, len(w) - 2) else [] end) as t(i)),
inside as (
  select distinct row, unnest([i, i + 1, i + 2]) as place
  from (select row, i, count(*) over (partition by row, three) as found from windows) where found >= 2),
repeats as (select row, count(*) as n from inside group by row),
measures as (
  select words.row, doc_id, source, len(w) as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(repeats.n, 0) as n_repeat_words
  from words left join repeats on repeats.row = words.row),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measures),
hosts as (
  select source, count(*) as n, count(*) filter (base_failed) as f from judged group by source),
sums as (
  select count(*) as h, sum(n) as n, sum(f) / sum(n) as mean, sum(f * f / n) / sum(n) as square from hosts),
spread as (
  select mean, mean * (1 - mean) as noise, square - mean * mean - mean * (1 - mean) * h / n as between_hosts from sums),
prior as (
  select mean, case when between_hosts > 0 then least(greatest(noise / between_hosts - 1, 1.0), 1e6)
    when noise > 0 then 1e6 else 1.0 end as strength from spread),
rates as (
  select source, (f + mean * strength) / (n + strength) as rate from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rate <= 0.5 as kept
from judged join rates on judged.source is not distinct from rates.source
"""

#: What is read back equals what went in; the formatted length follows from the marks and the escapes.
CHAT = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (
  select *, length(regexp_replace(replace(text, '\', '\\'),
    '(<s>|</s>|\[INST\]|\[/INST\]|\[TURN:|\[/TURN\])', '_\1', 'g')) as chars
  from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  3 + sum(chars + case role when 'user' then 15 when 'assistant' then 5 else 16 + length(role) end)::bigint
    as formatted_chars
from sized group by conv_id
"""

#: The drawn list history, its intervals, and for each capture the entries that cover it and were active.
URL_FILTERS = r"""
with captures as (
  select page_id, url, date '2024-01-01' + (('0x' || substr(md5(url), 1, 6))::int % 366)::int as fetched,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''),
      ':[0-9]*$', '')) as host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)', 2) as bare_path
  from pages),
hosts as (
  select host, ('0x' || substr(md5(host), 1, 6))::int as draw from (select distinct host from captures where host <> '')),
entries as (
  select 'block' as list, 'domain' as kind, host as value, 'add' as action, draw % 200 as moment from hosts where draw % 3 = 0
  union select 'block', 'domain', host, 'remove', draw % 200 + 30 + draw % 50 from hosts where draw % 3 = 0
  union select 'block', 'domain', host, 'add', draw % 200 + 120 from hosts where draw % 6 = 0
  union select 'block', 'path', host || '/en/', 'add', draw % 300 from hosts where draw % 4 = 1
  union select 'allow', 'domain', host, 'add', draw % 100 + 60 from hosts where draw % 5 = 0
  union select 'allow', 'domain', host, 'remove', draw % 100 + 150 from hosts where draw % 5 = 0),
dated as (
  select *, lead(moment) over (partition by list, kind, value order by moment, action) as until from entries),
intervals as (
  select list, kind, value, date '2024-01-01' + moment::int as since, date '2024-01-01' + until::int as until
  from dated where action = 'add' and (until is null or until > moment)),
active as (
  select c.page_id, c.url, c.fetched, i.list, i.value
  from captures c join intervals i
    on (i.kind = 'domain' and (c.host = i.value or ends_with(c.host, '.' || i.value))
      or i.kind = 'path' and c.host <> '' and (
        c.host || case when c.bare_path = '' then '/' else c.bare_path end = i.value
        or ends_with(i.value, '/') and starts_with(c.host || c.bare_path, i.value)))
    and i.since <= c.fetched and (i.until is null or c.fetched < i.until)),
found as (
  select page_id, url, fetched, count(*) filter (list = 'block') as n_block, count(*) filter (list = 'allow') as n_allow,
    max({'allow': list = 'allow', 'size': length(value), 'value': value}).value as rule
  from active group by all)
select c.page_id, c.url, c.fetched::timestamp as fetched, count(*) as captures,
  coalesce(any_value(n_block), 0) as n_block, coalesce(any_value(n_allow), 0) as n_allow, any_value(rule) as rule,
  coalesce(any_value(n_block), 0) > 0 and coalesce(any_value(n_allow), 0) = 0 as blocked
from captures c left join found f on f.page_id = c.page_id and f.url = c.url and f.fetched = c.fetched
group by c.page_id, c.url, c.fetched
"""

#: Digests as base 32 are spelled from the hex digest, five bits a letter.
WARC = r"""
with hashed as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
bits as (
  select page_id, html, hex, array_to_string(list_transform(range(1, 41),
    lambda i: right(bin(('0x' || hex[i])::int + 16), 4)), '') as bits from hashed),
digests as (
  select page_id, strlen(html) as payload_bytes, array_to_string(list_transform(range(0, 32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0b' || substr(bits, (5 * i + 1)::int, 5))::int + 1)::int, 1)), '')
    as payload_digest from bits),
first as (select payload_digest, min(page_id) as page_id from digests group by all)
select d.page_id, payload_bytes, d.payload_digest,
  case when d.page_id = f.page_id then 'response' else 'revisit' end as record_type,
  case when d.page_id <> f.page_id then f.page_id end as refers_to
from digests d join first f on f.payload_digest = d.payload_digest
"""

#: The checksum's table of 256 entries is built by its rule; its polynomial and start are fixed values.
SPELLING = r"""
with recursive crc_table as (
  select list_transform(range(256), lambda i: list_reduce(
    list_prepend(i, [1, 1, 1, 1, 1, 1, 1, 1]::bigint[]),
    lambda x, step: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as t
), found as (
  select cast(doc_id as bigint) as doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as raw from documents
), runs as (
  select doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from found group by all
), long_runs as (
  select *, concat(cast(doc_id as varchar), ':', run) as marked from runs where length(run) >= 6
), hashed as (
  select run, doc_id, n, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(marked, ''), lambda c:
      case when unicode(c) < 128 then [unicode(c)::bigint] else [192 + (unicode(c) >> 6)::bigint, 128 + (unicode(c) & 63)::bigint] end))),
    lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) as h
  from long_runs, crc_table
), counted as (
  select case when doc_id is not null and h % 199 = 0
      then concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) else run end as word, sum(n)::bigint as n
  from hashed group by all
), words as (
  select word, n from counted where length(word) >= 6 and n >= 5
), shorter as (
  select distinct word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), near as (
  select a.word, b.word as other, b.n as other_n from shorter a join shorter b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union
  select s.word, w.word, w.n from shorter s join words w on s.rest = w.word
  union
  select w.word, s.word, s.n from shorter s join words w on s.rest = w.word
), best as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word
), forms as (
  select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near, case when b.other_n >= 5 * w.n then b.other end as form,
    case when b.other_n >= 5 * w.n then b.other_n end as form_n
  from words w left join best b on b.word = w.word
), path as (
  select word, word as place, 0 as steps from forms
  union all
  select p.word, f.form, p.steps + 1 from path p join forms f on f.word = p.place where f.form is not null
), ends as (
  select word, arg_max(place, steps) as root from path group by word
)
select f.word, f.form, e.root, f.n, f.n_near, f.form_n::bigint as form_n from forms f join ends e on e.word = f.word
"""


ORACLE: dict[str, str] = {
    "op3_chat_formatting": CHAT,
    "op6_quality_rules": QUALITY,
    "op5_url_filters": URL_FILTERS,
    "op8_jaccard_join": JACCARD,
    "op10_warc": WARC,
    "op11_spelling_variants": SPELLING,
}
