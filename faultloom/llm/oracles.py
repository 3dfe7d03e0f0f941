"""DuckDB SQL for the operators that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
with w as (select row_number() over () as row, doc_id, coalesce({WORDS.format(LOWER.format("text"))}, []) as ws from documents),
iw as (select item_id, {WORDS.format(LOWER.format("text"))} as ws from benchmark where text is not null),
win as (
  select distinct item_id, width, array_to_string(ws[s + 1:s + width], ' ') as win
  from (select item_id, ws, least(10, len(ws)) as width, unnest(range(len(ws) - least(10, len(ws)) + 1)) as s
        from iw where len(ws) > 0)),
widths as (select distinct width from win),
places as (
  select row, width, s, array_to_string(ws[s + 1:s + width], ' ') as win
  from (select row, ws, width, unnest(range(len(ws) - width + 1)) as s from w, widths where len(ws) >= width)),
found as (select row, s, p.width, item_id from places p join win using (width, win)),
hits as (select row, count(distinct pos) as n_hit from (select row, unnest(range(s, s + width)) as pos from found) group by row),
items as (select row, list_sort(list(distinct item_id::varchar)) as ids from found group by row)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hits using (row) left join items using (row)
"""

WARC = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
top as (select payload, max(page_id) as top from p where octet_length(payload) >= 1000 group by payload)
select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as payload_digest,
  case when page_id < top then 'revisit' else 'response' end as record_type,
  case when page_id < top then top end as refers_to
from p left join top using (payload)
"""

# The 256 table entries of CRC-32, and its steps over the bytes of a text.
CRC_STEPS = """
steps as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b::bigint, range(8)::bigint[]),
  lambda a, i: xor(a >> 1, case when a % 2 = 1 then 3988292384 else 0 end))) as steps)
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, given a row of ``steps``."""
    bytes_of = f"list_transform(range(strlen({text})), lambda i: ('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2])::bigint)"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {bytes_of}),"
        " lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295)"
    )


SPELLING = f"""
with recursive {CRC_STEPS.strip()},
runs as (select doc_id, run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents)
  group by all),
hashed as (select run, n, {crc32_sql("(coalesce(doc_id::varchar, '') || ':' || run)")} as h from runs, steps),
words as (select word, sum(n)::bigint as n
  from (select n, case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word from hashed)
  where length(word) >= 6 group by word having sum(n) >= 5),
cuts as (select word, n, i, word[:i] || word[i + 2:] as rest from (select *, unnest(range(length(word))) as i from words)),
near as (
  select a.word, b.word as other, b.n from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cuts a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, max(n) as n from near group by word),
tops as (select b.word, n_near, b.n as form_n, min(other) as form from best b join near using (word, n) group by all),
held as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near,
  case when form_n >= 5 * w.n then form end as form, case when form_n >= 5 * w.n then form_n end::bigint as form_n
  from words w left join tops using (word)),
chain as (select word, coalesce(form, word) as root, form is null as done from held
  union all select c.word, coalesce(h.form, c.root), h.form is null from chain c join held h on h.word = c.root where not done)
select h.word, form, c.root, h.n, n_near, form_n from held h join chain c on c.word = h.word and c.done
"""

IMPORTANCE = f"""
with {CRC_STEPS.strip()},
docs as (select row_number() over () as row, doc_id, coalesce({WORDS.format(LOWER.format("text"))}, []) as ws from documents),
items as (select coalesce({WORDS.format(LOWER.format("text"))}, []) as ws from benchmark),
of_docs as (select row, unnest(ws) as w from docs),
of_items as (select unnest(ws) as w from items),
vocabulary as (select w, {crc32_sql("w")} % 10000 as bucket
  from (select w from of_docs union select w from of_items), steps),
source as (select bucket, count(*) as s from of_docs join vocabulary using (w) group by bucket),
target as (select bucket, count(*) as t from of_items join vocabulary using (w) group by bucket),
totals as (select (select coalesce(sum(s), 0) from source)::double as s_all, (select coalesce(sum(t), 0) from target)::double as t_all),
gains as (select w, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000) / ((coalesce(s, 0) + 1)::double * (t_all + 10000))))::bigint as gain
  from vocabulary left join source using (bucket) left join target using (bucket), totals),
weights as (select row, sum(gain)::bigint as weight from of_docs join gains using (w) group by row),
scored as (
  select row, doc_id, len(ws)::bigint as n_features, coalesce(weight, 0)::bigint as weight, coalesce(weight, 0)::bigint
    + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
  from docs left join weights using (row)),
places as (select row, row_number() over (order by score desc, doc_id nulls last, row) as rank, count(*) over () as n
  from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end::bigint as rank
from scored left join places using (row)
"""

ORACLES = {
    "op2_warc": WARC,
    "op4_decontaminate": DECONTAMINATE,
    "op11_importance": IMPORTANCE,
    "op13_spelling": SPELLING,
}
