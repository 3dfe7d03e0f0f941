"""Checking SQL for the registered queries, written for a plain SQL engine (RE2 patterns)."""

from __future__ import annotations

import json

from ..functions.prompts import DETECTION_PROMPTS, RENAME_PROMPT
from ..functions.labels import NO_MODIFICATIONS
from ..functions.words import RESERVED
from .views import CODE_TAIL, PROPOSALS, RENAME_JSON, TAIL_EDITS, WITHOUT_PAIRS, cte

SEED = 7

# The patterns of the column functions in the checking engine's dialect.
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
TOKEN_OR_GAP = "[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+"
BASED = "[0-9]*''[sS]?[bBoOdDhH][0-9a-fA-FxXzZ_?]+"
STRING = r"""\"(?:\\[\s\S]|[^\"\\])*\""""
CODE_TOKEN = f"{STRING}|{BASED}|[A-Za-z0-9_$]+|[^A-Za-z0-9_$]"
KINDED = r"/\*[\s\S]*?\*/|//[^\n]*\n?|\"(?:\\[^\n]|[^\"\\])*\"|''(?:\\[^\n]|[^''\\])*''".replace(r"\"", '"')
PLAIN = r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\[\s\S]|[^\"\\])*\"|''(?:\\[\s\S]|[^''\\])*''".replace(r"\"", '"')
MODULE = (
    r"(?is:\b(module|interface|program|package)\b\s+([A-Za-z_]\w*)\b(.*?)"
    r"(\bendmodule\b|\bendinterface\b|\bendprogram\b|\bendpackage\b))"
)
CHUNK_KINDS = [
    ("generate", r"(?is:\bgenerate\b.*?\bendgenerate\b)"),
    ("param", r"(?is:\b(?:parameter|localparam)\b[^;]*?;)"),
    ("typedef", r"(?is:\b(?:typedef)\b.*?;)"),
    ("decl", r"(?is:\b(?:wire|reg|logic|bit|byte|int|shortint|longint)\b[^;]*?;)"),
    ("assign", r"(?is:\bassign\b[^;]*?;)"),
    ("always", r"(?is:\b(?:always|initial)\b.*?(?:end\b|;))"),
    ("func", r"(?is:\b(?:function|task)\b.*?\bend(?:function|task)\b)"),
    ("inst", r"(?m:^[ \t]*[A-Za-z_]\w*[ \t]+\w+[ \t]*\([^;{)]*?\)\s*;)"),
]
CHUNK = "|".join(pattern for _, pattern in CHUNK_KINDS)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def lines_of(text: str) -> str:
    parts = f"regexp_split_to_array({text}, '{BREAK}')"
    return f"case when {parts}[-1] = '' then {parts}[:-2] else {parts} end"


# --- evaluation -------------------------------------------------------------------------------

LABELLED = (
    cte("reviews")
    + """, labelled as (
  select *, split_part(input_file_rel_path, '/', 1) as challenge_id,
         case when regexp_matches(input_file_rel_path, '/buggy.') then 'contains_bug'
              when regexp_matches(input_file_rel_path, '/base.') then 'no_bug'
              else 'unknown' end as expected_detection_result,
         case when contains(llm_response, 'No modifications detected') then 'no_bug'
              when length(llm_response) < 20 then 'response_very_short'
              when not contains(llm_response, '```') then 'response_contains_no_code_block'
              else 'contains_bug' end as actual_detection_result
  from reviews)
"""
)


def pct(value: str) -> str:
    return f"round_even({value} * 100.0::double, 0) / 100.0::double"


def share(part: str, whole: str, factor: str = "") -> str:
    return f"({part}::double / {whole}::double * 100.0::double{factor})"


BY_CHALLENGE = f"""{LABELLED}, counts as (
  select challenge_id, count(*) as total_llm_prompts,
         count(*) filter (expected_detection_result = actual_detection_result) as correct_overall,
         count(*) filter (expected_detection_result = 'contains_bug' and actual_detection_result = 'contains_bug')
           as correctly_detected_bug,
         count(*) filter (expected_detection_result = 'no_bug' and actual_detection_result = 'no_bug')
           as correctly_detected_no_bug
  from labelled group by challenge_id)
select *, {pct(share("correct_overall", "total_llm_prompts"))} as correct_overall_pct,
       {pct(share("correctly_detected_bug", "total_llm_prompts", " * 2.0::double"))} as correctly_detected_bug_pct,
       {pct(share("correctly_detected_no_bug", "total_llm_prompts", " * 2.0::double"))} as correctly_detected_no_bug_pct
from counts order by challenge_id"""


def matrix(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    over = f"partition by {by}" if by else ""
    return f"""{LABELLED}, counts as (
  select {keys}expected_detection_result, actual_detection_result, count(*) as count
  from labelled group by all)
select *, {pct(share("count", f"(sum(count) over ({over}))"))} as percent from counts"""


# --- renaming ---------------------------------------------------------------------------------

def judged(head: str, pairs: str) -> str:
    return f"""{head}, vocabulary as (
  select doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z0-9_$]+')) as names from documents),
own as (
  select m.*, case when old_name like '\\_\\_OBFUSCATE\\_MASK\\_%' escape '\\' then 'mask_token'
                   when not regexp_full_match(old_name, '[A-Za-z0-9_$]+') then 'unsupported_key'
                   when not list_contains(v.names, old_name) then 'absent'
                   when not regexp_full_match(new_name, '[A-Za-z_][A-Za-z0-9_$]*') then 'invalid_new_name'
              end as own_reason
  from {pairs} m join vocabulary v using (doc_id)),
judged as (
  select doc_id, ord::bigint as ord, old_name, new_name,
         coalesce(own_reason,
           case when row_number() over (partition by doc_id, new_name, own_reason is null order by ord) > 1
                then 'collision' end,
           case when old_name in ({", ".join(quoted(w) for w in RESERVED)}) or regexp_full_match(old_name, '\\p{{Nd}}+')
                then 'not_candidate' end) as reason
  from own)"""

def _pair_rows() -> str:
    """``values`` of kind, place, names and type of the pairs in the answers; kind 0 is the full mapping."""
    full = [(old, new, True) for old, new in json.loads(RENAME_JSON).items()]
    rows = [(k, n, *p) for k, pairs in ({0: full} | PROPOSALS).items() for n, p in enumerate(pairs)]
    return ", ".join(f"({k}, {n}, {quoted(old)}, {quoted(new)}, {text})" for k, n, old, new, text in rows)


ODD_ANSWERS = ", ".join(map(str, [*PROPOSALS, *WITHOUT_PAIRS]))
JUDGED = judged(cte("mappings"), "mappings")
JUDGED_ANSWERS = judged(
    f"""with proposals as (
  select doc_id, e.ord, e.old_name, e.new_name, e.is_text from documents d
  join (values {_pair_rows()}) as e(kind, ord, old_name, new_name, is_text)
    on e.kind = case when doc_id % 13 in ({ODD_ANSWERS}) then doc_id % 13 else 0 end)""",
    "proposals",
)


def renamed(judged_rows: str) -> str:
    return f"""{judged_rows}, pieces as (
  select doc_id, unnest(regexp_extract_all(text, '{TOKEN_OR_GAP}')) as piece,
         unnest(range(len(regexp_extract_all(text, '{TOKEN_OR_GAP}')))) as pos
  from documents),
renamed as (
  select p.doc_id, string_agg(coalesce(j.new_name, p.piece), '' order by p.pos) as text
  from pieces p left join judged j on j.doc_id = p.doc_id and j.old_name = p.piece and j.reason is null
  group by p.doc_id)"""

def outputs(judged_rows: str, failed: str) -> str:
    return f"""{renamed(judged_rows)}, outputs as (
  select doc_id, gold, case when status = 'succeeded' then renamed else gold end as renamed, status, status = 'succeeded' as mapped
  from (
    select d.doc_id, d.text as gold, coalesce(r.text, d.text) as renamed,
           case when d.doc_id in ({failed}) then 'failed'
                when exists (select 1 from judged j where j.doc_id = d.doc_id and j.reason is null) then 'succeeded'
                else 'no_usable_mapping' end as status
    from documents d left join renamed r using (doc_id)))"""


ALL_RENAMED = outputs(JUDGED, "select null")
LONG_ENTRIES = f"""{cte("long_mappings")}, entries as (
  select doc_id, old_name, min(ord) as ord, max_by(new_name, ord) as new_name from long_mappings group by doc_id, old_name)"""
ALL_RENAMED_LONG = outputs(judged(LONG_ENTRIES, "entries"), "select null")
FAILED_ANSWERS = """select doc_id from own where not is_text
  and coalesce(own_reason, '') not in ('mask_token', 'unsupported_key', 'absent')"""
ALL_ANSWERED = outputs(JUDGED_ANSWERS, FAILED_ANSWERS)

# --- masking and chunks -----------------------------------------------------------------------


def masked(text: str, pattern: str, placeholder: str) -> str:
    """Gaps woven with placeholders; ``placeholder`` uses ``h`` (hit) and ``i`` (1-based)."""
    return (
        f"array_to_string(list_transform(regexp_split_to_array({text}, '{pattern}'), lambda g, i: g || "
        f"case when i <= len(regexp_extract_all({text}, '{pattern}')) then "
        f"{placeholder.replace('h.', f'''regexp_extract_all({text}, '{pattern}')[i]''')} else '' end), '')"
    )


KINDED_PLACEHOLDER = (
    "'__OBFUSCATE_MASK_' || case when starts_with(h., '/*') then 'CMT_BLOCK' when starts_with(h., '//') then "
    "'CMT_LINE' when starts_with(h., '\"') then 'STR_DQ' else 'STR_SQ' end || '_' || (i - 1) || '__'"
)
PLAIN_PLACEHOLDER = "'__MSK_' || (i - 1) || '__'"

MODULES = f"""{cte("rtl_docs")}, sources as (
  select doc_id, text, {masked("text", PLAIN, PLAIN_PLACEHOLDER)} as masked,
         regexp_extract_all(text, '{PLAIN}') as hits from rtl_docs),
modules as (
  select doc_id, unnest(range(len(regexp_extract_all(masked, '{MODULE}')))) as module_no,
         unnest(regexp_extract_all(masked, '{MODULE}')) as module_text
  from sources),
named as (
  select doc_id, module_no, regexp_extract(module_text, '{MODULE}', 2) as module_name, module_text from modules)"""

KIND_CASE = " ".join(f"when regexp_matches(piece, '^{pattern}') then '{kind}'" for kind, pattern in CHUNK_KINDS)
CHUNKS = f"""{MODULES}, hits as (
  select doc_id, module_no, module_name, regexp_split_to_array(module_text, '{CHUNK}') as gaps,
         regexp_extract_all(module_text, '{CHUNK}') as found from named),
pieces as (
  select doc_id, module_no, module_name, unnest(gaps) as piece, 2 * unnest(range(len(gaps))) as pos, true as gap
  from hits
  union all
  select doc_id, module_no, module_name, unnest(found), 2 * unnest(range(len(found))) + 1, false from hits),
kinds as (
  select *, case when gap then 'pinned' {KIND_CASE} end as kind,
         row_number() over (partition by doc_id, module_no order by pos) - 1 as chunk_no
  from pieces where piece <> ''),
chunks as (
  select doc_id, module_no, module_name, chunk_no, kind, piece as text, kind in ('pinned', 'generate') as pinned,
         upper(kind) || '_' || lpad(chunk_no::varchar, 6, '0') as chunk_id
  from kinds)"""

BUCKETS = {
    "safe": "kind",
    "medium": """case when kind in ('param', 'typedef', 'decl') then 'types_params_decls'
                      when kind = 'assign' then 'assigns'
                      when kind in ('always', 'func', 'inst') then 'procedural' end""",
    "aggressive": "'aggressive_all'",
}


def placed(level: str) -> str:
    return f"""{CHUNKS}, grouped as (
  select *, case when not pinned then {BUCKETS[level]} end as bucket from chunks),
slots as (
  select *, row_number() over (partition by doc_id, module_no, bucket order by chunk_no) as n from grouped),
draws as (
  select *, row_number() over (partition by doc_id, module_no, bucket
                               order by md5('{SEED}:' || chunk_no), chunk_no) as n
  from grouped where bucket is not null),
placed as (
  select s.doc_id, s.module_no, s.module_name, s.chunk_no as slot, s.bucket, coalesce(d.chunk_no, s.chunk_no) as chunk_no,
         coalesce(d.kind, s.kind) as kind, coalesce(d.text, s.text) as text, coalesce(d.chunk_id, s.chunk_id) as chunk_id
  from slots s left join draws d
    on d.doc_id = s.doc_id and d.module_no = s.module_no and d.bucket = s.bucket and d.n = s.n)"""


def placement(level: str) -> str:
    return f"{placed(level)} select doc_id, module_no, slot, bucket, chunk_no, kind, chunk_id from placed"


def shuffled(level: str) -> str:
    """Texts put together again, and per module name the order of its last module as JSON."""
    first = (
        "min(slot)"
        if level != "medium"
        else "min(case bucket when 'types_params_decls' then 0 when 'assigns' then 1 else 2 end)"
    )
    return f"""{placed(level)}, bodies as (
  select doc_id, module_no, string_agg(text, '' order by slot) as body from placed group by all),
outside as (
  select doc_id, hits, unnest(regexp_split_to_array(masked, '{MODULE}')) as gap,
         unnest(range(len(regexp_split_to_array(masked, '{MODULE}')))) as module_no from sources),
woven as (
  select o.doc_id, any_value(hits) as hits, string_agg(gap || coalesce(body, ''), '' order by o.module_no) as masked
  from outside o left join bodies b on b.doc_id = o.doc_id and b.module_no = o.module_no group by o.doc_id),
numbers as (
  select doc_id, unnest(regexp_split_to_array(masked, '__MSK_[0-9]+__')) as gap,
         unnest(range(1, 1 + len(regexp_split_to_array(masked, '__MSK_[0-9]+__')))) as i,
         regexp_extract_all(masked, '__MSK_([0-9]+)__', 1) as ids, hits from woven),
texts as (
  select doc_id, string_agg(gap || coalesce(hits[ids[i]::int + 1], ''), '' order by i) as text from numbers group by doc_id),
lasts as (
  select doc_id, module_name, max(module_no) as module_no, min(module_no) as first_no from named group by doc_id, module_name),
orders as (
  select doc_id, module_no, bucket, {first} as first,
         '"' || bucket || '":["' || string_agg(chunk_id, '","' order by slot) || '"]' as entry
  from placed where bucket is not null group by doc_id, module_no, bucket),
entries as (
  select l.doc_id, first_no, '"' || module_name || '":{{' || coalesce(string_agg(entry, ',' order by first), '') || '}}' as entry
  from lasts l left join orders o on o.doc_id = l.doc_id and o.module_no = l.module_no group by l.doc_id, first_no, module_name),
maps as (select doc_id, string_agg(entry, ',' order by first_no) as entries from entries group by doc_id)
select doc_id, text, '{{' || coalesce(entries, '') || '}}' as order_json from texts left join maps using (doc_id)"""


# --- snapshots --------------------------------------------------------------------------------

CHANGES = """, versions as (
  select coalesce(b.repo, t.repo) as repo, coalesce(b.branch, t.branch) as branch, coalesce(b.path, t.path) as path,
         b.content as old_content, t.content as new_content,
         case when b.path is null then 'added' when t.path is null then 'deleted' else 'modified' end as change
  from (select * from snapshots where side = 'base') b
  full outer join (select * from snapshots where side = 'tip') t
    on b.repo = t.repo and b.branch = t.branch and b.path = t.path
  where b.content is distinct from t.content),
changes as (
  select repo, branch, path, change from versions v
  where not (change = 'deleted' and exists (
    select 1 from versions a where a.change = 'added' and a.repo = v.repo and a.branch = v.branch
       and a.new_content = v.old_content)))"""
SELECTED = (
    cte("snapshots", "branches", "override_paths")
    + CHANGES
    + """, rules as (
  select repo, branch, min(action) as action, list_sort(list(distinct expected_path)) as expected,
         min(chosen_path) as chosen_path
  from override_paths group by repo, branch),
listed as (
  select repo, branch, count(*) as n, list_sort(list(path)) as paths, min(path) as only_path, min(change) as only_change
  from changes where path <> 'README.md' group by repo, branch),
decided as (
  select b.repo, b.branch, coalesce(l.n, 0) as n_changed,
         case when l.n > 1 and r.action = 'choose' then r.chosen_path else l.only_path end as path,
         case when r.action = 'skip' then 'duplicate_branch'
              when coalesce(l.n, 0) = 0 then 'no_changes'
              when l.n > 1 and r.action = 'choose' then
                case when l.paths = r.expected then 'candidate' else 'override_mismatch' end
              when l.n > 1 then 'multiple_changes'
              else 'candidate' end as step
  from (select distinct repo, branch from branches) b
  left join rules r on r.repo = b.repo and r.branch = b.branch
  left join listed l on l.repo = b.repo and l.branch = b.branch),
final as (
  select d.repo, d.branch, d.n_changed, d.path,
         case when step <> 'candidate' then step
              when not exists (select 1 from snapshots s where s.repo = d.repo and s.branch = d.branch
                               and s.path = d.path and s.side = 'base') then 'missing_at_branch_point'
              when not exists (select 1 from snapshots s where s.repo = d.repo and s.branch = d.branch
                               and s.path = d.path and s.side = 'tip') then 'missing_at_tip'
              else 'processed' end as status
  from decided d),
selected as (
  select repo, branch, n_changed, case when status = 'processed' then path end as source_path, status from final)"""
)


def folder(repo: str, branch: str) -> str:
    return f"{repo} || '_' || replace(replace(replace(replace({branch}, '#', '_'), 'fix_', ''), '()', ''), 'fix-', '')"


def suffix(path: str) -> str:
    return rf"regexp_extract({path}, '[^/](\.[^./]+)$', 1)"


EMITTED = f"""{SELECTED}, emitted as (
  select s.repo, s.branch, {folder("s.repo", "s.branch")} as output_folder,
         case s.side when 'base' then 'buggy' else 'base' end as role,
         case s.side when 'base' then 'buggy' else 'base' end || {suffix("s.path")} as file_name,
         s.path as source_path, s.content
  from snapshots s join selected c
    on c.repo = s.repo and c.branch = s.branch and c.source_path = s.path and c.status = 'processed')"""

# --- prompts ----------------------------------------------------------------------------------


def filled(template: str, content: str) -> str:
    head, tail = template.replace("{NO_MODIFICATIONS_DETECTED_STR}", NO_MODIFICATIONS).split("{content}")
    return f"{quoted(head)} || {content} || {quoted(tail)}"


def rename_prompt(relation: str, key: str = "doc_id", text: str = "text") -> str:
    """Rename prompts with the margin worked out line by line; yields ``key, prompt``."""
    return f"""margins as (
  select {key}, {text} as body, least(4, coalesce(list_min(list_transform(
           list_filter(string_split({text}, chr(10))[2:], lambda l: regexp_matches(l, '[^ \\t]')),
           lambda l: length(regexp_extract(l, '^ *')))), 4)) as margin
  from {relation}),
blanked as (
  select {key}, margin, regexp_replace({filled(RENAME_PROMPT, "body")}, '(?m)^[ \\t]+$', '', 'g') as full_text from margins),
renaming as (
  select {key}, regexp_replace(array_to_string(list_transform(string_split(full_text, chr(10)),
           lambda l: case when starts_with(l, repeat(' ', margin::int)) then substr(l, margin::int + 1) else l end), chr(10)),
           '^{WS}+|{WS}+$', '', 'g') as prompt
  from blanked)"""


V2 = filled(DETECTION_PROMPTS["v2"], "text")

def tail_case() -> str:
    cases = " ".join(
        f"when {n} then {quoted(CODE_TAIL.replace(old, new))}" for n, (old, new) in enumerate(TAIL_EDITS)
    )
    return f"case doc_id % 6 {cases} else {quoted(CODE_TAIL)} end"


def code_of(text: str) -> str:
    """Tokens of a source text: comments are white space, a string is one token."""
    bare = f"regexp_replace({text}, '({STRING})|//[^\\n]*|/\\*[\\s\\S]*?\\*/', '\\1 ', 'g')"
    return f"list_filter(regexp_extract_all({bare}, '{CODE_TOKEN}'), lambda t: not regexp_matches(t, '^{WS}$'))"


NAME_TEST = "regexp_full_match({0}, '[A-Za-z_][A-Za-z0-9_$]*') and {0} not in ({1})"
RENAME_EQUIV = f"""{ALL_ANSWERED}, paired as (
  select doc_id, gold || {quoted(CODE_TAIL)} as gold, renamed || {tail_case()} as gate from outputs),
listed as (select doc_id, {code_of("gold")} as l, {code_of("gate")} as r from paired),
tokens as (select doc_id, len(l) as nl, len(r) as nr, unnest(l) as lt, unnest(r) as rt from listed),
tested as (
  select *, {NAME_TEST.format("lt", ", ".join(quoted(w) for w in RESERVED))} as ln,
         {NAME_TEST.format("rt", ", ".join(quoted(w) for w in RESERVED))} as rn from tokens),
judged_docs as (
  select doc_id, bool_and(nl = nr and coalesce(ln = rn, false) and (ln or lt = rt))
         and count(distinct lt) filter (ln) = count(distinct (lt, rt)) filter (ln)
         and count(distinct rt) filter (ln) = count(distinct (lt, rt)) filter (ln) as same
  from tested group by doc_id)
select b.doc_id, (case when gold = gate or coalesce(same, true) then 0 else 1 end)::bigint as verdict
from paired b left join judged_docs using (doc_id)"""

# --- line matching: the longest common run of a range, then the ranges before and after it, until none is left


def collapsed_lines(text: str) -> str:
    return f"list_transform({lines_of(text)}, lambda l: {collapsed('l')})"


def kept_lines(text: str) -> str:
    none = r"[^\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
    return f"regexp_extract_all({text}, '{none}*(?:{BREAK})|{none}+')"


def matched(lines) -> str:
    """Matching runs, opcodes and the line lists of every pair; no list here is long enough for popular lines."""
    with_recursive = cte("code_pairs").replace("with ", "with recursive ", 1)
    return f"""{with_recursive}, listed as materialized (
  select pair_id, {lines("base_code")} as la, {lines("buggy_code")} as lb from code_pairs),
olds as (select pair_id, unnest(range(len(la))) as i, unnest(la) as line from listed),
news as (select pair_id, unnest(range(len(lb))) as j, unnest(lb) as line from listed),
equal_places as (select pair_id, i, j, i - j as d from olds join news using (pair_id, line)),
numbered as (select *, i - row_number() over (partition by pair_id, d order by i) as island from equal_places),
runs as materialized (
  select pair_id, d, min(i) as i0, max(i) + 1 as i9 from numbered group by pair_id, d, island),
ranges as (
  select pair_id, 0::bigint as alo, len(la)::bigint as ahi, 0::bigint as blo, len(lb)::bigint as bhi,
         null::struct(n bigint, i bigint, j bigint) as best
  from listed
  union all
  select pair_id, side.alo, side.ahi, side.blo, side.bhi, side.best
  from (
    select pair_id, alo, ahi, blo, bhi, max(struct_pack(n := n, i := -i, j := -j)) as best
    from (
      select g.pair_id, alo, ahi, blo, bhi, greatest(i0, alo, blo + d) as i, greatest(i0, alo, blo + d) - d as j,
             least(i9, ahi, bhi + d) - greatest(i0, alo, blo + d) as n
      from ranges g join runs u on u.pair_id = g.pair_id
      where g.best is null and u.i0 < g.ahi and u.i9 > g.alo)
    where n > 0 group by pair_id, alo, ahi, blo, bhi) m,
  lateral (select unnest([
    struct_pack(alo := -m.best.i, ahi := -m.best.i + m.best.n, blo := -m.best.j, bhi := -m.best.j + m.best.n, best := m.best),
    struct_pack(alo := m.alo, ahi := -m.best.i, blo := m.blo, bhi := -m.best.j, best := null),
    struct_pack(alo := -m.best.i + m.best.n, ahi := m.ahi, blo := -m.best.j + m.best.n, bhi := m.bhi, best := null)]) as side)),
found as (select pair_id, alo as i, blo as j, ahi - alo as n from ranges where best is not null),
joined as (
  select *, case when lag(i + n) over w = i and lag(j + n) over w = j then 0 else 1 end as new
  from found window w as (partition by pair_id order by i)),
grouped as (select *, sum(new) over (partition by pair_id order by i) as g from joined),
blocks as (
  select pair_id, min(i) as i, min(j) as j, sum(n)::bigint as n from grouped group by pair_id, g
  union all select pair_id, len(la), len(lb), 0 from listed),
gaps as (
  select *, coalesce(lag(i + n) over w, 0) as pi, coalesce(lag(j + n) over w, 0) as pj
  from blocks window w as (partition by pair_id order by i, j, n desc)),
opcodes as (
  select pair_id, case when pi = i then 'insert' when pj = j then 'delete' else 'replace' end as tag,
         pi as i1, i as i2, pj as j1, j as j2 from gaps where pi < i or pj < j
  union all select pair_id, 'equal', i, i + n, j, j + n from blocks where n > 0)"""


def chunked(lines, normalized: bool) -> str:
    """The changed chunks of every pair, in their order by ``pi, pj``."""
    join = "chr(10)" if normalized else "''"
    trim = "trim({}, chr(10))" if normalized else "{}"
    sides = ", ".join(
        trim.format(f"coalesce(array_to_string({side}[{a} + 1:{b}], {join}), '')") + f" as {name}"
        for side, a, b, name in (("la", "pi", "i", "old_version"), ("lb", "pj", "j", "new_version"))
    )
    differ = "where old_version <> new_version" if normalized else ""
    return f"""{matched(lines)}, separators as (
  select pair_id, i, j, n from blocks where n >= 3 or n = 0),
stretches as (
  select *, coalesce(lag(i + n) over w, 0) as pi, coalesce(lag(j + n) over w, 0) as pj
  from separators window w as (partition by pair_id order by i, j, n desc)),
built as (
  select pair_id, pi, pj, {sides} from stretches join listed using (pair_id) where pi < i or pj < j),
chunks as (
  select pair_id, (row_number() over (partition by pair_id order by pi, pj) - 1)::bigint as chunk_no, old_version, new_version
  from built {differ})"""


def diff_chunks(lines, normalized: bool) -> str:
    return f"{chunked(lines, normalized)} select * from chunks"


def fenced_blocks(key: str, table: str, text: str) -> str:
    """``texts``: the code blocks of each row, white space collapsed."""
    return f"""pieces as (select {key}, {lines_of(text)} as lines from {table}),
rows as (select {key}, unnest(range(len(lines))) as pos, unnest(lines) as line from pieces),
fences as (select {key}, pos, row_number() over (partition by {key} order by pos) - 1 as n
           from rows where regexp_matches(line, '^{WS}*```')),
spans as (select o.{key}, o.n // 2 as block_no, o.pos as opened, c.pos as closed
          from fences o join fences c on c.{key} = o.{key} and c.n = o.n + 1 where o.n % 2 = 0),
texts as (select {key}, block_no, {collapsed("block")} as block from (
  select s.{key}, s.block_no, coalesce(string_agg(r.line, chr(10) order by r.pos), '') as block
  from spans s left join rows r on r.{key} = s.{key} and r.pos > s.opened and r.pos < s.closed
  group by s.{key}, s.block_no))"""


def similarities() -> str:
    """Ratios of all change sides and blocks that meet, by the same splitting of ranges on characters.

    A character that makes up over a hundredth of a long block starts no run, but a run is lengthened through
    such characters on both sides; what is left at the corner without a run is compared from its start.
    """
    reports = cte("reports")
    reports = reports[reports.index("reports as") :]
    back = "coalesce(list_position(list_transform(list_zip(list_reverse({0}), list_reverse({1})), lambda z: z[1] = z[2]), false) - 1, {2})"
    forth = "coalesce(list_position(list_transform(list_zip({0}, {1}), lambda z: z[1] = z[2]), false) - 1, {2})"
    before, after = "least(i - alo, j - blo)", "least(ahi - i - n, bhi - j - n)"
    left = back.format(f"a[i - {before} + 1:i]", f"b[j - {before} + 1:j]", before)
    right = forth.format(f"a[i + n + 1:i + n + {after}]", f"b[j + n + 1:j + n + {after}]", after)
    return f"""{chunked(collapsed_lines, True)}, {reports}, {fenced_blocks("report_id", "reports", "bug_report")},
sides as (
  select pair_id, chunk_no, {collapsed("case when new_version <> '' then new_version else old_version end")} as side from chunks),
meetings as materialized (
  select report_id, chunk_no, side, block from reports join sides using (pair_id) join texts using (report_id)),
couples as materialized (
  select row_number() over () as p, side, block, regexp_extract_all(side, '(?s:.)') as a, regexp_extract_all(block, '(?s:.)') as b
  from (select distinct side, block from meetings)),
side_chars as (select p, unnest(range(len(a))) as i, unnest(a) as c from couples),
block_chars as (select p, unnest(range(len(b))) as j, unnest(b) as c, len(b) as m from couples),
rare_chars as (
  select p, j, c from (select *, count(*) over (partition by p, c) as often from block_chars)
  where m < 200 or often <= m // 100 + 1),
same_chars as (select p, i, j, i - j as d from side_chars join rare_chars using (p, c)),
char_runs as materialized (
  select p, d, min(i) as i0, max(i) + 1 as i9
  from (select *, i - row_number() over (partition by p, d order by i) as island from same_chars) group by p, d, island),
areas as (
  select p, 0::bigint as alo, len(a)::bigint as ahi, 0::bigint as blo, len(b)::bigint as bhi, false as done from couples
  union all
  select p, part.alo, part.ahi, part.blo, part.bhi, part.done
  from (
    select p, alo, ahi, blo, bhi, i - {left} as i1, j - {left} as j1, i + n + {right} as i2, j + n + {right} as j2
    from (
      select p, alo, ahi, blo, bhi, -max(best).i as i, -max(best).j as j, max(best).n as n
      from (
        select g.*, struct_pack(n := least(i9, ahi, bhi + d) - greatest(i0, alo, blo + d),
               i := -greatest(i0, alo, blo + d), j := d - greatest(i0, alo, blo + d)) as best
        from areas g join char_runs u on u.p = g.p
        where not g.done and u.i0 < g.ahi and u.i9 > g.alo and least(i9, ahi, bhi + d) > greatest(i0, alo, blo + d))
      group by p, alo, ahi, blo, bhi) join couples using (p)),
  lateral (select unnest([
    struct_pack(alo := i1, ahi := i2, blo := j1, bhi := j2, done := true),
    struct_pack(alo := alo, ahi := i1, blo := blo, bhi := j1, done := false),
    struct_pack(alo := i2, ahi := ahi, blo := j2, bhi := bhi, done := false)]) as part)
  where part.ahi > part.alo and part.bhi > part.blo),
matches as (
  select p, sum(ahi - alo) as total, min(alo) as i, min(blo) as j from areas where done group by p),
ratios as materialized (
  select side, block, case when len(a) + len(b) = 0 then 1.0::double else 2.0::double * (coalesce(total, 0) + least(
      coalesce(i, len(a)), coalesce(j, len(b)), {forth.format("a", "b", "least(len(a), len(b))")})) / (len(a) + len(b)) end as ratio
  from couples left join matches using (p)),
best as (
  select report_id, chunk_no, max(ratio) as best_similarity from meetings join ratios using (side, block) group by all)"""


REPORT_SCORES = f"""{similarities()},
asked as (
  select r.report_id, c.pair_id is not null as paired, coalesce(s.n, 0) as sides, coalesce(t.n, 0) as blocks
  from reports r left join code_pairs c using (pair_id)
  left join (select pair_id, count(*) as n from sides group by pair_id) s using (pair_id)
  left join (select report_id, count(*) as n from texts group by report_id) t using (report_id)),
credits as (
  select report_id, sum(case when best_similarity >= 0.8::double then 1 else best_similarity / 0.8::double end) as credit
  from best group by report_id)
select report_id, case when paired then sides end::bigint as n_diffs, blocks::bigint as n_code_blocks,
  case when not paired then 'no_pair' when sides = 0 then 'no_diffs' when blocks = 0 then 'no_code_blocks' else 'ok' end as status,
  case when paired and sides > 0 and blocks > 0 then least(credit / sides, 1.0::double) end as score
from asked left join credits using (report_id)"""

SOURCE_FILES = """with files as (
  select 'ch' || (doc_id % 50) || case when doc_id % 29 = 0 then '/.deep/' else '/' end
         || case when doc_id % 31 = 0 then '_' when doc_id % 37 = 0 then '.' else '' end
         || 'f' || doc_id || case when doc_id % 2 = 0 then '.sv' else '.v' end as path,
         case when doc_id % 43 = 7 then ''::blob when doc_id % 41 = 5 then encode(text) || '\\xFF\\x28'::blob else encode(text) end as content,
         case when doc_id % 43 = 7 then '' else text end as text, doc_id % 43 = 7 or doc_id % 41 <> 5 as valid_utf8
  from documents)"""
ANALYSIS_OUTPUTS = f"""with counted as ({matrix()}), challenges as ({BY_CHALLENGE}), labelled_rows as ({LABELLED} select * from labelled)
select 'rows' as output, uuid as name, expected_detection_result || '/' || actual_detection_result as value, 1::bigint as count
from labelled_rows
union all
select 'matrix', expected_detection_result || '/' || actual_detection_result, round(percent * 100)::bigint::varchar, count from counted
union all
select 'challenges', challenge_id, round(correct_overall_pct * 100)::bigint || '/' || round(correctly_detected_bug_pct * 100)::bigint,
       total_llm_prompts from challenges"""

ORACLES: dict[str, str] = {
    "labels_rowlevel": f"""{LABELLED} select uuid, input_file_rel_path, challenge_id,
        expected_detection_result, actual_detection_result from labelled""",
    "labels_strict": f"""{cte("usable_reviews")} select uuid,
        case when contains(input_file_rel_path, '/buggy.') then 'contains_bug' else 'no_bug' end as expected_detection_result,
        case when contains(llm_response, 'No modifications detected') then 'no_bug' else 'contains_bug' end
          as actual_detection_result from usable_reviews""",
    "confusion_matrix": matrix(),
    "by_model_confusion": matrix("llm_model_name"),
    "by_challenge": BY_CHALLENGE,
    "run_summary": f"""{LABELLED}, statuses as (
        select case when actual_detection_result in ('contains_bug', 'no_bug') then 'processed' else 'skipped' end as status
        from labelled)
        select status, count(*) as count, (select count(*) from statuses) as total from statuses group by status""",
    "normalize_ws": f"select doc_id, {collapsed('text')} as text from documents",
    "normalize_lines": f"""with pieces as (select doc_id, {lines_of("text")} as lines from documents),
        rows as (select doc_id, unnest(range(len(lines))) as line_no, unnest(lines) as line from pieces)
        select doc_id, line_no, {collapsed("line")} as line from rows""",
    "code_blocks": f"""{cte("reviews")}, pieces as (select uuid, {lines_of("llm_response")} as lines from reviews),
        rows as (select uuid, unnest(range(len(lines))) as pos, unnest(lines) as line from pieces),
        fences as (select uuid, pos, row_number() over (partition by uuid order by pos) - 1 as n
                   from rows where regexp_matches(line, '^{WS}*```')),
        spans as (select o.uuid, o.n // 2 as block_no, o.pos as opened, c.pos as closed
                  from fences o join fences c on c.uuid = o.uuid and c.n = o.n + 1 where o.n % 2 = 0)
        select s.uuid, s.block_no, coalesce(string_agg(r.line, chr(10) order by r.pos), '') as block
        from spans s left join rows r on r.uuid = s.uuid and r.pos > s.opened and r.pos < s.closed
        group by s.uuid, s.block_no""",
    "json_from_text": "select event_id, props as object from events",
    "json_entries": """select event_id, unnest(json_keys(props)) as key,
        json_extract_string(props, '$.' || unnest(json_keys(props))) as value,
        json_type(props, '$.' || unnest(json_keys(props))) = 'VARCHAR' as is_text from events""",
    "path_parts": rf"""with urls as (select page_id, url, regexp_replace(url, '[?#].*', '') as bare from pages)
        select page_id, {suffix("url")} as suffix, {suffix("bare")} as bare_suffix, {folder("'site'", "url")} as folder,
               lower(regexp_extract(bare || case when page_id % 2 = 0 then '.SV' else '.v' end, '[^/](\.[^./]+)$', 1))
                 in ('.sv', '.svh', '.svi') as is_sv
        from urls""",
    "prompts": f"""with {rename_prompt("documents")}
        select d.doc_id, md5({filled(DETECTION_PROMPTS["v1"], "text")}) as v1_md5, md5({V2}) as v2_md5,
               md5(r.prompt) as rename_md5,
               sha256(source || chr(31) || {V2} || chr(31) || 'model-a') as uuid,
               length({V2}) as prompt_chars, length(text) as response_chars
        from documents d join renaming r using (doc_id)""",
    "rename_prompt_dedent": f"""with padded as (
        select doc_id, 'top' || chr(10) || repeat(' ', (doc_id % 7)::int)
               || replace(text, chr(10), chr(10) || repeat(' ', (doc_id % 7)::int)) || chr(10) || '   ' as text
        from documents), {rename_prompt("padded")}
        select doc_id, md5(prompt) as prompt_md5 from renaming""",
    "valid_identifiers": f"""with words as (select unnest(regexp_split_to_array(text, '[ \\n]+')) as name from documents)
        select name, count(*) as n, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_$]*') as is_identifier,
               not (name = '' or name in ({", ".join(quoted(w) for w in RESERVED)})
                    or regexp_full_match(name, '\\p{{Nd}}+') or starts_with(name, '\\')
                    or starts_with(name, '__OBFUSCATE_MASK_')) as is_candidate
        from words group by name""",
    "candidate_names": f"""select distinct name from (
        select unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) as name from documents)
        where name not in ({", ".join(quoted(w) for w in RESERVED)})""",
    "mask_roundtrip": f"""select page_id, 'kinded' as style, len(regexp_extract_all(html, '{KINDED}')) as n_hits,
               md5({masked("html", KINDED, KINDED_PLACEHOLDER)}) as masked_md5, true as round_trip from pages
        union all
        select page_id, 'plain', len(regexp_extract_all(html, '{PLAIN}')),
               md5({masked("html", PLAIN, PLAIN_PLACEHOLDER)}), true from pages""",
    "mask_based_literals": f"""{cte("rtl_docs")}
        select doc_id, len(regexp_extract_all(text, '{PLAIN}')) as n_hits,
               'q <= 2''b00; r = 8''hFF; ' || {masked("text", PLAIN, PLAIN_PLACEHOLDER)} as masked, true as round_trip
        from rtl_docs""",
    "mapping_accept": f"{JUDGED} select doc_id, ord, old_name, new_name, reason from judged",
    "mapping_accept_inline": f"{JUDGED_ANSWERS} select doc_id, ord, old_name, new_name, reason from judged",
    "mapping_reasons": f"""{JUDGED} select coalesce(reason, 'accepted') as reason, count(*) as count
        from judged group by 1""",
    "rename_tokens": f"{ALL_ANSWERED} select doc_id, renamed as text from outputs",
    "rename_join": f"{ALL_RENAMED} select doc_id, renamed as text from outputs",
    "rename_join_long": f"{ALL_RENAMED_LONG} select doc_id, renamed as text from outputs",
    "rename_corpus": f"""{ALL_RENAMED}
        select doc_id, case when contains(gold, 'the') and mapped then 'succeeded' else 'no_usable_mapping' end as status,
               md5(case when contains(gold, 'the') then renamed else gold end) as renamed_md5
        from outputs""",
    "rename_run_summary": f"""{ALL_ANSWERED}
        select 'document' as what, status as outcome, count(*) as count from outputs group by 2
        union all
        select 'pair', coalesce(reason, 'accepted'), count(*) from judged group by 2""",
    "modules": f"{MODULES} select doc_id, module_no, module_name, module_text from named",
    "chunks": f"{CHUNKS} select * from chunks",
    "shuffle_groups": placement("safe"),
    "shuffle_groups_medium": placement("medium"),
    "shuffle_groups_aggressive": placement("aggressive"),
    "shuffle_corpus": shuffled("safe"),
    "shuffle_corpus_medium": shuffled("medium"),
    "shuffle_corpus_aggressive": shuffled("aggressive"),
    "report_blocks": f"""{cte("reports")}, {fenced_blocks("report_id", "reports", "bug_report")},
        listed as (select report_id, count(*) as n, string_agg(block, '|' order by block_no) as blocks
                   from texts group by report_id)
        select report_id, pair_id, coalesce(n, 0)::bigint as n_blocks, coalesce(blocks, '') as blocks
        from reports join code_pairs using (pair_id) left join listed using (report_id)""",
    "similarity_best": f"{similarities()} select report_id, chunk_no, best_similarity from best",
    "report_scores": REPORT_SCORES,
    "csv_round_trip": """select doc_id, nullif(text, '') as text, nullif(lang, '') as lang, nullif(source, '') as source, n_chars
        from documents""",
    "response_log": f"""{cte("reviews")} select distinct uuid, input_file_rel_path, input_file_contents,
        md5(input_file_contents) as llm_prompt, llm_response, llm_model_name from reviews""",
    "corpus_round_trip": f"""{SOURCE_FILES} select path, valid_utf8,
        case when valid_utf8 then md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) end as content_md5 from files""",
    "export_manifest": f"{SOURCE_FILES} select path, octet_length(content)::bigint as n_bytes, sha256(content) as sha256 from files",
    "analysis_outputs": ANALYSIS_OUTPUTS,
    "three_formats": f"""{cte("branches")} select b.*, format from branches b cross join (values ('pq'), ('ndjson'), ('csv')) as f(format)""",
    "shuffle_outputs": f"select doc_id, md5(text) as text_md5, md5(order_json) as order_md5 from ({shuffled('safe')})",
    "diff_opcodes": f"""{matched(collapsed_lines)} select pair_id, (row_number() over (partition by pair_id order by i1, j1, i2, j2) - 1)::bigint as pos,
        tag, i1::int as i1, i2::int as i2, j1::int as j1, j2::int as j2 from opcodes""",
    "diff_chunks": diff_chunks(collapsed_lines, True),
    "diff_chunks_exact": diff_chunks(kept_lines, False),
    "branch_names": f"""{cte("refs")}
        select distinct repo, substr(ref_name, instr(ref_name, '/') + 1) as branch from refs
        where not ends_with(ref_name, '/HEAD') and substr(ref_name, instr(ref_name, '/') + 1) <> 'main'""",
    "changed_paths": f"{cte('snapshots')}{CHANGES} select * from changes",
    "branch_select": f"{SELECTED} select * from selected",
    "branch_counts": f"""{SELECTED} select status, count(*) as count, (select count(*) from selected) as total
        from selected group by status""",
    "pair_emit": f"{EMITTED} select * from emitted",
    "emitted_pairs": f"""{EMITTED} select output_folder as challenge_id,
        md5(max(content) filter (role = 'base')) as base_md5, md5(max(content) filter (role = 'buggy')) as buggy_md5
        from emitted group by output_folder""",
    "metadata_union": f"""{SELECTED} select {folder("s.repo", "s.branch")} as output_folder, git_repo,
        s.branch as branch_name, source_path, base_commit as buggy_commit, tip_commit as fixed_commit
        from selected s join branches b on b.repo = s.repo and b.branch = s.branch where status = 'processed'""",
    "dataset_equiv": """with gold as (select doc_id, text, lang from documents),
        changed as (select doc_id, case when doc_id % 10 = 3 then text || '!' else text end as text, lang from documents),
        fewer as (select * from gold where lang <> 'en'),
        repeated as (select * from gold union all select * from gold),
        counts as (
          select 'identical' as case, 0 as only_gold, 0 as only_gate
          union all select 'changed', (select count(*) from (from gold except all from changed)),
                                      (select count(*) from (from changed except all from gold))
          union all select 'fewer', (select count(*) from (from gold except all from fewer)),
                                    (select count(*) from (from fewer except all from gold))
          union all select 'repeated', (select count(*) from (from gold except all from repeated)),
                                       (select count(*) from (from repeated except all from gold))
          union all select 'missing', null, null)
        select "case", (case when only_gold is null then 2 when only_gold = 0 and only_gate = 0 then 0 else 1 end)::bigint as verdict,
               only_gold, only_gate from counts""",
    "rename_equiv": RENAME_EQUIV,
    "collect_stub": f"""with asked as (
          select *, 'ch' || (doc_id % 50) || '/f' || doc_id || '.sv' as path, {V2} as prompt from documents)
        select sha256(path || chr(31) || prompt || chr(31) || 'model-a') as uuid, path as input_file_rel_path,
               md5(text) as contents_md5, md5(prompt) as prompt_md5,
               case when not starts_with(text, 'The') then length(prompt) || ' characters' end as llm_response,
               'model-a' as llm_model_name,
               case when starts_with(text, 'The') then 'ValueError: refused' end as error
        from asked""",
}
