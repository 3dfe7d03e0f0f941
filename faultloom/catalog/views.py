"""Inputs derived from the driver tables.

The tables hold prose and web pages, not code reviews, so code-like inputs are derived from whole
tables by SQL that Spark and the checking database both run. ``{name}`` is a driver table or an
earlier view.
"""

from __future__ import annotations

REVIEWS = """
select 'r' || cast(doc_id as string) as uuid,
       'ch' || cast(doc_id % 50 as string)
            || case when doc_id % 100 < 50 then '/buggy.sv' else '/base.sv' end as input_file_rel_path,
       text as input_file_contents,
       case when doc_id % 7 = 0 then 'No modifications detected'
            when doc_id % 7 = 1 then 'too short'
            when doc_id % 7 = 2 then text
            when doc_id % 7 = 3 then 'Two:' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'and'
                 || chr(10) || '  ```sv' || chr(10) || source || chr(10) || '```' || chr(10) || '```open' || chr(10) || text
            else 'Found:' || chr(10) || '```systemverilog' || chr(10) || text || chr(10) || '```' end as llm_response,
       'model-' || cast(doc_id % 3 as string) as llm_model_name
from {documents}
"""

# Every response can be labelled: an all-clear or a block with the whole text.
USABLE_REVIEWS = """
select uuid, input_file_rel_path, input_file_contents,
       case when uuid like '%0' or uuid like '%5' then 'No modifications detected'
            else 'A bug is in this block:' || chr(10) || '```' || chr(10) || input_file_contents || chr(10) || '```'
            end as llm_response,
       llm_model_name
from {reviews}
"""

# Every document gets a pair: its second line is exchanged, or a line added where it has none; every
# fifth pair is equal on both sides.
CODE_PAIRS = """
select doc_id as pair_id, text as base_code,
       case when doc_id % 5 = 4 then text
            when length(split_part(text, chr(10), 2)) > 0
            then replace(text, split_part(text, chr(10), 2), 'MUTATED ' || cast(doc_id as string))
            else text || chr(10) || 'MUTATED ' || cast(doc_id as string) end as buggy_code
from {documents}
"""

# Digits of each document's digest choose its report's blocks, all cut from its own text: none, a piece of it,
# its changed line with more, the whole of either side, an open fence. A third of the reports name one pair,
# some name a pair that is not there.
REPORTS = """
select id as report_id,
       case when id % 17 = 3 then -1 - id when id % 3 = 0 then 0 else id end as pair_id,
       case when h < '2' then 'No modifications detected'
            else 'Found:' || chr(10) || '```sv' || chr(10)
                 || substr(buggy_code, 1 + length(buggy_code) % 97, cast(40 + id % 400 as int)) || chr(10) || '```' || chr(10)
                 || case when g < '8' then '```' || chr(10) || 'MUTATED ' || cast(id as string) || ' '
                              || substr(base_code, 1, cast(id % 60 as int)) || chr(10) || '```' || chr(10) else '' end
                 || case when g < '4' then 'all:' || chr(10) || ' ```' || chr(10) || buggy_code || chr(10) || '```' || chr(10)
                         when g < '6' then '```' || chr(10) || split_part(base_code, chr(10), 2) || chr(10) || '```' || chr(10)
                              || '```' || chr(10) || base_code || chr(10) || '```' || chr(10) else '' end
                 || case when h >= 'c' then '```' || chr(10) || 'open' else 'end' end end as bug_report
from (select pair_id as id, base_code, buggy_code, substr(md5(buggy_code), 1, 1) as h, substr(md5(buggy_code), 2, 1) as g
      from {code_pairs}) as own
"""

MAPPINGS = """
select d.doc_id, m.ord, m.old_name, m.new_name
from {documents} d cross join (values (0,'the','tok_a'),(1,'and','tok_b'),(2,'of','tok_a'),(3,'absent_name','tok_c'),
  (4,'for','tok_d'),(5,'is','9bad'),(6,'tok_b','the'),(7,'de','la'),(8,'la','de')) as m(ord, old_name, new_name)
"""

# Leading words of every text that the long mappings list, and those that one document's mapping lists of each.
OWN_WORDS, OTHER_WORDS = 40, 20

# Long mappings, far beyond what a document's text names: its own words, with repeats and words that are no
# names, and for one document the words of all others too, a third of all rows.
LONG_MAPPINGS = """
select doc_id, cast(m.k as bigint) as ord, split_part(text, ' ', m.k) as old_name,
       'w' || substr(md5(split_part(text, ' ', m.k)), 1, 6) as new_name
from {documents} cross join (values OWN_WORDS) as m(k)
union all
select 0, 100 + doc_id * 20 + m.k, split_part(text, ' ', m.k), 'h' || substr(md5(split_part(text, ' ', m.k)), 1, 4)
from {documents} cross join (values OTHER_WORDS) as m(k)
""".replace("OWN_WORDS", ", ".join(f"({k})" for k in range(1, OWN_WORDS + 1))).replace(
    "OTHER_WORDS", ", ".join(f"({k})" for k in range(1, OTHER_WORDS + 1))
)

# Code around each document's own text: names are digests of its words, the whole text stands in comments,
# digits of its digest choose the statements and none, one or two modules (also two of one name).
RTL_DOCS = """
select doc_id,
       '// ' || replace(text, chr(10), chr(10) || '// ') || chr(10)
    || case when h < '3' then 'wire outside;' || chr(10) else
          'module m_' || a || ' (' || a || ', ' || b || ');' || chr(10)
       || '  parameter W = ' || cast(length(text) as string) || ';' || chr(10)
       || '  wire ' || a || '_x;' || chr(10) || '  reg ' || b || '_y; // ' || split_part(text, chr(10), 2) || chr(10)
       || case when h >= '8' then '  typedef logic t_' || a || ';' || chr(10) else '' end
       || '  assign ' || a || '_x = ' || b || ';' || chr(10) || '  assign ' || c || ' = "a;b";' || chr(10)
       || case when g < '8' then '  always @(posedge clk) begin ' || b || '_y <= ' || c || '; end' || chr(10)
               else '  initial ' || b || '_y = 0;' || chr(10) end
       || case when g >= '4' then '  function f_' || c || '; input i; f_' || c || ' = i; endfunction' || chr(10) else '' end
       || case when g >= 'a' then '  generate if (W) begin assign q = 1; end endgenerate' || chr(10) else '' end
       || '  sub_' || c || ' u1 (' || a || ', ' || b || ');' || chr(10) || 'endmodule' || chr(10) end
    || case when h >= '9' then '/* between */ wire w_' || a || ';' || chr(10)
       || 'module m_' || case when h >= 'c' then a else b end || ' (z);' || chr(10) || '  localparam P = 1;' || chr(10)
       || '  assign z = P;' || chr(10) || '  assign ' || c || ' = z;' || chr(10) || 'endmodule' || chr(10) else '' end as text
from (select doc_id, text, substr(md5(text), 1, 1) as h, substr(md5(text), 2, 1) as g,
             'n' || substr(md5(split_part(text, ' ', 1)), 1, 4) as a,
             'k' || substr(md5(split_part(text, ' ', 2)), 1, 4) as b,
             'v' || substr(md5(split_part(text, ' ', 3)), 1, 4) as c
      from {documents}) as own
"""

SNAPSHOTS = """
select 'repo' || cast(doc_id % 2 as string) as repo, 'fix_cwe_' || cast(doc_id % 40 as string) as branch,
       sd.side, 'src/f' || cast(doc_id as string) || '.sv' as path,
       case when sd.side = 'tip' and doc_id % 33 = 0 then text || chr(10) || 'FIX' else text end as content
from {documents} cross join (values ('base'),('tip')) as sd(side)
where not (sd.side = 'tip' and doc_id % 97 = 5) and not (sd.side = 'base' and doc_id % 89 = 7)
union all
select distinct 'repo' || cast(doc_id % 2 as string), 'fix_cwe_' || cast(doc_id % 40 as string),
       sd.side, 'README.md', sd.side
from {documents} cross join (values ('base'),('tip')) as sd(side)
"""

# Branch heads as a remote lists them, and what is known of each branch.
REFS = """
select distinct 'repo' || cast(doc_id % 2 as string) as repo,
       case when doc_id % 40 = 39 then 'origin/HEAD' when doc_id % 40 = 38 then 'origin/main'
            else 'origin/fix_cwe_' || cast(doc_id % 40 as string) end as ref_name
from {documents}
"""

BRANCHES = """
select distinct 'repo' || cast(doc_id % 2 as string) as repo,
       'fix_cwe_' || cast(doc_id % 40 as string) as branch,
       'https://example.org/repo' || cast(doc_id % 2 as string) as git_repo,
       'b' || cast(doc_id % 40 as string) as base_commit,
       't' || cast(doc_id % 40 as string) as tip_commit
from {documents}
"""

# One duplicate branch, two forced files, one override whose expected set does not hold. The
# expected paths are what the branch changes, taken from the table itself, so they fit every scale.
OVERRIDES = """
with changed as (
  select 'repo' || cast(doc_id % 2 as string) as repo, 'fix_cwe_' || cast(doc_id % 40 as string) as branch,
         'src/f' || cast(doc_id as string) || '.sv' as path, doc_id
  from {documents}
  where doc_id % 33 = 0 or (doc_id % 97 = 5) <> (doc_id % 89 = 7)
), chosen as (
  select repo, branch, max(case when doc_id % 33 = 0 and doc_id % 97 <> 5 and doc_id % 89 <> 7 then path end) as chosen_path
  from changed group by repo, branch)
select c.repo, c.branch,
       case when c.branch = 'fix_cwe_1' then 'skip' else 'choose' end as action,
       c.path as expected_path, h.chosen_path
from changed c join chosen h on h.repo = c.repo and h.branch = c.branch
where c.branch in ('fix_cwe_1', 'fix_cwe_2', 'fix_cwe_3')
union all
select 'repo0', 'fix_cwe_4', 'choose', 'src/none.sv', 'src/none.sv' from (select count(*) as n from {documents}) t
"""

# Model answers to the renaming prompt: one JSON object with the same pairs as MAPPINGS.
RENAME_JSON = (
    '{"the": "tok_a", "and": "tok_b", "of": "tok_a", "absent_name": "tok_c", "for": "tok_d", '
    '"is": "9bad", "tok_b": "the", "de": "la", "la": "de"}'
)

# Code put after prose for comparisons up to renaming, and edits of it: only the comment's leaves it the same.
CODE_TAIL = ' wire q9; s9 = "a b"; n9 = 2\'d1; // note'
TAIL_EDITS = (("2'd1", "2'd0"), ("// note", "/* other */"), ("wire", "reg"), ('"a b"', '"a  b"'), ("s9 =", "q9 ="))

# Answers to the renaming prompt per document: most hold the mapping above, the others none, one with a number or
# a nested object for a name, an object that does not parse, or one key twice. PROPOSALS lists their pairs.
ANSWERS = f"""
select doc_id, text,
       case doc_id % 13 when 7 then 'no idea'
            when 8 then 'Sure: {{{{"the": "tok_a", "and": 7, "of": "x"}}}} done'
            when 9 then '{{{{bad}}}} {{{{"the": "tok_a"}}}}'
            when 10 then 'Nested: {{{{"n": {{{{"k":"}}}}"}}}}, "the": "tok_a"}}}} and {{{{"z": 1}}}}'
            when 11 then '{{{{"the": "tok_a", "of": "b", "the": "tok_z"}}}}'
            else 'Sure: {RENAME_JSON.replace("{", "{{").replace("}", "}}")} done' end as llm_response
from {{documents}}
"""
PROPOSALS = {
    8: (("the", "tok_a", True), ("and", "7", False), ("of", "x", True)),
    10: (("n", '{"k":"}"}', False), ("the", "tok_a", True)),
    11: (("the", "tok_z", True), ("of", "b", True)),
}
WITHOUT_PAIRS = (7, 9)

VIEWS = {
    "answers": (ANSWERS, ("documents",)),
    "reviews": (REVIEWS, ("documents",)),
    "usable_reviews": (USABLE_REVIEWS, ("reviews",)),
    "code_pairs": (CODE_PAIRS, ("documents",)),
    "reports": (REPORTS, ("code_pairs",)),
    "mappings": (MAPPINGS, ("documents",)),
    "long_mappings": (LONG_MAPPINGS, ("documents",)),
    "rtl_docs": (RTL_DOCS, ("documents",)),
    "snapshots": (SNAPSHOTS, ("documents",)),
    "refs": (REFS, ("documents",)),
    "branches": (BRANCHES, ("documents",)),
    "override_paths": (OVERRIDES, ("documents",)),
}


def cte(*names: str) -> str:
    """``with`` clause defining the named views and those they need, for a plain SQL engine."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][1]:
            if needed in VIEWS:
                add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = []
    for name in ordered:
        sql, needed = VIEWS[name]
        parts.append(f"{name} as ({sql.format(**{n: n for n in needed})})")
    return "with " + ",\n".join(parts)
