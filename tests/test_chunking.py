import json
import random
import re
from collections import Counter

import pytest
from faultloom.operators.chunking import (
    LEVELS,
    chunk_table,
    module_table,
    placement_table,
    shuffle_documents,
)

RTL = """// header
module top #(parameter W = 8) (
    input a, b
);
  localparam D = 2; // depth
  wire x;
  wire y;
  reg [W-1:0] r;
  typedef enum {A, B} t_e;
  assign x = a; /* why */
  assign y = "s;";
  ASSIGN z = x;
  generate if (W) begin assign q = 1; end endgenerate
  always @(*) begin r = 1; end
  initial r = 0;
  function f; input i; f = i; endfunction
  sub u1 (x, y);
  sub u2 (a, b) ;
endmodule
between
package p;
  parameter Q = 1;
  parameter Q2 = 2;
  parameter Q3 = 3;
endpackage
"""
# Patterns tried one by one by the plain scanner below.
SCAN = [
    ("generate", re.compile(r"\bgenerate\b.*?\bendgenerate\b", re.S | re.I)),
    ("param", re.compile(r"\b(?:parameter|localparam)\b[^;]*?;", re.S | re.I)),
    ("typedef", re.compile(r"\btypedef\b.*?;", re.S | re.I)),
    ("decl", re.compile(r"\b(?:wire|reg|logic|bit|byte|int|shortint|longint)\b[^;]*?;", re.S | re.I)),
    ("assign", re.compile(r"\bassign\b[^;]*?;", re.S | re.I)),
    ("always", re.compile(r"\b(?:always|initial)\b.*?(?:end\b|;)", re.S | re.I)),
    ("func", re.compile(r"\b(?:function|task)\b.*?\bend(?:function|task)\b", re.S | re.I)),
    ("inst", re.compile(r"^[ \t]*([A-Za-z_]\w*)[ \t]+\w+[ \t]*\([^;{)]*?\)\s*;", re.M)),
]
MODULE = re.compile(
    r"\b(module|interface|program|package)\b\s+([A-Za-z_]\w*)\b(.*?)(\bendmodule\b|\bendinterface\b|\bendprogram\b|\bendpackage\b)",
    re.S | re.I,
)


def scan(block):
    """Nearest match over all patterns, earlier pattern on ties; the rest is pinned."""
    out, at = [], 0
    while at < len(block):
        found = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(SCAN) if (m := p.search(block, at))]
        if not found:
            out.append(("pinned", block[at:]))
            break
        start, _, kind, end = min(found)
        if start > at:
            out.append(("pinned", block[at:start]))
        out.append((kind, block[start:end]))
        at = end
    return out


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def random_sources(n, seed):
    rng = random.Random(seed)
    parts = [
        "module m ", "(a, b);\n", "endmodule\n", "package p;", "endpackage ", "\n", "  ", "wire w;\n", "wire ",
        "assign q = 1;", "assign", ";", "generate ", "endgenerate\n", "always @* begin x; end\n", "always_ff ",
        "initial ", "function ", "endfunction", "endtask", "sub u (x);\n", "  sub u (x, y) ;", "generate g (x);\n",
        "function f (x);\n", "typedef ", "int i;", "end ", "INTERFACE i ", "endinterface", "_wire ", "é", "x", "(", ")", "{",
        "shortint s;", "bendgenerate", "parameter P", "\r\n", "\u2028", "task t; endtask",
    ]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_modules_and_chunks_match_a_plain_scanner(spark):
    texts = [t for t in random_sources(500, seed=4) if not re.search(r"['\"]|//|/\*", t)]
    got_modules = {}
    for r in module_table(docs(spark, texts)).collect():
        got_modules[r.doc_id, r.module_no] = (r.module_name, r.module_text)
    want_modules = {
        (i, n): (m.group(2), m.group(0)) for i, t in enumerate(texts) for n, m in enumerate(MODULE.finditer(t))
    }
    assert got_modules == want_modules and len(want_modules) > 100
    got = {}
    for r in chunk_table(docs(spark, texts)).collect():
        assert r.chunk_id == f"{r.kind.upper()}_{r.chunk_no:06d}"
        assert r.pinned == (r.kind in ("pinned", "generate"))
        got[r.doc_id, r.module_no, r.chunk_no] = (r.kind, r.text)
    want = {(i, n, c): piece for (i, n), (_, block) in want_modules.items() for c, piece in enumerate(scan(block))}
    assert got == want


def test_kinds(spark):
    rows = chunk_table(docs(spark, [RTL])).where("module_no = 0").orderBy("chunk_no").collect()
    kinds = [r.kind for r in rows if r.kind != "pinned"]
    # The header matches the parameter pattern; `assign` ignores case; an always block ends at its first `;`.
    assert Counter(kinds) == Counter(param=2, decl=3, typedef=1, assign=3, generate=1, always=2, func=1, inst=2)


@pytest.mark.parametrize("level", LEVELS)
def test_reordering_properties(spark, level):
    texts = [RTL, RTL.replace("top", "other"), *random_sources(80, seed=6)]
    chunks = {}
    for r in chunk_table(docs(spark, texts)).collect():
        chunks[r.doc_id, r.module_no, r.chunk_no] = r
    rows = placement_table(docs(spark, texts), seed=3, level=level).collect()
    assert {(r.doc_id, r.module_no, r.slot) for r in rows} == set(chunks)
    assert {(r.doc_id, r.module_no, r.chunk_no) for r in rows} == set(chunks)
    buckets = {
        "safe": lambda kind: kind,
        "medium": lambda kind: {"assign": 2, "always": 3, "func": 3, "inst": 3}.get(kind, 1),
        "aggressive": lambda kind: 0,
    }
    for r in rows:
        moved, stood = chunks[r.doc_id, r.module_no, r.chunk_no], chunks[r.doc_id, r.module_no, r.slot]
        assert r.text == moved.text and r.chunk_id == moved.chunk_id
        if stood.pinned:
            assert r.slot == r.chunk_no and r.bucket is None
        else:
            assert buckets[level](moved.kind) == buckets[level](stood.kind)
    moves = {d: [(r.module_no, r.slot, r.chunk_no) for r in rows if r.doc_id == d] for d in (0, 1)}
    assert sorted(moves[0]) == sorted(moves[1]), "equal shapes get equal permutations"
    assert any(r.slot != r.chunk_no for r in rows)


@pytest.mark.parametrize("level", LEVELS)
def test_documents_keep_their_content(spark, level):
    texts = [RTL, "no modules // here", "", *random_sources(60, seed=8)]
    first = shuffle_documents(docs(spark, texts), seed=1, level=level).orderBy("doc_id").collect()
    again = shuffle_documents(docs(spark, texts).repartition(5), seed=1, level=level).orderBy("doc_id").collect()
    other = shuffle_documents(docs(spark, texts), seed=2, level=level).orderBy("doc_id").collect()
    assert first == again
    assert first[0].text != other[0].text != RTL
    assert [r.text for r in first[1:3]] == texts[1:3] and first[1].order_json == "{}"
    for text, r in zip(texts, first):
        assert Counter(r.text) == Counter(text)


def test_comments_and_strings_move_with_their_chunk(spark):
    [row] = shuffle_documents(docs(spark, [RTL]), seed=5, level="aggressive").collect()
    assert row.text.startswith("// header\n") and "\nbetween\n" in row.text
    assert 'assign y = "s;";' in row.text


def test_order_map(spark):
    twice = RTL + RTL.replace("  wire y;\n", "")
    [row] = shuffle_documents(docs(spark, [twice]), seed=5).collect()
    order = json.loads(row.order_json)
    # The repeated name keeps the order of its last block.
    assert list(order) == ["top", "p"]
    assert len(order["top"]["decl"]) == 2 and sorted(order["p"]["param"]) == ["PARAM_000001", "PARAM_000003", "PARAM_000005"]
    assert [b.module_name for b in row.chunk_order] == ["top", "p", "top", "p"]
    [medium] = shuffle_documents(docs(spark, [RTL]), level="medium").collect()
    assert list(json.loads(medium.order_json)["top"]) == ["types_params_decls", "assigns", "procedural"]
    [wide] = shuffle_documents(docs(spark, ["module a endmodule"]), level="aggressive").collect()
    assert json.loads(wide.order_json) == {"a": {"aggressive_all": []}}


def test_no_shuffle_in_the_plan(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    docs(spark, [RTL]).write.parquet(path)
    plan = shuffle_documents(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_unknown_level(spark):
    with pytest.raises(ValueError, match="unknown level"):
        shuffle_documents(docs(spark, [RTL]), level="wild")
