import random
import re
import time
import tracemalloc

import pyarrow as pa
import pytest
from faultloom.catalog.queries import long_mappings
from faultloom.catalog.views import VIEWS
from faultloom.functions.words import DECLARATION_KEYWORDS, KEYWORDS, RESERVED, is_candidate
from faultloom.operators.renaming import (
    exclude_words,
    judge_mapping_table,
    make_renamer,
    reason_counts,
    rename_by_proposals,
    rename_by_table,
    rename_tokens,
)
from faultloom.plans.rename_corpus import apply_rename_responses, rename_corpus, rename_summary
from pyspark.sql import functions as F

COUNTER = """// Comment here
module counter2 (
    input  logic clk,
    input  logic rst_n,   // active-low reset
    input  logic en,
    output logic [1:0] q
);
    always_ff @(posedge clk) begin
        if (!rst_n)       q <= 2'b00;
        else if (en)      q <= q + 2'd1;
        else              q <= q;
    end
endmodule"""
COUNTER_RENAMED = """// Comment here
module counter4 (
    input  logic clkA,
    input  logic rstA,   // active-low reset
    input  logic enA,
    output logic [1:0] qA
);
    always_ff @(posedge clkA) begin
        if (!rstA)       qA <= 2'b00;
        else if (enA)      qA <= qA + 2'd1;
        else              qA <= qA;
    end
endmodule"""
COUNTER_MAP = {"counter2": "counter4", "clk": "clkA", "rst_n": "rstA", "en": "enA", "q": "qA"}

CASES = [
    ("Z a b c", {"a": "x", "b": "y", "c": "z"}, "Z x y z"),
    (COUNTER, COUNTER_MAP, COUNTER_RENAMED),
    (COUNTER, {}, COUNTER),
    (COUNTER_RENAMED, {}, COUNTER_RENAMED),
    ("a b a", {"a": "b", "b": "a"}, "b a b"),
    ("ab a_b a$ $a a1 1a a", {"a": "x"}, "ab a_b a$ $a a1 1a x"),
    ("2'd1 d1", {"d1": "z"}, "2'z z"),
    ("é a\r\n\ta😀a", {"a": "x"}, "é x\r\n\tx😀x"),
    ("", {"a": "x"}, ""),
    ("a", None, "a"),
]


def renamed(spark, cases):
    df = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(cases)], "i int, t string, m map<string,string>")
    return [r[0] for r in df.orderBy("i").select(rename_tokens(F.col("t"), F.col("m"))).collect()]


def test_vectors(spark):
    assert renamed(spark, [(t, m) for t, m, _ in CASES]) == [out for _, _, out in CASES]


def test_simultaneous_rename_matches_token_substitution(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(100):
        text = "".join(rng.choice(["a", "b", "c", "$", "_", " ", "\n", "1", "'", "é", "(", "ab"]) for _ in range(40))
        mapping = {k: rng.choice(["a", "b", "zz"]) for k in rng.sample(["a", "b", "c", "ab", "a1", "_"], 3)}
        cases.append((text, mapping))
    want = [re.sub(r"[A-Za-z0-9_$]+", lambda t, m=m: m.get(t.group(), t.group()), text) for text, m in cases]
    assert renamed(spark, cases) == want


def test_swap_twice_is_identity(spark):
    swap = {"clk": "q", "q": "clk"}
    [once] = renamed(spark, [(COUNTER, swap)])
    assert once != COUNTER and renamed(spark, [(once, swap)]) == [COUNTER]


def test_word_lists(apply):
    assert len(KEYWORDS) == 59 and len(DECLARATION_KEYWORDS) == 14
    assert {"bit", "byte", "shortint", "$clog2", "module"} <= set(RESERVED)
    names = ["", "wire", "bit", "$display", "123", "\\esc", "__OBFUSCATE_MASK_STR_DQ_0__", "clk", "1a", "Module"]
    assert apply(is_candidate, names) == [False] * 7 + [True] * 3


RESPONSES = [
    # (text, response, expected status, expected text, expected reasons in order)
    ("the and of it", 'Sure {"the":"a1","and":"a1","gone":"g","of":"9x","it":"i1"} ok', "succeeded", "a1 and of i1",
     [None, "collision", "absent", "invalid_new_name", None]),
    ("for wire x", '{"for":"n1","x":"n1","wire":"w"}', "no_usable_mapping", "for wire x",
     ["not_candidate", "collision", "not_candidate"]),
    ("x y", "no idea", "no_usable_mapping", "x y", None),
    ("x y", "{}", "no_usable_mapping", "x y", []),
    ("x y", '{"x": 3}', "failed", "x y", ["invalid_new_name"]),
    ("x y", '{"z": 3, "x": "k"}', "succeeded", "k y", ["absent", None]),
    ("x y", '{"x": null, "y": "k"}', "failed", "x y", None),
    ("x y", '{"x": "k", "y": {"n": 1, "n": 2}}', "failed", "x y", None),
    ("x y", '{"x": "k", "x": "m"}', "succeeded", "m y", [None]),
    ("a.b y", '{"a.b": "k", "y": "m"}', "succeeded", "a.b m", ["unsupported_key", None]),
    ("x __OBFUSCATE_MASK_1", '{"__OBFUSCATE_MASK_1": "k", "x": "m"}', "succeeded", "m __OBFUSCATE_MASK_1",
     ["mask_token", None]),
    ("x y", '{"x": "y", "y": "x"}', "succeeded", "y x", [None, None]),
]


def answered(spark):
    rows = [(i, t, r) for i, (t, r, *_) in enumerate(RESPONSES)]
    return spark.createDataFrame(rows, "i int, content string, llm_response string")


def test_responses(spark):
    rows = apply_rename_responses(answered(spark)).orderBy("i").collect()
    for row, (_, _, status, text, reasons) in zip(rows, RESPONSES):
        assert (row.status, row.renamed) == (status, text), row
        if reasons is not None:
            assert [v.reason for v in row.verdicts] == reasons, row


def test_summary(spark):
    counts = {(r.what, r.outcome): r["count"] for r in rename_summary(apply_rename_responses(answered(spark))).collect()}
    assert counts["document", "failed"] == 3 and counts["document", "no_usable_mapping"] == 3
    assert counts["pair", "collision"] == 2 and counts["pair", "unsupported_key"] == 1


def test_comments_are_kept_when_masked(spark):
    text = 'wire clk; // clk here\nassign s = "clk"; clk'
    df = spark.createDataFrame([(1, text, '{"clk": "c9", "here": "h"}')], "i int, content string, llm_response string")
    [plain] = apply_rename_responses(df).collect()
    [masked] = apply_rename_responses(df, mask_first=True).collect()
    assert plain.renamed == 'wire c9; // c9 h\nassign s = "c9"; c9'
    assert masked.renamed == 'wire c9; // clk here\nassign s = "clk"; c9'


def test_corpus_is_rewritten_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame([("f.v", "x y"), ("g.v", "boom")], "path string, content string").write.parquet(path)

    def responder(prompt):
        if "boom" in prompt:
            raise RuntimeError("refused")
        return '{"x": "k"}'

    result = rename_corpus(spark.read.parquet(path), responder, concurrency=2)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 2
    rows = {r.path: r for r in result.collect()}
    assert rows["f.v"].renamed == "k y" and rows["f.v"].status == "succeeded"
    assert rows["g.v"].renamed == "boom" and rows["g.v"].status == "failed"
    assert rows["g.v"].error == "RuntimeError: refused"


@pytest.fixture
def tables(spark):
    documents = spark.createDataFrame([(1, "the and x of"), (2, "the")], "doc_id int, text string")
    pairs = [(0, "the", "t"), (1, "and", "t"), (2, "x", "9"), (3, "zz", "q"), (4, "a b", "r"), (5, "of", "o")]
    mappings = spark.createDataFrame([(d, *p) for d in (1, 2, 3) for p in pairs], "doc_id int, ord int, old_name string, new_name string")
    return documents, mappings


def test_mapping_table(tables):
    documents, mappings = tables
    got = {(r.doc_id, r.ord): r.reason for r in judge_mapping_table(mappings, documents).collect()}
    one = [None, "collision", "invalid_new_name", "absent", "unsupported_key", None]
    two = [None, "absent", "absent", "absent", "unsupported_key", "absent"]
    gone = ["absent", "absent", "absent", "absent", "unsupported_key", "absent"]
    assert got == {(d, n): r for d, rs in ((1, one), (2, two), (3, gone)) for n, r in enumerate(rs)}


def test_reason_counts(tables):
    documents, mappings = tables
    counts = {r.reason: r["count"] for r in reason_counts(judge_mapping_table(mappings, documents)).collect()}
    assert counts == {"accepted": 3, "collision": 1, "invalid_new_name": 1, "absent": 10, "unsupported_key": 3}


def test_rename_by_table(tables):
    documents, mappings = tables
    accepted = judge_mapping_table(mappings, documents).where("reason is null")
    got = {r.doc_id: r.text for r in rename_by_table(documents, accepted).collect()}
    assert got == {1: "t and x o", 2: "t"}


def test_mappings_of_more_pairs_than_a_row_would_hold(spark):
    """A hot document with 300,000 pairs of long names, few of them in the text; others beside it."""
    documents = spark.createDataFrame(
        [(1, "w5 w1500 w299999 other"), (2, "w5 w6"), (2, "w6 again"), (None, "w5"), (3, None)], "doc_id int, text string"
    )
    pad = "'" + "_" * 200 + "'"
    mappings = spark.range(300_000).selectExpr(
        "1 as doc_id", "id as ord", "'w' || id as old_name", f"if(id = 1500, 'n' || {pad}, {pad} || id) as new_name"
    ).unionByName(spark.createDataFrame([(2, 0, "w5", "a"), (2, 1, "w6", "b")], "doc_id int, ord long, old_name string, new_name string"))
    judged = judge_mapping_table(mappings, documents)
    assert judged.where("reason is null").count() == 5 and judged.count() == 300_002
    renamed = sorted((r.text for r in rename_by_table(documents, mappings).collect()), key=str)
    pad = "_" * 200
    assert renamed == sorted([f"{pad}5 n{pad} {pad}299999 other", "a b", "b again", "w5", None], key=str)
    assert sorted((r.text for r in rename_by_proposals(documents, mappings).collect()), key=str) == renamed


def test_long_tables_rename_like_a_mapping_on_the_row(spark):
    rng = random.Random(8)
    names = [f"v{i}" for i in range(30)] + ["wire", "7", "__OBFUSCATE_MASK_1", "a b", "x$"]
    texts = [" ".join(rng.choice(names) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    pairs = [[(rng.choice(names), rng.choice(names + ["9z", ""])) for _ in range(rng.randint(1, 25))] for _ in texts]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = [(d, n, *p) for d, own in enumerate(pairs) for n, p in enumerate(own)]
    mappings = spark.createDataFrame(rows, "doc_id int, ord int, old_name string, new_name string")
    answers = spark.createDataFrame(
        [(d, t, "{" + ",".join(f'"{a}":"{b}"' for a, b in own) + "}") for d, (t, own) in enumerate(zip(texts, pairs))],
        "doc_id int, text string, llm_response string",
    )
    want = {r.doc_id: r.renamed for r in apply_rename_responses(answers, text="text").collect()}
    assert {r.doc_id: r.text for r in rename_by_proposals(documents, mappings).collect()} == want


def test_repeated_old_names(spark):
    """Two rows with one old name: the last new name at the first place, as in a JSON object."""
    documents = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    pairs = [(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "a", "z"), (1, 3, "c", "y")]
    mappings = spark.createDataFrame(pairs, "doc_id int, ord int, old_name string, new_name string")
    accepted = judge_mapping_table(mappings, documents).where("reason is null")
    assert [r.text for r in rename_by_table(documents, accepted).collect()] == ["z y c"]
    assert [r.text for r in rename_by_proposals(documents, mappings).collect()] == ["z y c"]


def test_exclude_words(spark):
    names = spark.createDataFrame([("a",), ("wire",)], "name string")
    words = spark.createDataFrame([("wire",), ("wire",)], "name string")
    assert [r.name for r in exclude_words(names, words).collect()] == ["a"]


def test_renaming_kernel_holds_some_rows_as_objects_at_once():
    rows = 10_000
    texts = pa.array([f"wire sig_{i} = other;" + "x" * 2_000 for i in range(rows)])
    olds, news = pa.array([[f"sig_{i}", "other"] for i in range(rows)]), pa.array([["a", "b"]] * rows)
    tracemalloc.start()
    out = make_renamer()(texts, olds, news)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[rows - 1].as_py().startswith("wire a = b;x") and len(out) == rows
    assert peak < 4_000_000  # the texts take 20 MB, as objects of Python once more and again for the result


def test_renaming_kernel_null_and_empty_rows():
    texts = pa.array(["a b", None, "a b", "a b", ""])
    olds, news = pa.array([["a"], ["a"], None, [], ["a"]]), pa.array([["b"], ["b"], None, [], ["b"]])
    assert make_renamer()(texts, olds, news).to_pylist() == ["b b", None, "a b", "a b", ""]
    assert make_renamer()(texts[:0], olds[:0], news[:0]).to_pylist() == []
    # A gap is never a name, also where a mapping lists it.
    assert make_renamer()(pa.array(["a a"]), pa.array([[" ", "a"]]), pa.array([["-", "c"]])).to_pylist() == ["c c"]


def test_long_mappings_are_those_of_the_view(spark):
    texts = ["", None, "one", " lead  two ", "é\nb c", " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(41))]
    texts += [" ".join(f"w{i}" for i in range(100)), " " * 45, "x" * 50 + " ", " ".join(["a"] * 39) + " "]
    docs = spark.createDataFrame([*enumerate(texts), (3, "again"), (None, "a b")], "doc_id long, text string")
    plain = spark.sql(VIEWS["long_mappings"][0], documents=docs)
    assert sorted(map(str, long_mappings(docs).collect())) == sorted(map(str, plain.collect()))


def test_long_mappings_of_long_texts(spark):
    docs = spark.range(16).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), "id", F.lit(" ")), 600_000).alias("text"))
    start = time.time()
    assert long_mappings(docs).agg(F.count("old_name"), F.count("new_name")).first() == (960, 960)
    assert time.time() - start < 10
