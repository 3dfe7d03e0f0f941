import time

import pytest
from faultloom.operators.equivalence import dataset_equivalence, rename_verdicts

PORTS = "module counter2 (\n    input  logic clk,\n    input  logic rst_n,   // active-low reset\n    input  logic en,\n    output logic [1:0] q\n);\n"
GOLD = PORTS + (
    "    always_ff @(posedge clk) begin\n        if (!rst_n)       q <= 2'b00;\n"
    "        else if (en)      q <= q + 2'd1;\n        else              q <= q;\n    end\nendmodule\n"
)
GATE = PORTS + (
    "    logic [1:0] d;\n    assign d[0] = rst_n ? (en ? ~q[0]         : q[0])       : 1'b0;\n"
    "    assign d[1] = rst_n ? (en ? (q[1] ^ q[0]) : q[1])       : 1'b0;\n\n    always_ff @(posedge clk) q <= d;\nendmodule\n"
)
PAIRS = [
    (GATE, GATE.replace("d[", "internal_d[").replace("] d;", "] internal_d;").replace("<= d;", "<= internal_d;"), 0),
    (GOLD, GOLD.replace("2'd1", "2'd0"), 1),
    (GOLD, GATE, 1),
    ("a b a", "x y x", 0),
    ("a b a", "x x x", 1),
    ("a b c", "x y x", 1),
    ("a b", "b a", 0),
    ("a  b", "a\n\tb", 0),
    ("a + b", "a - b", 1),
    ("a", "1", 1),
    ("1", "a", 1),
    ("a b", "a", 1),
    ("8'hFF", "8'hFE", 1),
    ("é a", "é b", 0),
    ("", "", 0),
    ("@(posedge clk)", "@(negedge clk)", 1),
    ("wire a", "reg a", 1),
    ('$display("hello")', '$display("world")', 1),
    ('s = "a b"', 's = "a   b"', 1),
    ("// x\n b", "// x b", 1),
    ("a /* one */ b // two", "c d", 0),
    ('x = "// no comment"; y', 'z = "// no comment"; y', 0),
    (None, "a", 2),
    ("a", None, 2),
]


def test_rename_verdicts(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], "pair_id int, gold string, gate string")
    got = {r.pair_id: r.verdict for r in rename_verdicts(df).collect()}
    assert got == {i: verdict for i, (_, _, verdict) in enumerate(PAIRS)}


def verdict(*args):
    [row] = dataset_equivalence(*args).collect()
    return tuple(row)


def test_datasets(spark):
    schema = "a int, b string"
    gold = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], schema)
    assert verdict(gold, gold.select("b", "a")) == (0, 0, 0)
    assert verdict(gold, gold.distinct()) == (1, 1, 0)
    assert verdict(gold, gold.unionAll(gold.limit(1))) == (1, 0, 1)
    assert verdict(gold, gold.na.fill("")) == (1, 1, 1)
    assert verdict(gold.limit(0), gold.limit(0)) == (0, 0, 0)
    assert verdict(gold, None) == verdict(None, gold) == (2, None, None)
    stamp = spark.sql("select timestamp'2024-01-01 00:00:00.000001' as t, map('a', 1, 'b', 2) as m, x'00ff' as b")
    other = spark.sql("select timestamp'2024-01-01 00:00:00.000002' as t, map('a', 1, 'b', 2) as m, x'00ff' as b")
    turned = spark.sql("select timestamp'2024-01-01 00:00:00.000001' as t, map('b', 2, 'a', 1) as m, x'00ff' as b")
    assert verdict(stamp, other) == (1, 1, 1) and verdict(stamp, turned) == (0, 0, 0)
    with pytest.raises(ValueError, match="different columns or types"):
        dataset_equivalence(gold, gold.withColumn("a", gold.a.cast("long")))
    with pytest.raises(ValueError, match="different columns"):
        dataset_equivalence(gold, gold.drop("b"))


def verdict_by_id(spark, rows):
    return dict(rename_verdicts(spark.createDataFrame(rows, "pair_id int, gold string, gate string")).collect())


def test_long_texts_of_many_names(spark):
    gold = "".join(f"wire sig_{i} = {i};\n" for i in range(20_000))
    rows = [(1, gold, gold.replace("sig_", "s")), (2, gold, gold.replace("sig_7 ", "sig_8 ")), (3, gold, gold.replace(" 7;", " 8;"))]
    start = time.time()
    assert verdict_by_id(spark, rows) == {1: 0, 2: 1, 3: 1}
    assert time.time() - start < 30


def test_aligned_tokens_are_told_apart_whatever_they_hold(spark):
    rows = [
        (1, 'a "1 x" b', 'c "1 x" d'),
        (2, 'a "1 x" 1', 'c "1 x" 2'),
        (3, "x1 1 x", "x 1 1x"),
        (4, "a\x00b\x1ca", "c\x00d\x1cc"),
        (5, "a \U0001f600 b", "c \U0001f600 d"),
        (6, "a \U0001f600 b", "c \U0001f601 d"),
    ]
    assert verdict_by_id(spark, rows) == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1}
