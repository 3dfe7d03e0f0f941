import random
from difflib import SequenceMatcher

import pytest
from faultloom.operators import scoring
from faultloom.operators.scoring import SIDES_PER_SLICE, report_scores, similarity_table
from faultloom.plans.score import pairs_from_emitted, score_responses
from test_diffs import DECODER, DECODER_CUT, expected_chunks

PAIR = "pair_id int, base_code string, buggy_code string"
REPORT = "report_id int, pair_id int, bug_report string"


def score(spark, base, buggy, report, **options):
    pairs = spark.createDataFrame([(1, base, buggy)], PAIR)
    reports = spark.createDataFrame([(1, 1, report)], REPORT)
    [row] = report_scores(reports, pairs, **options).collect()
    return row


def fenced(*blocks):
    return "# Bug\n" + "\n".join(f"```verilog\n{b}\n```" for b in blocks) + "\nend"


COUNTER = "module counter(\n    input clk,\n    output reg [7:0] count\n);\n    always @(posedge clk) begin\n        count <= count + {}\n    end\nendmodule\n"
ALWAYS = "\n    always @(posedge clk) begin\n        count <= count {} 1;\n    end\n"
FIFO = """
module fifo #(parameter DEPTH = 8)(
    input wire clk,
    input wire rst,
    input wire wr_en,
    input wire [7:0] din,
    output reg full
);
    reg [2:0] wr_ptr;

    always @(posedge clk) begin
        if (rst) begin
            wr_ptr <= 0;
            full <= 0;
        end else if (wr_en && !full) begin
            wr_ptr <= wr_ptr + 1;
            full <= (wr_ptr == %s
        end
    end
endmodule
"""
CASES = [
    (COUNTER.format("1;"), COUNTER.format("2;  // Bug: incrementing by 2 instead of 1"),
     fenced("count <= count + 2;  // Bug: incrementing by 2 instead of 1"), {}, (1.0, 1.0)),
    (ALWAYS.format("+"), ALWAYS.format("-"),
     fenced("module adder(\n    input [7:0] a, b,\n    output [7:0] sum\n);\n    assign sum = a + b;\nendmodule"), {}, (0.0, 0.4)),
    (ALWAYS.format("+"), ALWAYS.format("-"), fenced("assign sum = a + b;"), {}, (0.0, 0.25)),
    ("always @(posedge clk) count <= count + 1;", "always @(posedge clk) count <= count + 2;",
     fenced("always @(posedge clk)\n    count <= count + 2;"), {}, (0.95, 1.0)),
    ("\n    if (enable) begin\n        data_out <= data_in;\n    end\n",
     "\n    if (enable) begin\n        data_out <= ~data_in;  // Bug: inverted data\n    end\n",
     fenced("if (enable) begin\n    data_out <= ~data_in;  // Bug here\nend"), {"threshold": 0.8}, (0.8, 1.0)),
    ("assign result = a & b;", "assign result = a | b;  // Bug: OR instead of AND",
     fenced("assign result = a ^ b;  // Different operator mentioned"), {"threshold": 0.9}, (0.6, 0.9)),
    ("wire valid = (state == IDLE);", "wire valid = (state == BUSY);  // Bug: wrong state",
     fenced("reg [1:0] state;", "wire valid = (state == BUSY);  // Bug: wrong state"), {}, (0.95, 1.0)),
    (FIFO % "DEPTH - 1);", FIFO % "DEPTH);  // Bug: should be DEPTH - 1",
     fenced("full <= (wr_ptr == DEPTH);  // Bug: should be DEPTH - 1"), {}, (0.95, 1.0)),
    (DECODER, DECODER_CUT, fenced("3'b011: out = 8'b00001000;"), {}, (0.5, 0.95)),
    (DECODER, DECODER_CUT, fenced("3'b011: out = 8'b00001000;  // Output 3 active"), {}, (0.5, 0.95)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_score_ranges(spark, case):
    base, buggy, report, options, (low, high) = CASES[case]
    row = score(spark, base, buggy, report, **options)
    assert row.status == "ok" and low <= row.score <= high


def test_lenient_threshold_scores_higher(spark):
    args = ("count <= count + 1;", "count <= count + 2;", fenced("count <= count + 3;  // Somewhat different"))
    assert score(spark, *args, threshold=0.6).score > score(spark, *args, threshold=0.95).score


def test_statuses(spark):
    same = score(spark, "assign out = in;", "assign out = in;", "```verilog\nassign out = in;\n```")
    assert (same.status, same.score) == ("no_diffs", None)
    # The missing change is reported first even if blocks are missing too.
    assert score(spark, "a", "a", "nothing").status == "no_diffs"
    plain = score(spark, "assign out = in;", "assign out = ~in;", "no code blocks, just text")
    assert (plain.status, plain.n_code_blocks, plain.score) == ("no_code_blocks", 0, None)
    assert score(spark, "assign out = in;", "assign out = ~in;", None).status == "no_code_blocks"


@pytest.mark.parametrize(
    ("base", "buggy", "report", "message"),
    [("a", "a", "```\na\n```", "No diffs found"), ("a", "b", "text", "No code blocks found")],
)
def test_strict_raises(spark, base, buggy, report, message):
    with pytest.raises(Exception, match=message):
        score(spark, base, buggy, report, strict=True)


def brute_best(base, buggy, blocks):
    best = []
    for old, new in expected_chunks(base, buggy):
        side = " ".join((new if new else old).split())
        ratios = [SequenceMatcher(None, side, " ".join(b.split())).ratio() for b in blocks]
        best.append(max([0.0, *ratios]))
    return best


def random_cases(n, seed):
    rng = random.Random(seed)
    words = ["wire", "reg", "a", "b", "<=", "assign", "=", "1'b0", ";", "always", "@", "(clk)"]

    def line():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))

    cases = []
    for _ in range(n):
        base = [line() for _ in range(rng.randrange(6, 40))]
        buggy = list(base)
        for _ in range(rng.randrange(1, 5)):
            buggy[rng.randrange(len(buggy))] = line()
        if rng.random() < 0.3:
            del buggy[rng.randrange(len(buggy))]
        blocks = ["\n".join(rng.sample(buggy, rng.randrange(1, 6))) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.3:
            blocks.append("")
        if rng.random() < 0.3:
            blocks.append("\n".join(buggy))
        cases.append(("\n".join(base), "\n".join(buggy), blocks))
    # More chunks than one slice holds: every fifth line changed.
    long_base = [f"line {i} {line()}" for i in range(5 * (SIDES_PER_SLICE + 20))]
    long_buggy = [f"changed {i}" if i % 5 == 0 else text for i, text in enumerate(long_base)]
    cases.append(("\n".join(long_base), "\n".join(long_buggy), ["changed 0", "changed 700 and more", "x"]))
    return cases


@pytest.fixture(scope="module")
def random_tables(spark):
    cases = random_cases(60, seed=21)
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], PAIR)
    reports = spark.createDataFrame([(i, i, fenced(*blocks)) for i, (_, _, blocks) in enumerate(cases)], REPORT)
    return cases, pairs, reports


def test_similarity_matches_brute_force(random_tables):
    cases, pairs, reports = random_tables
    got = {}
    for r in similarity_table(reports, pairs).collect():
        got[r.report_id, r.chunk_no] = r.best_similarity
    want = {}
    for i, (base, buggy, blocks) in enumerate(cases):
        for n, best in enumerate(brute_best(base, buggy, blocks)):
            want[i, n] = best
    assert got == want


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_scores_match_brute_force(random_tables, threshold):
    cases, pairs, reports = random_tables
    for r in report_scores(reports, pairs, threshold=threshold).collect():
        best = brute_best(*cases[r.report_id])
        assert r.n_diffs == len(best)
        if not best:
            assert r.status == "no_diffs"
            continue
        want = min(sum(1.0 if s >= threshold else s / threshold for s in best) / len(best), 1.0)
        assert abs(r.score - want) < 1e-9 and 0.0 <= r.score <= 1.0


def test_autojunk_can_be_switched_off(spark):
    """With the heuristic, near-identical long texts score low."""
    base = "x\n" + " ".join(f"sig_{i} <= sig_{i + 1};" for i in range(20))
    buggy = base.replace("sig_5 ", "sig_6 ")
    block = buggy.splitlines()[1].replace("sig_9 ", "sig_8 ")
    pairs, reports = spark.createDataFrame([(1, base, buggy)], PAIR), spark.createDataFrame([(1, 1, fenced(block))], REPORT)
    [on] = similarity_table(reports, pairs).collect()
    [off] = similarity_table(reports, pairs, autojunk=False).collect()
    assert on.best_similarity < off.best_similarity and off.best_similarity > 0.95


def test_many_reports_on_one_pair(spark):
    """A pair that a large share of the reports refer to."""
    pairs = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, "q", "r")], PAIR)
    reports = spark.createDataFrame([(i, 1 if i % 3 else 2, fenced("a\nc")) for i in range(300)], REPORT)
    rows = report_scores(reports, pairs).collect()
    assert len(rows) == 300
    assert all(r.score == 1.0 for r in rows if r.report_id % 3)


def test_responses_against_emitted_pairs(spark):
    emitted = spark.createDataFrame(
        [("ch1", "base", "assign y = a;"), ("ch1", "buggy", "assign y = b;")],
        "output_folder string, role string, content string",
    )
    responses = spark.createDataFrame(
        [("u1", "ch1/buggy.sv", fenced("assign y = b;")), ("u2", "ch9/buggy.sv", fenced("z"))],
        "uuid string, input_file_rel_path string, llm_response string",
    )
    rows = score_responses(responses, pairs_from_emitted(emitted)).collect()
    assert [(r.uuid, r.status, r.score) for r in rows] == [("u1", "ok", 1.0), ("u2", "no_pair", None)]


def test_many_blocks_and_missing_pair(spark, monkeypatch):
    """Slices of blocks give the best of all blocks; a report without a pair keeps its row."""
    monkeypatch.setattr(scoring, "BLOCKS_PER_SLICE", 3)
    pairs = spark.createDataFrame([(1, "assign y = a;", "assign y = b;")], "pair_id int, base_code string, buggy_code string")
    blocks = fenced(*[f"noise {i}" for i in range(10)], "assign y = b;", "more")
    reports = spark.createDataFrame([(1, 1, blocks), (2, 9, blocks)], REPORT)
    got = {r.report_id: (r.status, r.n_code_blocks, r.score) for r in report_scores(reports, pairs).collect()}
    assert got == {1: ("ok", 12, 1.0), 2: ("no_pair", 12, None)}
