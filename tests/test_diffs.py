import random
import tracemalloc
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from faultloom.operators.diffs import EXACT, NORMALIZED, chunk_table, make_run_kernel, opcode_table
from faultloom.operators.matching import make_run_finder

DECODER = """
// 3:8 Decoder
// Decodes a 3-bit input into one of 8 output lines.
// Optional enable input for controlling decoder operation.

module decoder_3to8 (
    input wire [2:0] in,    // 3-bit input
    input wire enable,      // Enable signal (active high)
    output reg [7:0] out    // 8-bit output (one-hot encoded)
);
    always @(*) begin
        if (enable) begin
            case (in)
                3'b000: out = 8'b00000001;  // Output 0 active
                3'b001: out = 8'b00000010;  // Output 1 active
                3'b010: out = 8'b00000100;  // Output 2 active
                3'b011: out = 8'b00001000;  // Output 3 active
                3'b100: out = 8'b00010000;  // Output 4 active
                3'b101: out = 8'b00100000;  // Output 5 active
                3'b110: out = 8'b01000000;  // Output 6 active
                3'b111: out = 8'b10000000;  // Output 7 active
                default: out = 8'b00000000;
            endcase
        end else begin
            out = 8'b00000000;  // All outputs low when disabled
        end
    end

endmodule
"""
DECODER_CUT = "\n".join(DECODER.splitlines()[:16] + DECODER.splitlines()[18:])


def chunks(spark, pairs, mode=NORMALIZED):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair_id int, base_code string, buggy_code string")
    out = [[] for _ in pairs]
    for row in chunk_table(df, mode=mode).orderBy("pair_id", "chunk_no").collect():
        assert row.chunk_no == len(out[row.pair_id])
        out[row.pair_id].append((row.old_version, row.new_version))
    return out


def expected_chunks(old, new, mode=NORMALIZED):
    """Plain restatement of the rule: cut the edit script at equal runs of three lines or more."""
    normalized = mode == NORMALIZED
    a = [" ".join(x.split()) for x in old.splitlines()] if normalized else old.splitlines(keepends=True)
    b = [" ".join(x.split()) for x in new.splitlines()] if normalized else new.splitlines(keepends=True)
    pieces, start_a, start_b = [], 0, 0
    blocks = SequenceMatcher(None, a, b, autojunk=not normalized).get_matching_blocks()
    for i, j, n in [*blocks[:-1], (len(a), len(b), 3)]:
        if n >= 3:
            pieces.append((a[start_a:i], b[start_b:j]))
            start_a, start_b = i + n, j + n
    glue = "\n" if normalized else ""
    texts = [(glue.join(x), glue.join(y)) for x, y in pieces if x or y]
    if normalized:
        texts = [(x.strip(), y.strip()) for x, y in texts]
        texts = [(x, y) for x, y in texts if x != y]
    return texts


def test_vectors(spark):
    greet = 'def hello():\n    print("{}")\n    x = 1\n    y = 2\n    z = 3\n    return x + y + z\n\ndef goodbye():\n    print("{}")'
    pairs = [
        (greet.format("Hello", "Goodbye"), greet.format("Hi there", "See you later")),
        ("line1\nline2\nline3\nline4", "line1_changed\nline2\nline3\nline4_changed"),
        ("hello" + "\n" * 6 + "world", "hello" + "\n" * 8 + "world"),
        ("def hello():\n    return True", "def hello():\n    return True"),
        ("old text", "new text"),
        (DECODER, DECODER_CUT),
    ]
    got = chunks(spark, pairs)
    assert [len(c) for c in got] == [2, 1, 0, 0, 1, 1]
    assert "Hello" in got[0][0][0] and "Hi there" in got[0][0][1]
    assert "Goodbye" in got[0][1][0] and "See you later" in got[0][1][1]
    assert got[4] == [("old text", "new text")]
    assert "3'b011: out = 8'b00001000;" in got[5][0][0] and "// Output 3 active" in got[5][0][0]
    assert got[5][0][1] == ""


def random_pairs(n, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "  a", "", "x  y", "x y", "end"]
    pairs = []
    for _ in range(n):
        old = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        new = list(old)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(0, len(new) + 1)
            action = rng.random()
            if action < 0.4:
                new.insert(at, rng.choice([*words, "new"]))
            elif new and action < 0.7:
                del new[at % len(new)]
            elif new:
                new[at % len(new)] = "changed"
        end = rng.choice(["\n", "\r\n"])
        pairs.append((end.join(old), "\n".join(new) + rng.choice(["", "\n"])))
    # Long texts with popular lines exercise the heuristic that only the exact mode uses.
    long_old = [rng.choice(words) for _ in range(400)]
    pairs.append(("\n".join(long_old), "\n".join(["top", *long_old[:150], "mid", *long_old[155:]])))
    return pairs


@pytest.mark.parametrize("mode", [NORMALIZED, EXACT])
def test_random_pairs(spark, mode):
    pairs = random_pairs(150, seed=11)
    assert chunks(spark, pairs, mode) == [expected_chunks(a, b, mode) for a, b in pairs]


@pytest.mark.parametrize("mode", [NORMALIZED, EXACT])
def test_opcodes(spark, mode):
    pairs = random_pairs(60, seed=12)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair_id int, base_code string, buggy_code string")
    got = [[] for _ in pairs]
    for r in opcode_table(df, mode=mode).orderBy("pair_id", "pos").collect():
        got[r.pair_id].append((r.tag, r.i1, r.i2, r.j1, r.j2))
    for (old, new), ops in zip(pairs, got):
        keep = mode == EXACT
        a, b = old.splitlines(keepends=keep), new.splitlines(keepends=keep)
        if not keep:
            a, b = ([" ".join(x.split()) for x in s] for s in (a, b))
        assert ops == SequenceMatcher(None, a, b, autojunk=keep).get_opcodes()


def test_kernel_runs_once(spark, tmp_path):
    """No filter may be pushed below the kernel: that would run it a second time."""
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([(1, "a", "b")], "pair_id int, base_code string, buggy_code string").write.parquet(path)
    plan = chunk_table(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan


def test_unknown_mode(spark):
    df = spark.createDataFrame([(1, "a", "b")], "pair_id int, base_code string, buggy_code string")
    with pytest.raises(ValueError, match="unknown diff mode"):
        chunk_table(df, mode="other")


@pytest.mark.parametrize("heuristic", [False, True])
def test_run_finder_equals_the_stdlib(heuristic):
    find = make_run_finder(heuristic)
    rng = random.Random(31)
    for size in [40] * 300 + [450] * 60:
        letters = rng.choice(["ab", "abcdef", [str(i) for i in range(300)]])
        a = [rng.choice(letters) for _ in range(rng.randrange(0, size))]
        b = list(a) if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randrange(0, size))]
        for _ in range(rng.randrange(0, 5)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(letters)
        want = [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=heuristic).get_matching_blocks() if x.size]
        assert find(a, b) == want


@pytest.mark.parametrize("heuristic", [False, True])
def test_repeated_lines_stay_fast(heuristic):
    """Half of 60,000 lines alike: the stdlib matcher alone would visit 900 million pairs."""
    rng = random.Random(32)
    a = ["end" if i % 2 else f"line {i}" for i in range(60_000)]
    b = list(a)
    for _ in range(20):
        b[rng.randrange(len(b))] = "changed"
    runs = make_run_finder(heuristic)(a, b)
    assert 20 <= len(runs) <= 60 and all(a[i : i + n] == b[j : j + n] for i, j, n in runs)


def test_run_kernel_makes_no_line_an_object():
    old = pa.array([[f"line {i} {k} " + "x" * 60 for k in range(30)] for i in range(5_000)])
    new = pa.array([[f"line {i} {k + (k == 3)} " + "x" * 60 for k in range(30)] for i in range(5_000)])
    tracemalloc.start()
    out = make_run_kernel(False)(old, new)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].as_py() == [0, 0, 3, 4, 4, 26] and len(out) == 5_000
    assert peak < 4_000_000  # the lines take 20 MB, as objects of Python 40


def test_run_kernel_null_empty_and_sliced_rows():
    old = pa.array([["x"], None, ["a", None, "b"], [], ["a"], ["a", "b"]])
    new = pa.array([["y"], ["a"], ["a", None, "c"], [], None, ["b"]])
    assert make_run_kernel(False)(old, new).to_pylist() == [[], None, [0, 0, 2], [], None, [1, 0, 1]]
    assert make_run_kernel(True)(old[2:], new[2:]).to_pylist() == [[0, 0, 2], [], None, [1, 0, 1]]
    assert make_run_kernel(True)(old[:0], new[:0]).to_pylist() == []
