import json
import random

from faultloom.functions.paths import is_system_verilog, output_folder, suffix, with_suffix_prefix
from faultloom.functions.text import (
    code_blocks,
    collapse_whitespace,
    first_json_object,
    is_identifier,
    json_entries,
    normalized_lines,
    split_lines,
    split_lines_keeping_ends,
    strip,
)
from pyspark.sql import functions as F

ODD = "ab é \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u200a\u200b\u2028\u2029\u202f\u205f\u3000漢"


def random_texts(n=300, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 25))) for _ in range(n)]
    return texts + ["", "\r\n", "\r\n\n", "\n\r\n", "a\r\nb\rc\n", "x" * 5000 + "\n" + " " * 5000]


def test_whitespace_matches_python(apply):
    texts = random_texts()
    assert apply(collapse_whitespace, texts) == [" ".join(t.split()) for t in texts]
    assert apply(strip, texts) == [t.strip() for t in texts]


def test_lines_match_python(apply):
    texts = random_texts(seed=2)
    assert apply(split_lines, texts) == [t.splitlines() for t in texts]
    assert apply(split_lines_keeping_ends, texts) == [t.splitlines(keepends=True) for t in texts]
    assert apply(normalized_lines, texts) == [[" ".join(x.split()) for x in t.splitlines()] for t in texts]


MARKDOWN = [
    ("\nSome text before\n```\ndef hello():\n    print(\"Hello\")\n```\nSome text after\n", ['def hello():\n    print("Hello")']),
    ("\nFirst block:\n```\ncode1\n```\nSecond block:\n```\ncode2\n```\n", ["code1", "code2"]),
    ("\n```\n```\n", [""]),
    ("Just some regular text\nwith no code blocks", []),
    ("", []),
    ("\n```python\ndef test():\n    pass\n```\n", ["def test():\n    pass"]),
    ("\n```\ndef incomplete():\nprint(\"missing closing backticks\")\n", []),
    ("\n```\nx = `command`\nnot ``` a delimiter\n```\n", ["x = `command`\nnot ``` a delimiter"]),
    ("\n```\n  indented code\n```\n", ["  indented code"]),
    ("\n```\nline1\n\nline3\n```\n", ["line1\n\nline3"]),
    ("\n```\nblock1\n```\n```\nblock2\n```\n", ["block1", "block2"]),
    ("\n```\ndef outer():\n    def inner():\n        pass\n```\n", ["def outer():\n    def inner():\n        pass"]),
    ("\n```javascript\nconst x = 5;\n```\n\n```python\ny = 10\n```\n", ["const x = 5;", "y = 10"]),
    (
        "\n# My Document\n\n```python\ndef fibonacci(n):\nreturn n\n```\n\nAnd:\n\n```javascript\nfunction factorial(n) {\n}\n```\n\nEnd.\n",
        ["def fibonacci(n):\nreturn n", "function factorial(n) {\n}"],
    ),
    # Unicode blanks before a fence, other line ends, four backticks, a block after an unclosed one.
    ("\u3000```\r\na\r\n\u00a0````\nrest", ["a"]),
    ("```\na\n```\n```\nb", ["a"]),
]


def test_code_blocks(apply):
    assert apply(code_blocks, [m for m, _ in MARKDOWN]) == [b for _, b in MARKDOWN]


def test_code_blocks_null(apply):
    assert apply(code_blocks, [None, "x"]) == [[], []]


JSON_TEXTS = [
    ('Sure: {"a":"x","n":{"k":"}"}} and {"z":1}', '{"a":"x","n":{"k":"}"}}'),
    ("none", None),
    ('{bad} {"q":1}', None),
    ("{'a':'b'}", None),
    ("} first {} then", "{}"),
    ('{"a": NaN}', None),
    ('{"a": "b"', None),
    ('```json\n{"a": "}{",\n "b": "\\"}"}\n```', '{"a": "}{",\n "b": "\\"}"}'),
    ('{"a":"x","a":"y"}', '{"a":"x","a":"y"}'),
    (None, None),
]


def test_first_json_object(apply):
    assert apply(first_json_object, [t for t, _ in JSON_TEXTS]) == [j for _, j in JSON_TEXTS]


def test_first_json_object_matches_search(apply):
    """Against trying every end in plain Python, on random brace soup."""
    rng = random.Random(3)
    parts = ["{", "}", '"a"', ":", "1", ",", " ", '"}"', '"b"', "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += ['x {"a":{"b":[1,2,{"c":"}}"}]}} y }', '{"a"} {"b":1}', '{"a":1}}']

    def expected(text):
        start = text.find("{")
        for end in range(start, len(text)):
            if start >= 0 and text[end] == "}":
                try:
                    json.loads(text[start : end + 1])
                    return text[start : end + 1]
                except ValueError:
                    pass
        return None

    assert apply(first_json_object, texts) == [expected(t) for t in texts]


def test_json_entries_keep_order_and_last_value(apply):
    [entries, empty, nothing] = apply(json_entries, ['{"b":"1","a":2,"b":"3","c":null}', "{}", None])
    assert [tuple(e) for e in entries] == [(0, "b", "3", True), (1, "a", "2", False), (2, "c", None, False)]
    assert empty == [] and nothing is None


def test_identifiers(apply):
    names = ["a", "_x$1", "9a", "", "a b", "a\n", "é", "$a"]
    assert apply(is_identifier, names) == [True, True, False, False, False, False, False, False]


def test_paths(apply, spark):
    paths = ["a/b.sv", "a/.rc", "b", "x.tar.gz", "foo.", "a.b/c", "d/e.SVH"]
    assert apply(suffix, paths) == [".sv", "", "", ".gz", "", "", ".SVH"]
    assert apply(is_system_verilog, paths) == [True, False, False, False, False, False, True]
    assert apply(with_suffix_prefix, ["a/b.sv", "c"]) == ["a/b.obf.sv", "c.obf"]
    branches = ["fix_cwe#12()", "fix-x_fix_y", "plain"]
    assert apply(lambda b: output_folder(F.lit("r"), b), branches) == ["r_cwe_12", "r_x_y", "r_plain"]
