import hashlib
import re
import textwrap

from faultloom.functions.prompts import (
    DETECTION_PROMPTS,
    RENAME_PROMPT,
    detection_prompt,
    record_key,
    rename_prompt,
    time_ordered_uuid,
)
from pyspark.sql import functions as F

SOURCES = [
    "module a;\n  wire b;\n\n   \nendmodule\n",
    "    all\n      indented\n    deep\n",
    "first\n  two\n    four",
    "first\n\tone tab\n  two",
    "first\n  \tmixed\n   three",
    "one line",
    "",
    "\n\n  after blanks\n",
    "braces {content} {x} stay",
    "\r\n  cr\r\n",
    "é\n nbsp first\n   x",
]


def test_detection_prompts(apply):
    for version in ("v1", "v2"):
        got = apply(lambda c, v=version: detection_prompt(c, v), SOURCES)
        for text, prompt in zip(SOURCES, got):
            assert prompt.startswith('\n"A malicious actor ') and prompt.endswith(f"```systemverilog\n{text}\n```\n")
            assert 'then say "No modifications detected".' in prompt
    assert "may have modified" in DETECTION_PROMPTS["v2"] and "has modified" in DETECTION_PROMPTS["v1"]


def test_rename_prompt_is_dedented_after_filling(apply):
    got = apply(rename_prompt, SOURCES)
    want = [textwrap.dedent(RENAME_PROMPT.replace("{content}", text)).strip() for text in SOURCES]
    assert got == want
    assert "--- BEGIN CODE ---\nfirst\n  two" not in got[2] and got[5].splitlines()[1].startswith("Identify")


def test_record_key(spark):
    df = spark.createDataFrame([("p", "q", "m"), ("p", "q", "m"), ("pq", "", "m")], "a string, b string, c string")
    keys = [r[0] for r in df.select(record_key(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert keys[0] == keys[1] != keys[2]
    assert keys[0] == hashlib.sha256(b"p\x1fq\x1fm").hexdigest()


def test_time_ordered_uuid(spark):
    ids = [r[0] for r in spark.range(50).select(time_ordered_uuid()).collect()]
    shape = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")
    assert len(set(ids)) == 50 and all(shape.fullmatch(i) for i in ids)
