import random
import re

import pytest
from faultloom.functions.masking import KINDED, PLAIN, mask, unmask
from pyspark.sql import functions as F

SAMPLE = "a = 2'b00; b = 2'd1; // c\nx /* y */ \"s\\\"t\" z"
# The same hits for a regex engine without possessive loops.
PLAIN_PATTERNS = {
    "kinded": r"/\*[\s\S]*?\*/|//[^\n]*\n?|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
    "plain": r"(?sm://.*?$|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')",
}
STYLES = {"kinded": KINDED, "plain": PLAIN}


def run(spark, texts, style, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    masked = df.withColumn("m", mask(F.col("t"), style, **options)).select("i", "m.*")
    back = masked.withColumn("back", unmask(F.col("masked"), F.col("hits"), style))
    return [(r.masked, r.hits, r.back) for r in back.orderBy("i").collect()]


def test_hits(spark):
    [(masked, hits, back)] = run(spark, [SAMPLE], KINDED)
    assert hits == ["'b00; b = 2'", "// c\n", "/* y */", '"s\\"t"']
    assert masked == (
        "a = 2__OBFUSCATE_MASK_STR_SQ_0__d1; __OBFUSCATE_MASK_CMT_LINE_1__x "
        "__OBFUSCATE_MASK_CMT_BLOCK_2__ __OBFUSCATE_MASK_STR_DQ_3__ z"
    )
    assert back == SAMPLE
    [(masked, hits, back)] = run(spark, [SAMPLE], PLAIN)
    assert hits[1] == "// c" and "__MSK_1__\nx" in masked and back == SAMPLE


def test_based_literals_can_be_stepped_over(spark):
    [(masked, hits, back)] = run(spark, [SAMPLE], PLAIN, keep_based_literals=True)
    assert masked == "a = 2'b00; b = 2'd1; __MSK_0__\nx __MSK_1__ __MSK_2__ z"
    assert hits == ["// c", "/* y */", '"s\\"t"'] and back == SAMPLE


@pytest.mark.parametrize("name", STYLES)
@pytest.mark.parametrize("keep", [False, True])
def test_random_texts(spark, name, keep):
    rng = random.Random(9)
    parts = ["//", "/*", "*/", '"', "'", "\\", "\n", "a", " ", "2'b01", "\r", "\u2028", "é", "_0__", "x'hF"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    texts += ["", '"' + "\\x" * 20000 + '"', "/*" + "*" * 20000 + "*/", "'" + "y" * 50000 + "'", "// end"]
    for text, (masked, hits, back) in zip(texts, run(spark, texts, STYLES[name], keep_based_literals=keep)):
        assert back == text
        if not keep:
            assert hits == re.findall(PLAIN_PATTERNS[name], text)
            assert len(re.findall(STYLES[name].placeholder_pattern, masked)) == len(hits)


def test_placeholder_like_text_without_a_hit_stays(spark):
    texts = ["__MSK_7__ // c", "__MSK_99999999999999__ 'q'", "__MSK_1__"]
    assert [back for _, _, back in run(spark, texts, PLAIN)] == texts


def test_placeholder_inside_a_comment_stays(spark):
    text = "// see __MSK_1__\nx 'q' // __MSK_0__"
    assert run(spark, [text], PLAIN)[0][2] == text
