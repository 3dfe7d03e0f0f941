"""Long single documents: work per row must not grow with the square of its length.

Each case keeps only one output column, so that the optimizer is free to merge the steps before it.
"""

import time

import pytest
from faultloom.functions.masking import KINDED, PLAIN, mask, unmask
from faultloom.operators.chunking import order_map, reorder_chunks, shuffle_documents, split_chunks
from faultloom.operators.diffs import chunk_table, opcode_table
from faultloom.operators.renaming import accepted_map, judge_entries, rename_tokens
from faultloom.functions.text import first_json_object, identifier_tokens, json_entries
from faultloom.plans.rename_corpus import apply_rename_responses
from pyspark.sql import functions as F

N = 20_000
LINES = [f"  wire sig_{i} ; // c{i}" for i in range(N)]
TEXT = "module m (a);\n" + "\n".join(LINES) + "\nendmodule\n"
JSON = "{" + ",".join(f'"sig_{i}":"s{i}"' for i in range(N)) + "}"


@pytest.fixture
def document(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    rows = [(1, TEXT, TEXT.replace("sig_77 ", "sig_x "), JSON)]
    spark.createDataFrame(rows, "doc_id int, text string, other string, llm_response string").write.parquet(path)
    return spark.read.parquet(path)


def seconds(df):
    start = time.time()
    [row] = df.collect()
    return time.time() - start, row


CASES = {
    "rename": lambda d: apply_rename_responses(d, text="text").select("renamed"),
    "rename_masked": lambda d: apply_rename_responses(d, text="text", mask_first=True).select(F.md5("renamed")),
    "rename_steps": lambda d: d.withColumn("e", json_entries(F.col("llm_response")))
    .withColumn("t", identifier_tokens(F.col("text")))
    .withColumn("v", judge_entries(F.col("e"), F.col("t")))
    .withColumn("m", accepted_map(F.col("v")))
    .select(F.md5(rename_tokens(F.col("text"), F.col("m")))),
    "rename_tokens": lambda d: d.withColumn("m", F.from_json("llm_response", "map<string,string>")).select(
        F.md5(rename_tokens(F.col("text"), F.col("m")))
    ),
    "shuffle_text": lambda d: shuffle_documents(d).select(F.md5("text")),
    "shuffle_order": lambda d: shuffle_documents(d).select(F.md5("order_json")),
    "chunk_steps": lambda d: d.withColumn("c", split_chunks(F.col("text")))
    .withColumn("p", reorder_chunks(F.col("c"), level="medium"))
    .select(F.size(order_map(F.col("p"), "medium"))),
    "json_search": lambda d: d.select(F.md5(first_json_object(F.concat(F.lit("say "), F.replace("llm_response", F.lit(","), F.lit(',"}":{},')), F.lit(" }"))))),
    "mask": lambda d: d.withColumn("m", mask(F.col("text"), KINDED)).select(F.md5("m.masked")),
    "unmask": lambda d: d.withColumn("h", mask(F.col("text"), PLAIN)["hits"])
    .withColumn("k", mask(F.col("other"), PLAIN)["masked"])
    .select(F.md5(unmask(F.col("k"), F.col("h"), PLAIN))),
    "diff": lambda d: chunk_table(d, key="doc_id", old="text", new="other").select("new_version"),
    "diff_every_other_line": lambda d: opcode_table(
        d.withColumn("other", F.regexp_replace("text", r"([02468] ; [^\n]*)", "$1 x")), key="doc_id", old="text", new="other"
    ).agg(F.count("*")),
}


@pytest.mark.parametrize("name", CASES)
def test_long_document(document, name):
    spent, _ = seconds(CASES[name](document))
    assert spent < 30


def test_results_on_the_long_document(document):
    [row] = apply_rename_responses(document, text="text").select("renamed", "status").collect()
    assert row.status == "succeeded"
    assert f"wire s{N - 1} ;" in row.renamed and "sig_" not in row.renamed
    [row] = chunk_table(document, key="doc_id", old="text", new="other").collect()
    assert (row.old_version, row.new_version) == ("wire sig_77 ; // c77", "wire sig_x ; // c77")
