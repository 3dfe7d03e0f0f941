"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from check_oracles import rows_of  # noqa: E402
from faultloom.llm import toxicity  # noqa: E402
from faultloom.llm.oracles import ORACLES  # noqa: E402
from faultloom.llm.queries import QUERIES  # noqa: E402
from faultloom.llm.simhash_dedup import fingerprint  # noqa: E402
from tests.llm.test_llm import brute_components, brute_contamination, brute_repeats, byte_encoding  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "byte_level_bpe"
    ]


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.toxicity_model(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    score = toxicity.Scorer(*model)
    rows = {k: t for k, t in rows.items() if score(t) < 0.5}
    prints = {k: fingerprint((t or "").encode()) for k, t in rows.items()}
    near = [(a, b) for a in rows for b in rows if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    comp = brute_components(rows, near)
    rows = {k: t for k, t in rows.items() if comp[k] == k}
    cut = brute_repeats([t.encode() for t in rows.values()], 200)
    rows = {k: c[4].decode(errors="ignore") for k, c in zip(rows, cut)}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {k for (k, *_, hit) in brute_contamination(rows.items(), items) if hit}
    encode = byte_encoding().encode_ordinary
    want = {}
    for k, t in rows.items():
        if k not in bad:
            ids = encode(t)
            want[k] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want and len(want) < docs.count()


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


