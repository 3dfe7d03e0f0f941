import hashlib
import json
import random
import time
from pathlib import Path

import pytest
from faultloom.plans.analyze import analyze_file
from faultloom.plans.collect import build_prompts, collect_responses, collect_to_log
from faultloom.plans.rename_corpus import rename_corpus
from faultloom.plans.shuffle_corpus import shuffle_corpus, write_shuffled
from faultloom.operators.responses import join_responses, one_per_key
from faultloom.schemas import RESPONSES
from faultloom.sources.corpus import export_files, export_tree, exported_manifest, rewritten, scan_corpus
from faultloom.sources.csv_records import csv_records
from faultloom.sources.log import append_log, read_log
from faultloom.sources.scratch import arrow_uri, shared_dir
from faultloom.sources.tables import analysis_dir, current_version, path_suffix, read_table, write_csv, write_three_ways
from faultloom.streaming.live import follow_log
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

AWKWARD = [
    ("u1", "c/buggy.sv", 'line "one"\nline, two\r\n\ttab', "p", "Found\n```\nx\n```\nwell over twenty", "m"),
    ("u2", "c/base.sv", "é \\ back\\slash", "", "No modifications detected", "m"),
    ("u3", "d/base.sv", None, "p", "short", "m"),
]


@pytest.fixture
def responses(spark):
    return spark.createDataFrame(AWKWARD, RESPONSES)


def test_suffixes():
    assert path_suffix("a/b.parquet/") == ".parquet"
    assert path_suffix("a.b/c") == path_suffix("a/.pq") == ""
    assert analysis_dir("/x/data.jsonl") == "/x/data_analysis" and analysis_dir("/x/data") == "/x/data_analysis"


@pytest.mark.parametrize("name", ["t.parquet", "t.parq", "t.pq", "t.csv", "t.jsonl", "t.ndjson"])
def test_read_by_extension(spark, responses, tmp_path, name):
    path = str(tmp_path / name)
    if name.endswith("csv"):
        responses.write.options(header=True, escape='"').csv(path)
    elif "json" in name:
        responses.write.json(path)
    else:
        responses.write.parquet(path)
    back = {r.uuid: r for r in read_table(spark, path, RESPONSES).collect()}
    assert [tuple(back[r[0]])[2] for r in AWKWARD] == [r[2] for r in AWKWARD]


@pytest.mark.parametrize("name", ["t.CSV", "t.json", "t", "t.txt"])
def test_other_extensions_are_refused(spark, name):
    with pytest.raises(ValueError, match="Unsupported file format"):
        read_table(spark, f"/nowhere/{name}")


def test_three_formats(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b,\"c\"\nd", "2")], "x string, y string")
    where = write_three_ways(df, str(tmp_path), "m")
    want = sorted(map(tuple, df.collect()))
    for name in ("m.pq", "m.ndjson", "m.csv"):
        assert sorted(map(tuple, read_table(spark, f"{where}/{name}", df.schema).collect())) == want
    # A version that fails half way is never the current one.
    with pytest.raises(Exception, match="late failure"):
        write_three_ways(df.withColumn("x", F.raise_error(F.lit("late failure")).cast("string")), str(tmp_path), "m")
    assert current_version(spark, str(tmp_path)) == where
    assert write_three_ways(df.limit(1), str(tmp_path), "m") == current_version(spark, str(tmp_path)) != where
    assert read_table(spark, f"{where}/m.csv", df.schema).count() == 2


def csv_texts(n):
    rng = random.Random(n)
    odd = [None, "x", '"', "a,b", "\r\n", '""', ',\n"q"\n', "é\\", "  s ", '\\"', 'a"b', "\n", "\n\n"]
    return [
        rng.choice(odd) if rng.random() < 0.4 else "".join(rng.choice('ab,"\n\r\\ é') for _ in range(rng.randint(1, 400))) for _ in range(n)
    ]


@pytest.mark.parametrize("split", ["900", "2500", "128m"])
def test_csv_files_are_read_by_many_tasks(spark, tmp_path, split):
    """Line ends in quotes at every border of a split, some records longer than several splits."""
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(csv_texts(300), csv_texts(301)[1:]))]
    df = spark.createDataFrame(rows, "id long, `a b` string, c string")
    path = str(tmp_path / "t.csv")
    write_csv(df.repartition(3), path)
    kept = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        back = read_table(spark, path, df.schema)
        assert split == "128m" or csv_records(spark, path).rdd.getNumPartitions() > 12
        assert sorted(map(tuple, back.collect())) == rows
        untyped = read_table(spark, path)
        assert untyped.columns == df.columns and untyped.count() == 300
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_csv_as_others_write_it(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'id,"t, x"\r\n1,"a\r\nb"\r\n\r\n2,plain\r\n3,"open\n')
    got = read_table(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["id", "t, x"]
    assert [tuple(r) for r in got.where("id < 3").orderBy("id").collect()] == [("1", "a\r\nb"), ("2", "plain")] and got.count() == 3
    (tmp_path / "none.csv").write_bytes(b"")
    assert read_table(spark, str(tmp_path / "none.csv"), got.schema).count() == 0
    (tmp_path / "head.csv").write_bytes(b"id,t\n")
    assert read_table(spark, str(tmp_path / "head.csv")).columns == ["id", "t"]


@pytest.fixture
def corpus_dir(tmp_path):
    root = tmp_path / "my corpus+x"
    files = {
        "a/buggy.sv": "module a;\r\n  wire w;\rendmodule\n",
        "a/base.v": "module a;\n endmodule",
        "b c/deep/x%20y+z.sv": "wire é;",
        "b c/skip.svh": "no",
        "skip.txt": "no",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    (root / "a/bad.v").write_bytes(b"wire \xc3;")
    (root / "dir.v").mkdir()
    # Left out by Spark's own listing.
    (root / "a/_private.v").write_text("wire h;\r\n")
    (root / "b c/.hidden/deep").mkdir(parents=True)
    (root / "b c/.hidden/deep/h.sv").write_text("wire k;")
    (root / "b c/empty.sv").touch()
    (root / "_top.v").write_text("top")
    return root


def test_scan_corpus(spark, corpus_dir):
    rows = {r.path: r for r in scan_corpus(spark, str(corpus_dir)).collect()}
    listed = {"a/buggy.sv", "a/base.v", "a/bad.v", "b c/deep/x%20y+z.sv"}
    assert set(rows) == listed | {"a/_private.v", "b c/.hidden/deep/h.sv", "b c/empty.sv", "_top.v"}
    assert rows["a/_private.v"].content == "wire h;\n" and rows["b c/empty.sv"].content == ""
    assert {r.path for r in scan_corpus(spark, str(corpus_dir), complete=False).collect()} == listed
    assert rows["a/buggy.sv"].content == "module a;\n  wire w;\nendmodule\n"
    assert not rows["a/bad.v"].valid_utf8 and rows["b c/deep/x%20y+z.sv"].valid_utf8
    by_uri = scan_corpus(spark, f"file://{corpus_dir}").collect()
    assert {r.path for r in by_uri} == set(rows)


def test_relative_root(spark, corpus_dir, monkeypatch):
    # The JVM keeps its own working directory, so go there and back.
    relative = Path("..") / Path(*[".."] * 40) / str(corpus_dir)[1:]
    assert {r.path for r in scan_corpus(spark, str(relative)).collect()} >= {"a/base.v"}


def test_collect_resumes(spark, corpus_dir, tmp_path):
    corpus = scan_corpus(spark, str(corpus_dir), complete=False).where("valid_utf8")
    log = str(tmp_path / "log.ndjson")

    def flaky(prompt):
        if "endmodule" in prompt:
            raise TimeoutError("slow")
        return "  No modifications detected \n"

    collect_to_log(corpus, flaky, log, model="m")
    first = read_table(spark, log, RESPONSES)
    assert [r.llm_response for r in first.collect()] == ["No modifications detected"]
    collect_to_log(corpus, lambda prompt: "again", log, model="m", log=first, concurrency=3)
    rows = read_table(spark, log, RESPONSES).collect()
    assert len(rows) == 3 and sorted(r.llm_response for r in rows) == ["No modifications detected", "again", "again"]
    # A repeated run asks nothing; one that is made to ask adds nothing.
    collect_to_log(corpus, lambda prompt: 1 / 0, log, model="m")
    collect_to_log(corpus, lambda prompt: "third", log, model="m", log=first.limit(0))
    everything = read_table(spark, log, RESPONSES)
    assert everything.count() == one_per_key(everything).count() == 3 and everything.where("llm_response = 'third'").isEmpty()
    joined = join_responses(build_prompts(corpus, model="m"), one_per_key(everything))
    assert joined.where("llm_response is null").count() == 0
    ordered = collect_responses(corpus, str.upper, model="m", ordered=True)
    assert ordered.columns == [*RESPONSES.names, "error"]
    paths = [r.input_file_rel_path for r in ordered.collect()]
    assert paths == sorted(paths) and len(paths) == 3


def test_log_after_failures(spark, tmp_path):
    """A run that fails, one that ends between writing and moving, and one that ends between two moves."""
    path = str(tmp_path / "log.ndjson")
    schema = "uuid string, v string"
    rows = spark.range(30).selectExpr("'k' || (id % 25) as uuid", "'v' || (id % 25) as v")
    assert read_log(spark, path, rows.schema).count() == 0
    broken = rows.withColumn("v", F.when(F.col("uuid") == "k7", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        append_log(broken, path)
    append_log(rows.where("uuid < 'k2'"), path)
    assert read_log(spark, path, rows.schema).count() == 12
    run = tmp_path / "log.ndjson" / "_runs" / "run-a"
    rows.where("uuid >= 'k2' and uuid < 'k5'").dropDuplicates().repartition(4).write.json(str(run))
    assert read_log(spark, path, rows.schema).count() == 12  # hidden so far
    for part in list(run.glob("part-*"))[:2]:
        part.rename(tmp_path / "log.ndjson" / f"run-a-{part.name}")
    half = tmp_path / "log.ndjson" / "_runs" / "run-b"
    rows.limit(3).write.json(str(half))
    (half / "_SUCCESS").unlink()
    append_log(rows.unionByName(rows), path)
    for _ in range(2):
        got = sorted(tuple(r) for r in spark.read.schema(schema).json(path).collect())
        assert got == sorted((f"k{i}", f"v{i}") for i in range(25))
        append_log(rows, path)
    with pytest.raises(Exception, match="without a key"):
        append_log(rows.withColumn("uuid", F.lit(None).cast("string")), path)


def test_rounds_cover_the_corpus(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('c', id, '/base.v') as path", "concat('wire w', id, ';') as content")
    collect_to_log(rows, lambda prompt: "No modifications detected", str(tmp_path / "log"), model="m", rounds=3)
    logged = spark.read.schema(RESPONSES).json(str(tmp_path / "log"))
    assert logged.count() == logged.select("uuid").distinct().count() == 40


def test_ordered_collection_asks_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def responder(prompt):
        (asked / f"{abs(hash(prompt))}-{time.time_ns()}").touch()
        return "No modifications detected"

    rows = spark.range(40).selectExpr("concat('c', id, '/base.v') as path", "concat('wire w', id, ';') as content")
    assert collect_responses(rows.repartition(4), responder, model="m", ordered=True).collect()
    assert len(list(asked.iterdir())) == 40


def test_analyze_file(spark, responses, tmp_path):
    path = str(tmp_path / "r.parquet")
    responses.write.parquet(path)
    out = analyze_file(spark, path)
    rows = spark.read.parquet(f"{out}/10_llm_bug_detection_data_with_analysis.pq")
    assert rows.count() == 3 and {"challenge_id", "llm_prompt"} <= set(rows.columns)
    matrix = {(r[0], r[1]): (r[2], r[3]) for r in spark.read.parquet(f"{out}/confusion_matrix.pq").collect()}
    assert matrix["no_bug", "response_very_short"] == (1, 33.33)
    assert spark.read.parquet(f"{out}/results_by_challenge.pq").count() == 2


def test_rename_and_export(spark, corpus_dir, tmp_path):
    corpus = scan_corpus(spark, str(corpus_dir), complete=False).where("valid_utf8")
    renamed = rename_corpus(corpus, lambda prompt: '{"w": "w2", "a": "top"}')
    out = tmp_path / "out dir"
    written = export_files(rewritten(renamed), out.as_uri(), content="renamed").collect()
    assert all(r.error is None for r in written)
    assert (out / "a/buggy.obf.sv").read_text() == "module top;\n  wire w2;\nendmodule\n"
    assert (out / "b c/deep/x%20y+z.obf.sv").read_text() == "wire é;"
    in_place = {r.out_path for r in rewritten(renamed, in_place=True).select("out_path").collect()}
    assert in_place == {"a/buggy.sv", "a/base.v", "b c/deep/x%20y+z.sv"}


def test_export_after_a_lost_attempt(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "taken").write_text("a file where a folder is needed")
    files = spark.createDataFrame([("a/f.v", b"one"), ("taken/g.v", b"two"), ("h.v", b"")], "out_path string, content binary")
    with pytest.raises(OSError, match="1 files could not be written, the first is taken/g.v"):
        export_tree(files, root.as_uri())
    assert (root / "a/f.v").read_bytes() == b"one" and not list(root.rglob("*.part"))
    with pytest.raises(Exception):
        exported_manifest(spark, root.as_uri())
    (root / "taken").unlink()
    (root / "a/.old.part").write_bytes(b"on")  # what a lost attempt may leave: never under a final name
    export_tree(files, root.as_uri())
    listed = {r.path: (r.n_bytes, r.sha256) for r in exported_manifest(spark, root.as_uri()).collect()}
    assert listed == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("a/f.v", b"one"), ("taken/g.v", b"two"), ("h.v", b""))}
    scanned = {r.path: r.content for r in scan_corpus(spark, root.as_uri()).collect()}
    assert scanned == {"a/f.v": "one", "taken/g.v": "two", "h.v": ""}


def test_shared_folder_is_not_made_up_on_a_cluster(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    assert arrow_uri("s3a://b/k") == arrow_uri("s3n://b/k") == "s3://b/k" and arrow_uri("hdfs://h/k") == "hdfs://h/k"


def test_shuffle_and_side_file(spark, tmp_path):
    corpus = spark.createDataFrame([("f.sv", "module m\n  wire a;\n  wire b;\n  wire c;\nendmodule\n")], "path string, content string")
    where = write_shuffled(shuffle_corpus(corpus, seed=4), str(tmp_path / "s"))
    [row] = spark.read.json(f"{where}/order_maps.ndjson").collect()
    assert row.path == "f.sv" and sorted(json.loads(row.order_json)["m"]["decl"]) == ["DECL_000001", "DECL_000003", "DECL_000005"]


def test_follow_log(spark, responses, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    for batch in (responses, responses.limit(1)):
        batch.write.mode("append").json(log)
        follow_log(spark, log, out, state, once=True).awaitTermination(120)
    rows = {(r[0], r[1]): (r[2], r[3]) for r in spark.read.parquet(out).collect()}
    assert sum(n for n, _ in rows.values()) == 4
    assert rows["contains_bug", "contains_bug"] == (2, 50.0)


def test_scan_corpus_keeps_no_list_of_files_in_the_driver(spark, tmp_path):
    names = ["top.v", ".hidden.sv", "a/one.v", "a/b/two.sv", "a/b/c/d/three.v", "a/.deep/four.v", "_x/five.sv", "a/b/note.txt", "e/empty.v"]
    names += [f"many/f{i}.sv" for i in range(300)]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else f"{name}\r\n".encode())
    (tmp_path / "nothing").mkdir()
    scanned = scan_corpus(spark, str(tmp_path))
    assert scanned.inputFiles() == []
    rows = scanned.collect()
    wanted = {n: "" if "empty" in n else n + "\n" for n in names if not n.endswith(".txt")}
    assert {r.path: r.content for r in rows} == wanted and len(rows) == len(wanted)
    assert scan_corpus(spark, str(tmp_path / "nothing")).collect() == []
    with pytest.raises(AnalysisException):
        scan_corpus(spark, str(tmp_path / "absent"))
