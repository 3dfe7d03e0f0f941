import json

import pytest
from faultloom.operators.snapshots import (
    all_changes,
    branch_names,
    changed_paths,
    known_overrides,
    select_branches,
    union_metadata,
)
from faultloom.sources.tables import current_version
from faultloom.plans.pair_corpus import build_pair_corpus, corpus_files, write_pair_corpus
from faultloom.schemas import BRANCH_METADATA, OVERRIDES
from faultloom.sources.corpus import export_files, scan_corpus

SNAPSHOT = "repo string, branch string, side string, path string, content string"
# (branch, path, base content, tip content); None means the file is absent on that side.
FILES = [
    ("one", "src/a.sv", "old", "new"), ("one", "src/same.sv", "s", "s"), ("one", "README.md", "x", "y"),
    ("none", "src/a.sv", "same", "same"), ("readme", "README.md", "x", "y"),
    ("many", "b.v", "1", "2"), ("many", "a.v", "1", "2"),
    ("new", "added.v", None, "n"), ("gone", "gone.v", "g", None),
    ("moved", "old.v", "m", None), ("moved", "dir/new.v", None, "m"),
    ("edited_move", "old.v", "m", None), ("edited_move", "new.v", None, "m2"),
    ("dup", "a.v", "1", "2"),
    ("choice", "x.v", "1", "2"), ("choice", "y.sv", "1", "2"),
    ("wrong", "x.v", "1", "2"), ("wrong", "y.sv", "1", "2"), ("wrong", "z.sv", "1", "2"),
    ("empty", "e.v", "", "now"),
]
RULES = [
    ("r", "dup", "skip", None, None),
    ("r", "choice", "choose", ["x.v", "y.sv"], "y.sv"),
    ("r", "wrong", "choose", ["x.v", "y.sv"], "x.v"),
    ("r", "one", "choose", ["q.v", "w.v"], "q.v"),
]


@pytest.fixture(scope="module")
def snapshots(spark):
    rows = []
    for branch, path, base, tip in FILES:
        rows += [("r", branch, side, path, c) for side, c in (("base", base), ("tip", tip)) if c is not None]
    return spark.createDataFrame(rows, SNAPSHOT)


@pytest.fixture(scope="module")
def branches(spark):
    names = sorted({f[0] for f in FILES} | {"untouched"})
    return spark.createDataFrame(
        [("r", n, "https://example.org/r", "b" + n, "t" + n) for n in names],
        "repo string, branch string, git_repo string, base_commit string, tip_commit string",
    )


@pytest.fixture(scope="module")
def overrides(spark):
    rows = [(r, b, a, path, chosen) for r, b, a, paths, chosen in RULES for path in paths or [None]]
    return spark.createDataFrame(rows, OVERRIDES)


def test_contradictory_overrides(snapshots, branches, overrides):
    more = overrides.unionAll(overrides.where("branch = 'choice'").selectExpr("repo", "branch", "action", "expected_path", "'x.v'"))
    got = {r.branch: r.status for r in select_branches(changed_paths(snapshots), branches, more).collect()}
    assert got["choice"] == "override_mismatch"


def test_changed_paths(snapshots):
    got = {(r.branch, r.path, r.change) for r in changed_paths(snapshots).collect()}
    assert {g[1:] for g in got if g[0] == "moved"} == {("dir/new.v", "added")}
    assert {g[1:] for g in got if g[0] == "edited_move"} == {("old.v", "deleted"), ("new.v", "added")}
    assert {g[1:] for g in got if g[0] == "one"} == {("src/a.sv", "modified"), ("README.md", "modified")}
    assert not [g for g in got if g[0] == "none"]
    assert ("empty", "e.v", "modified") in got


def test_contents_stay_out_of_the_shuffle(snapshots):
    plan = all_changes(snapshots)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
    [final] = [line for line in plan.splitlines() if "HashAggregate" in line][:1]
    assert "content" not in final.split("output=")[0]


def test_select(snapshots, branches, overrides):
    selected = select_branches(changed_paths(snapshots), branches, overrides).collect()
    got = {r.branch: (r.status, r.source_path, r.n_changed) for r in selected}
    assert got == {
        "one": ("processed", "src/a.sv", 1),
        "empty": ("processed", "e.v", 1),
        "none": ("no_changes", None, 0),
        "untouched": ("no_changes", None, 0),
        "readme": ("no_changes", None, 0),
        "many": ("multiple_changes", None, 2),
        "new": ("missing_at_branch_point", None, 1),
        "gone": ("missing_at_tip", None, 1),
        "moved": ("missing_at_branch_point", None, 1),
        "edited_move": ("multiple_changes", None, 2),
        "dup": ("duplicate_branch", None, 1),
        "choice": ("processed", "y.sv", 2),
        "wrong": ("override_mismatch", None, 3),
    }


def test_without_overrides(snapshots, branches):
    got = {r.branch: r.status for r in select_branches(changed_paths(snapshots), branches).collect()}
    assert got["dup"] == "processed" and got["choice"] == got["wrong"] == "multiple_changes"


def test_pair_corpus(snapshots, branches, overrides, spark, tmp_path):
    corpus = build_pair_corpus(snapshots, branches, overrides)
    files = {(r.output_folder, r.file_name): (r.role, r.content) for r in corpus.files.collect()}
    assert files == {
        ("r_one", "buggy.sv"): ("buggy", "old"),
        ("r_one", "base.sv"): ("base", "new"),
        ("r_choice", "buggy.sv"): ("buggy", "1"),
        ("r_choice", "base.sv"): ("base", "2"),
        ("r_empty", "buggy.v"): ("buggy", ""),
        ("r_empty", "base.v"): ("base", "now"),
    }
    meta = {r.branch_name: r.asDict() for r in corpus.metadata.collect()}
    assert meta["choice"] == {
        "output_folder": "r_choice", "git_repo": "https://example.org/r", "branch_name": "choice",
        "source_path": "y.sv", "buggy_commit": "bchoice", "fixed_commit": "tchoice",
    }
    counts = {r.status: (r["count"], r.total) for r in corpus.counts.collect()}
    assert counts["processed"] == (3, 13)
    root = str(tmp_path / "out")
    write_pair_corpus(corpus, root)
    assert spark.read.parquet(f"{root}/pairs.pq").where("output_folder = 'r_one' and role = 'base'").first().content == "new"
    for read, name in ((spark.read.parquet, "pq"), (spark.read.json, "ndjson"), (spark.read.option("header", True).csv, "csv")):
        frame = read(f"{current_version(spark, root)}/all_metadata.{name}")
        assert frame.count() == 3 and set(frame.columns) == set(BRANCH_METADATA.names)


def test_corpus_layout(snapshots, branches, overrides, spark, tmp_path):
    corpus = build_pair_corpus(snapshots, branches, overrides)
    assert all(r.error is None for r in export_files(corpus_files(corpus), str(tmp_path / "out")).collect())
    written = {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()}
    names = {"r_one": ".sv", "r_choice": ".sv", "r_empty": ".v"}
    assert written == {f"{d}/{n}" for d, e in names.items() for n in (f"buggy{e}", f"base{e}", "metadata.json")}
    described = json.loads((tmp_path / "out/r_choice/metadata.json").read_text())
    assert described["source_path"] == "y.sv" and set(described) == set(BRANCH_METADATA.names)
    # The emitted layout is what the scanner and the labels expect.
    scanned = {r.path for r in scan_corpus(spark, str(tmp_path / "out")).collect()}
    assert "r_one/buggy.sv" in scanned and len(scanned) == 6


def test_branch_names(spark):
    refs = ["origin/HEAD", "origin/main", "origin/b", "origin/a/b", "origin/b", "up/HEAD"]
    df = spark.createDataFrame([("r", x) for x in refs], "repo string, ref_name string")
    assert sorted(r.branch for r in branch_names(df).collect()) == ["a/b", "b"]


def test_known_overrides(spark):
    rows = known_overrides(spark).collect()
    assert len({(r.repo, r.branch) for r in rows}) == 3 and sum(r.action == "skip" for r in rows) == 1
    choices = {(r.branch, r.chosen_path) for r in rows if r.action == "choose"}
    assert choices <= {(r.branch, r.expected_path) for r in rows}


def test_union_is_strict(spark):
    good = spark.createDataFrame([tuple("abcdef")], BRANCH_METADATA)
    assert union_metadata(good, good.select(*reversed(good.columns))).count() == 2
    with pytest.raises(Exception, match="(?i)column"):
        union_metadata(good, good.drop("branch_name"))
