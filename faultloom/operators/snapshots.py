"""Building file pairs from branch snapshots.

A snapshot table has one row per file: ``repo, branch, side, path, content`` with side ``base`` (the
branch point, holding the faulty version) or ``tip`` (the branch head, holding the fix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import output_folder, suffix
from ..schemas import BRANCH_METADATA, OVERRIDES

BASE, TIP = "base", "tip"

# Branches and files left out, roles of the two sides, and the known exceptions.
MAIN_BRANCH = "main"
HEAD_SUFFIX = "/HEAD"
IGNORED_PATHS = ("README.md",)
ROLE_OF_SIDE = {BASE: "buggy", TIP: "base"}
SKIP, CHOOSE = "skip", "choose"
KNOWN_OVERRIDES = (
    ("hackatdac19", "fix_cwe_1244_in_csr_regfile", SKIP, None, None),
    (
        "hackatdac21",
        "fix_cwe_1317_in_clint",
        CHOOSE,
        (
            "piton/design/chip/tile/ariane/openpiton/riscv_peripherals.sv",
            "piton/design/chip/tile/ariane/src/clint/clint.sv",
        ),
        "piton/design/chip/tile/ariane/src/clint/clint.sv",
    ),
    (
        "hackatdac21",
        "fix_cwe_1245",
        CHOOSE,
        (
            "piton/design/chip/tile/ariane/src/sha256/sha256.v",
            "piton/design/chip/tile/ariane/src/dma/dma.sv",
        ),
        "piton/design/chip/tile/ariane/src/sha256/sha256.v",
    ),
)

# Outcome of a branch.
PROCESSED = "processed"
DUPLICATE = "duplicate_branch"
NO_CHANGES = "no_changes"
MULTIPLE = "multiple_changes"
MISMATCH = "override_mismatch"
MISSING_AT_BASE = "missing_at_branch_point"
MISSING_AT_TIP = "missing_at_tip"


def known_overrides(spark: SparkSession) -> DataFrame:
    """The fixed exceptions as an override table, one row per expected path."""
    rows = [(r, b, a, e, c) for r, b, a, paths, c in KNOWN_OVERRIDES for e in paths or (None,)]
    return spark.createDataFrame(rows, OVERRIDES)


def branch_names(refs: DataFrame, *, repo: str = "repo", ref: str = "ref_name") -> DataFrame:
    """Distinct branches of remote refs such as ``origin/x``, without HEAD pointers and ``main``."""
    name = F.col(ref)
    return (
        refs.where(~name.endswith(HEAD_SUFFIX))
        .select(repo, F.substring(name, F.instr(name, "/") + 1, F.length(name)).alias("branch"))
        .where(F.col("branch") != MAIN_BRANCH)
        .distinct()
    )


def content_id(content: Column) -> list[Column]:
    """Fingerprint that stands for a content in comparisons, so texts stay out of the shuffle.

    120 bits of SHA-256 as two numbers: numbers can be aggregated in hash tables, strings would be
    sorted.
    """
    digest = F.sha2(content, 256)
    return [
        F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint").alias(name)
        for name, start in (("_id1", 1), ("_id2", 16))
    ]


def all_changes(snapshots: DataFrame) -> DataFrame:
    """Every added, modified or deleted path: ``repo, branch, path, change, id1, id2``.

    Both sides are compared in one grouping by path; the key is a single file, so no key is heavy,
    and only fingerprints are shuffled. The ids are those of the content added or deleted.
    """
    at_base, at_tip = F.col("side") == BASE, F.col("side") == TIP
    sides = [("base", at_base), ("tip", at_tip)]
    versions = (
        snapshots.select("repo", "branch", "path", "side", *content_id(F.col("content")))
        .groupBy("repo", "branch", "path")
        .agg(*[F.max(F.when(on, F.col(f"_{i}"))).alias(f"{side}_{i}") for side, on in sides for i in ("id1", "id2")])
    )
    same = F.col("base_id1").eqNullSafe(F.col("tip_id1")) & F.col("base_id2").eqNullSafe(F.col("tip_id2"))
    change = (
        F.when(F.col("base_id1").isNull(), "added").when(F.col("tip_id1").isNull(), "deleted").otherwise("modified")
    )
    return versions.where(~same).select(
        "repo",
        "branch",
        "path",
        change.alias("change"),
        F.coalesce("tip_id1", "base_id1").alias("id1"),
        F.coalesce("tip_id2", "base_id2").alias("id2"),
    )


def changed_paths(snapshots: DataFrame) -> DataFrame:
    """Changed paths ``repo, branch, path, change``.

    A file moved without an edit shows under its new path only: the deleted path is dropped when the
    same branch adds the same content elsewhere. Moves with edits show both paths. One lazy plan: the
    contents that a branch adds are an aggregate of the same short rows, joined back to them.
    """
    changes = all_changes(snapshots)
    content = ["repo", "branch", "id1", "id2"]
    added = changes.where(F.col("change") == "added").select(*content).distinct()
    added = added.withColumn("_added", F.lit(True))
    kept = changes.join(added, content, "left").where((F.col("change") != "deleted") | F.col("_added").isNull())
    return kept.select("repo", "branch", "path", "change")


def select_branches(changes: DataFrame, branches: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Decide per branch which file to use: ``repo, branch, n_changed, source_path, status``.

    ``branches`` lists all ``repo, branch``; those without changes are reported too. A branch counts
    if it changes one file, or has an override whose expected set is exactly what it changes, and if
    the file exists on both sides. ``overrides`` has one row per expected path; without any the known
    exceptions hold. A branch whose rows name two actions or two chosen paths is an ``override_mismatch``.
    Paths are never gathered: a single changed path is its group's minimum, and an expected set is
    compared by counting matches.
    """
    if overrides is None:
        overrides = known_overrides(branches.sparkSession)
    key = ["repo", "branch"]
    listed = overrides.select(*key, "action", "expected_path", "chosen_path").distinct()
    rules = listed.groupBy(*key).agg(
        F.min("action").alias("action"),
        F.min("chosen_path").alias("chosen_path"),
        F.count(F.when(F.col("action") == CHOOSE, F.col("expected_path"))).alias("n_wanted"),
        ((F.min("action") != F.max("action")) | (F.min("chosen_path") != F.max("chosen_path"))).alias("contradictory"),
    )
    expected = listed.where((F.col("action") == CHOOSE) & F.col("expected_path").isNotNull())
    expected = expected.groupBy(*key, F.col("expected_path").alias("path")).agg(F.min("chosen_path").alias("chosen_path"))
    per_branch = (
        changes.where(~F.col("path").isin(*IGNORED_PATHS))
        .select(*key, "path", "change")
        .join(expected, [*key, "path"], "left")
        .groupBy(*key)
        .agg(
            F.count("*").alias("n_changed"),
            F.count("chosen_path").alias("n_expected"),
            F.min("path").alias("only_path"),
            F.min("change").alias("only_change"),
            F.min(F.when(F.col("path") == F.col("chosen_path"), F.col("change"))).alias("chosen_change"),
        )
    )
    n = F.coalesce("n_changed", F.lit(0).cast("bigint"))
    wanted = F.coalesce("n_wanted", F.lit(0))
    is_choice = (n > 1) & F.coalesce(F.col("action") == CHOOSE, F.lit(False))
    agrees = F.coalesce((F.col("n_expected") == wanted) & (n == wanted), F.lit(False))
    change = F.when(is_choice, F.col("chosen_change")).otherwise(F.col("only_change"))
    status = (
        F.when(F.coalesce("contradictory", F.lit(False)), MISMATCH)
        .when(F.col("action") == SKIP, DUPLICATE)
        .when(n == 0, NO_CHANGES)
        .when(is_choice & ~agrees, MISMATCH)
        .when((n > 1) & ~is_choice, MULTIPLE)
        .when(change == "added", MISSING_AT_BASE)
        .when(change == "deleted", MISSING_AT_TIP)
        .otherwise(PROCESSED)
    )
    path = F.when(is_choice, F.col("chosen_path")).otherwise(F.col("only_path"))
    return (
        branches.select(*key)
        .distinct()
        .join(rules, key, "left")
        .join(per_branch, key, "left")
        .select(
            *key,
            n.alias("n_changed"),
            F.when(status == PROCESSED, path).alias("source_path"),
            status.alias("status"),
        )
    )


def emit_pairs(snapshots: DataFrame, selected: DataFrame) -> DataFrame:
    """Both versions of each processed branch's file, one row per file to write.

    Columns: ``repo, branch, output_folder, role, file_name, source_path, content``.
    """
    chosen = selected.where(F.col("status") == PROCESSED).select(
        "repo", "branch", F.col("source_path").alias("path")
    )
    role = F.when(F.col("side") == BASE, ROLE_OF_SIDE[BASE]).otherwise(ROLE_OF_SIDE[TIP])
    return snapshots.join(chosen, ["repo", "branch", "path"], "inner").select(
        "repo",
        "branch",
        output_folder(F.col("repo"), F.col("branch")).alias("output_folder"),
        role.alias("role"),
        F.concat(role, suffix(F.col("path"))).alias("file_name"),
        F.col("path").alias("source_path"),
        "content",
    )


def branch_metadata(selected: DataFrame, branches: DataFrame) -> DataFrame:
    """One metadata row per processed branch.

    ``branches`` carries ``repo, branch, git_repo, base_commit, tip_commit``.
    """
    done = selected.where(F.col("status") == PROCESSED)
    return done.join(branches, ["repo", "branch"], "inner").select(
        output_folder(F.col("repo"), F.col("branch")).alias("output_folder"),
        "git_repo",
        F.col("branch").alias("branch_name"),
        "source_path",
        F.col("base_commit").alias("buggy_commit"),
        F.col("tip_commit").alias("fixed_commit"),
    )


def union_metadata(*tables: DataFrame) -> DataFrame:
    """Stack metadata tables; a missing or extra column is an error."""
    combined = tables[0]
    for table in tables[1:]:
        combined = combined.unionByName(table, allowMissingColumns=False)
    if set(combined.columns) != set(BRANCH_METADATA.names):
        raise ValueError(f"metadata columns expected: {', '.join(BRANCH_METADATA.names)}")
    return combined
