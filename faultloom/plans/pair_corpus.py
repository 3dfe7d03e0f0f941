"""Pair: branch snapshots to a corpus of faulty and fixed file pairs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import status_counts
from ..operators.snapshots import branch_metadata, changed_paths, emit_pairs, select_branches
from ..schemas import BRANCH_METADATA
from ..sources.corpus import write_pairs
from ..sources.tables import write_three_ways


class PairCorpus(NamedTuple):
    selected: DataFrame
    files: DataFrame
    metadata: DataFrame
    counts: DataFrame


def build_pair_corpus(
    snapshots: DataFrame, branches: DataFrame, overrides: DataFrame | None = None
) -> PairCorpus:
    """Branch decisions, files to write, metadata and run counters.

    ``branches`` carries ``repo, branch, git_repo, base_commit, tip_commit``. The decisions are made
    on fingerprints, one short row per branch, and nothing runs before a result is asked for. The contents
    are read a second time against the decisions, which AQE broadcasts once their true size allows it.
    """
    selected = select_branches(changed_paths(snapshots), branches, overrides)
    return PairCorpus(
        selected,
        emit_pairs(snapshots, selected),
        branch_metadata(selected, branches),
        status_counts(selected),
    )


def corpus_files(corpus: PairCorpus) -> DataFrame:
    """``out_path, content`` of the pair layout: both versions and ``metadata.json`` per folder."""
    versions = corpus.files.select(F.concat_ws("/", "output_folder", "file_name").alias("out_path"), "content")
    described = corpus.metadata.select(
        F.concat(F.col("output_folder"), F.lit("/metadata.json")).alias("out_path"),
        F.to_json(F.struct(*BRANCH_METADATA.names)).alias("content"),
    )
    return versions.unionByName(described)


def write_pair_corpus(corpus: PairCorpus, root: str) -> None:
    """Write the pairs as a partitioned table and the metadata in three formats."""
    write_pairs(corpus.files, f"{root}/pairs.pq")
    write_three_ways(corpus.metadata, root)
