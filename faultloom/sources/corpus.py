"""Reading source trees and writing files back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import with_suffix_prefix
from ..sizing import balance
from .scratch import arrow_uri, file_system
from .tables import current_version, new_version, publish

# Fixed value: the files that make up a corpus.
SOURCE_SUFFIXES = (".v", ".sv")


def scan_corpus(
    spark: SparkSession, root: str, suffixes: tuple[str, ...] = SOURCE_SUFFIXES, *, complete: bool = True
) -> DataFrame:
    """One row per source file below ``root``: ``path, content, valid_utf8``.

    ``path`` is relative to the root. Line ends become ``\\n``. Files that are not valid UTF-8 are
    flagged, not dropped. With ``complete`` tasks list the tree and read its files, for which Arrow must be
    able to open the file system; they do so whenever the result is computed. Without it Spark's own listing
    is used, which leaves out empty files and names starting with ``_`` or ``.`` and keeps an entry for every
    file in the driver.
    """
    raw = _tree_by_tasks(spark, root, suffixes) if complete else _tree_by_listing(spark, root, suffixes)
    return raw.select(
        "path",
        F.regexp_replace("value", "\r\n?", "\n").alias("content"),
        F.is_valid_utf8("value").alias("valid_utf8"),
    )


def _tree_by_listing(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """``path, value`` of the files that Spark's own listing finds."""
    root_path = _path_part(_qualified(spark, root)).rstrip("/") + "/"
    file = F.regexp_replace(_decoded(F.col("_metadata.file_path")), _SCHEME, "")
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
        .text(root, wholetext=True)
        .select(F.substring(file, F.lit(len(root_path) + 1), F.length(file)).alias("path"), "value")
    )


#: Files, and bytes of them, that a reading task puts into one batch of rows.
BATCH_FILES, BATCH_BYTES = 1_000, 4_000_000


def _tree_by_tasks(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """``path, value`` of all files below ``root``; no list of them passes the driver.

    One task opens the root, the tasks then open the folders of the first level one by one, and those of the
    second with all that is below. After each step what was found is dealt out anew, so a folder that holds
    most of the files is listed by one task but read by all.
    """
    files, place = file_system(spark, root)
    if not files.exists(place):
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {_qualified(spark, root)}")
    uri = arrow_uri(_qualified(spark, root))
    uri = _path_part(uri) if uri.startswith("file:") else uri
    base = fs.FileSystem.from_uri(uri)[1]
    batch_files, batch_bytes = BATCH_FILES, BATCH_BYTES

    def opened(recursive: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyarrow import fs as arrow_fs

            system, _ = arrow_fs.FileSystem.from_uri(uri)

            def below(folder):
                for info in system.get_file_info(arrow_fs.FileSelector(folder, recursive=recursive)):
                    is_folder = info.type == arrow_fs.FileType.Directory
                    if (is_folder and not recursive) or (info.is_file and info.path.endswith(suffixes)):
                        yield info.path, is_folder

            for batch in batches:
                for place, is_folder in zip(batch["place"], batch["is_folder"]):
                    yield pd.DataFrame(below(place) if is_folder else [(place, False)], columns=["place", "is_folder"])

        return run

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow_fs

        system, _ = arrow_fs.FileSystem.from_uri(uri)
        held, size = [], 0
        for batch in batches:
            for file in batch["place"]:
                with system.open_input_stream(file) as stream:
                    held.append((file[len(base) :].strip("/"), stream.read()))
                size += len(held[-1][1])
                if size >= batch_bytes or len(held) >= batch_files:
                    yield pd.DataFrame(held, columns=["path", "value"])
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["path", "value"])

    kinds = "place string, is_folder boolean"
    found = spark.createDataFrame([(base, True)], kinds)
    for recursive in (False, False, True):
        found = balance(found.mapInPandas(opened(recursive), kinds), "place")
    return found.mapInPandas(read, "path string, value binary").select("path", F.col("value").cast("string").alias("value"))


# Scheme and authority of a file URI.
_SCHEME = r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def _path_part(uri: str) -> str:
    return re.sub(_SCHEME, "", uri)


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as the session's file system sees it, so that relative roots work."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _decoded(uri: Column) -> Column:
    """File URIs are percent-encoded; a plus sign stands for itself."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def rewritten(df: DataFrame, *, path: str = "path", in_place: bool = False) -> DataFrame:
    """Add ``out_path``: the same path, or the sibling ``<stem>.obf<ext>``."""
    target = F.col(path) if in_place else with_suffix_prefix(F.col(path))
    return df.withColumn("out_path", target)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Write emitted file pairs as a table clustered by folder, so that a folder's rows lie together.

    No directory per folder: there would be two tiny files for every branch.
    """
    clustered = pairs.repartitionByRange("output_folder", "role").sortWithinPartitions("output_folder", "role")
    clustered.write.mode("overwrite").parquet(path)


def export_files(df: DataFrame, root: str, *, path: str = "out_path", content: str = "content") -> DataFrame:
    """Write one file per row below ``root`` from the tasks: returns ``path, n_bytes, sha256, error`` lazily.

    Works on any file system Arrow can open, for text and binary contents. A task writes a file under a name
    of its own attempt and gives it the final name when it is complete, so a lost attempt leaves no half file
    there, and a retried one puts the same bytes in its place. Run an action on the result to do the writing;
    :func:`export_tree` also keeps a manifest.
    """
    uri = arrow_uri(root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import uuid

        from pyarrow import fs as arrow_fs

        system, base = arrow_fs.FileSystem.from_uri(uri)

        def put(name, content):
            data = content if isinstance(content, (bytes, bytearray)) else content.encode("utf-8")
            folder, _, last = f"{base}/{name}".rpartition("/")
            system.create_dir(folder, recursive=True)
            draft = f"{folder}/.{uuid.uuid4().hex}.part"
            try:
                with system.open_output_stream(draft) as out:
                    out.write(data)
                system.move(draft, f"{folder}/{last}")
            except BaseException:
                if system.get_file_info(draft).is_file:
                    system.delete_file(draft)
                raise
            return len(data), hashlib.sha256(data).hexdigest()

        for batch in batches:
            done = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    done.append((name, *put(name, content), None))
                except Exception as failure:
                    done.append((name, None, None, f"{type(failure).__name__}: {failure}"))
            out = pd.DataFrame(done, columns=["path", "n_bytes", "sha256", "error"])
            yield out.astype({"n_bytes": "Int64"})

    files = df.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return files.mapInPandas(write, "path string, n_bytes bigint, sha256 string, error string")


#: Folder with the lists of exported files, hidden from readers of the tree by its first letter.
MANIFESTS = "_manifests"


def export_tree(df: DataFrame, root: str, *, path: str = "out_path", content: str = "content") -> DataFrame:
    """Write one file per row below ``root`` and a manifest of them; returns the manifest.

    The manifest is written by the same job as the files and named as current by the driver when that job
    has ended and no file has failed. Files that failed raise an error that names the first of them.
    """
    spark = df.sparkSession
    version = new_version(f"{root.rstrip('/')}/{MANIFESTS}")
    export_files(df, root, path=path, content=content).write.parquet(version)
    manifest = spark.read.parquet(version)
    failed = manifest.where("error is not null").agg(F.count("*").alias("n"), F.min(F.struct("path", "error")).alias("first")).first()
    if failed.n:
        raise OSError(f"{failed.n} files could not be written, the first is {failed.first.path}: {failed.first.error}")
    publish(spark, version)
    return manifest


def exported_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``path, n_bytes, sha256`` of the files of the last complete export to ``root``."""
    return spark.read.parquet(current_version(spark, f"{root.rstrip('/')}/{MANIFESTS}")).drop("error")
