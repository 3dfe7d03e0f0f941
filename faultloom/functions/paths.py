"""Path and branch-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes read as SystemVerilog, and the ordered branch-name replacements.
SYSTEM_VERILOG_SUFFIXES = (".sv", ".svh", ".svi")
FOLDER_NAME_REPLACEMENTS = (("#", "_"), ("fix_", ""), ("()", ""), ("fix-", ""))


def suffix(path: Column) -> Column:
    """Extension of the last path component with its dot, or an empty string."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1)


def with_suffix_prefix(path: Column, prefix: str = ".obf") -> Column:
    """Insert ``prefix`` before the extension: ``a/b.sv`` becomes ``a/b.obf.sv``."""
    ext = suffix(path)
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(ext)), F.lit(prefix), ext)


def is_system_verilog(path: Column) -> Column:
    """True for the SystemVerilog suffixes, ignoring case."""
    return F.lower(suffix(path)).isin(*SYSTEM_VERILOG_SUFFIXES)


def output_folder(repo: Column, branch: Column) -> Column:
    """Folder name of a branch's file pair."""
    cleaned = branch
    for old, new in FOLDER_NAME_REPLACEMENTS:
        cleaned = F.replace(cleaned, F.lit(old), F.lit(new))
    return F.concat(repo, F.lit("_"), cleaned)


def challenge_of(path: Column) -> Column:
    """First path segment."""
    return F.split_part(path, F.lit("/"), F.lit(1))
