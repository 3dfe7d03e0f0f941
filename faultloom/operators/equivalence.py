"""Checks that two tables, or two texts up to renaming, are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import bind
from ..functions.masking import BASED_LITERAL
from ..functions.text import IDENTIFIER, WHITESPACE_CHARS
from ..functions.words import is_reserved

# Verdicts.
SAME, DIFFERENT, INPUT_MISSING = 0, 1, 2

# Tokens of a source text; whitespace falls between them. A based literal is one token, so that a
# changed digit in 2'd1 counts as a change.
# Most tokens are names, so these are tried first; a based literal starts with a digit or a quote. The common
# white space is ruled out before the matcher asks the long class range by range, which took most of its time.
_STRING = r'"(?:[^"\\]++|\\[\s\S])*+"'
_COMMENT = r"//[^\n]*+|/\*[\s\S]*?\*/"
_TOKEN = (
    rf"{_STRING}|[A-Za-z_$][A-Za-z0-9_$]*+|(?=[0-9']){BASED_LITERAL}|[0-9][A-Za-z0-9_$]*+"
    rf"|[!-~]|(?![\t\n\r ])[[^!-~]&&[^{WHITESPACE_CHARS}]]"
)
_NAME = rf"\A{IDENTIFIER}\z"


def canonical(value: Column, kind: T.DataType) -> Column:
    """A value as text or nested text, such that equal values and only those agree; NULL stays NULL."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [canonical(value[f.name], f.dataType).alias(f.name) for f in fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(
            F.to_json(F.struct(canonical(e["key"], kind.keyType).alias("k"))).alias("key"),
            F.to_json(F.struct(canonical(e["value"], kind.valueType).alias("v"))).alias("value"),
        )
        return F.array_sort(F.transform(F.map_entries(value), entry))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def row_fingerprint(df: DataFrame) -> Column:
    """SHA-256 over all columns; NULLs and empty strings differ, maps are equal in any order of entries."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.sha2(F.to_json(F.struct(*[canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])), 256)


def _kinds(df: DataFrame) -> list:
    return sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)


def dataset_equivalence(gold: DataFrame | None, gate: DataFrame | None) -> DataFrame:
    """Compare two tables as multisets: one row ``verdict, only_gold, only_gate``.

    Only fingerprints with signed counts are shuffled, pre-aggregated on both sides, so wide rows
    and heavily repeated rows cost no more than others.
    """
    present = gold if gold is not None else gate
    if present is None:
        raise ValueError("at least one table is needed to have a session to answer in")
    if gold is None or gate is None:
        return present.sparkSession.range(1).select(
            F.lit(INPUT_MISSING).alias("verdict"),
            F.lit(None).cast("bigint").alias("only_gold"),
            F.lit(None).cast("bigint").alias("only_gate"),
        )
    if _kinds(gold) != _kinds(gate):
        raise ValueError("the two tables have different columns or types")
    signed = gold.select(row_fingerprint(gold).alias("id"), F.lit(1).alias("d")).unionAll(
        gate.select(row_fingerprint(gate).alias("id"), F.lit(-1).alias("d"))
    )
    surplus = signed.groupBy("id").agg(F.sum("d").alias("d"))
    totals = surplus.agg(
        F.coalesce(F.sum(F.greatest(F.col("d"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_gold"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_gate"),
    )
    same = (F.col("only_gold") == 0) & (F.col("only_gate") == 0)
    return totals.select(F.when(same, SAME).otherwise(DIFFERENT).alias("verdict"), "only_gold", "only_gate")


def code_tokens(text: Column) -> Column:
    """Tokens of a source text without whitespace and comments; a string literal is one token."""
    code = F.regexp_replace(text, rf"({_STRING})|{_COMMENT}", "$1 ")
    return F.regexp_extract_all(code, F.lit(_TOKEN), 0)


def equal_up_to_renaming(gold: Column, gate: Column) -> Column:
    """True if the token streams agree except for a one-to-one renaming of identifiers.

    Reserved words, literals and signs must be equal; comments count as whitespace. Decided on the pair's own
    row: the aligned tokens are made distinct first, and only distinct pairs are looked at. They are made
    distinct as texts, which are hashed; of structs each would be held against all others. It is not a proof
    of equal behaviour: two texts that compute the same in different ways come out different.
    """

    def same(left: Column, right: Column) -> Column:
        aligned = F.array_distinct(F.zip_with(left, right, as_text))
        return F.when(F.size(left) == F.size(right), bind(F.transform(aligned, as_pair), consistent)).otherwise(False)

    def as_text(a: Column, b: Column) -> Column:
        """The length of the first token tells where the second begins, whatever the tokens hold."""
        return F.concat(F.length(a).cast("string"), F.lit(" "), a, b)

    def as_pair(text: Column) -> Column:
        digits = F.substring_index(text, " ", 1)
        begin = F.length(digits) + 2
        size = digits.cast("int")
        return F.struct(
            F.substring(text, begin, size).alias("a"),
            F.substring(text, begin + size, F.length(text)).alias("b"),
        )

    def is_name(token: Column) -> Column:
        return token.rlike(_NAME) & ~is_reserved(token)

    def consistent(pairs: Column) -> Column:
        """Unequal pairs must be two names; of all names each may stand beside one other only."""
        fits = F.forall(pairs, lambda p: (p["a"] == p["b"]) | (is_name(p["a"]) & is_name(p["b"])))
        return fits & bind(F.filter(pairs, lambda p: is_name(p["a"])), one_to_one)

    def one_to_one(names: Column) -> Column:
        olds, news = F.array_distinct(F.transform(names, lambda p: p["a"])), F.array_distinct(F.transform(names, lambda p: p["b"]))
        return (F.size(names) == F.size(olds)) & (F.size(names) == F.size(news))

    return F.when(gold == gate, True).otherwise(
        bind(
            F.struct(code_tokens(gold).alias("l"), code_tokens(gate).alias("r")),
            lambda both: same(both["l"], both["r"]),
        )
    )


def rename_verdicts(
    pairs: DataFrame, *, key: str = "pair_id", gold: str = "gold", gate: str = "gate"
) -> DataFrame:
    """``key, verdict`` with 0 same up to renaming, 1 different, 2 a text is missing."""
    left, right = F.col(gold), F.col(gate)
    verdict = (
        F.when(left.isNull() | right.isNull(), INPUT_MISSING)
        .when(equal_up_to_renaming(left, right), SAME)
        .otherwise(DIFFERENT)
    )
    return pairs.select(key, verdict.alias("verdict"))
