"""Checking rename mappings and applying them to a corpus."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bind, members, unnest
from ..functions.text import IDENTIFIER_CHARS, identifier_tokens, is_identifier
from ..functions.words import MASK_PREFIX, is_candidate
from ..sizing import KERNEL_ROWS

# Why a proposed pair is not applied, in the order of the tests.
MASK_TOKEN = "mask_token"
UNSUPPORTED_KEY = "unsupported_key"
ABSENT = "absent"
INVALID_NEW_NAME = "invalid_new_name"
COLLISION = "collision"
NOT_CANDIDATE = "not_candidate"
ACCEPTED = "accepted"

_WHOLE_TOKEN = rf"\A[{IDENTIFIER_CHARS}]+\z"
_TOKEN_OR_GAP = rf"[{IDENTIFIER_CHARS}]+|[^{IDENTIFIER_CHARS}]+"


def _first_reason(old: Column, new: Column, present: Column) -> Column:
    """Reason a pair fails on its own, NULL if it does not."""
    return (
        F.when(old.startswith(MASK_PREFIX), MASK_TOKEN)
        .when(~old.rlike(_WHOLE_TOKEN), UNSUPPORTED_KEY)
        .when(~present, ABSENT)
        .when(~is_identifier(new), INVALID_NEW_NAME)
    )


def text_tokens(text: Column) -> Column:
    """Identifier tokens and the stretches between them; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(_TOKEN_OR_GAP), 0)


def judge_entries(entries: Column, tokens: Column) -> Column:
    """Judge the pairs of one document: ``array<struct<ord,old_name,new_name,is_text,reason>>``.

    ``entries`` is the output of ``json_entries``, ``tokens`` that of :func:`text_tokens`. Pairs that pass on their own compete for
    their new name, the earliest wins; only then are reserved words and the like taken out, so such
    a pair may still have displaced a later one. ``reason`` is NULL for accepted pairs.
    """

    def described(e: Column, absent: Column) -> Column:
        return F.struct(
            e["ord"].alias("ord"),
            e["key"].alias("old_name"),
            e["value"].alias("new_name"),
            e["is_text"].alias("is_text"),
            _first_reason(e["key"], e["value"], ~absent).alias("reason"),
        )

    def judged(es: Column, absent: Column) -> Column:
        rows = F.transform(members(es, lambda e: e["key"], absent), lambda m: described(m["row"], m["hit"]))
        return bind(rows, contended)

    def contended(rows: Column) -> Column:
        claims = F.transform(
            F.filter(rows, lambda r: r["reason"].isNull()),
            lambda r: F.struct(r["new_name"].alias("name"), r["ord"].alias("ord")),
        )
        return bind(F.array_sort(claims), lambda own: decided(rows, own))

    def decided(rows: Column, claims: Column) -> Column:
        """Claims are sorted by name and place, so all but the first of a name have lost it."""
        lost = F.filter(claims, lambda c, i: (i > 0) & (F.get(claims, i - 1)["name"] == c["name"]))
        lost = F.transform(lost, lambda c: c["ord"])
        settled_rows = F.transform(members(rows, lambda r: r["ord"], lost), lambda m: settled(m["row"], m["hit"]))
        return F.array_sort(settled_rows)

    def settled(r: Column, lost: Column) -> Column:
        reason = F.coalesce(
            r["reason"], F.when(lost, COLLISION), F.when(~is_candidate(r["old_name"]), NOT_CANDIDATE)
        )
        return F.struct(
            r["ord"].alias("ord"),
            r["old_name"].alias("old_name"),
            r["new_name"].alias("new_name"),
            r["is_text"].alias("is_text"),
            reason.alias("reason"),
        )

    def with_absent(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["key"])
        return bind(F.coalesce(F.array_except(keys, tokens), keys), lambda absent: judged(es, absent))

    return bind(entries, with_absent)


def has_untyped_value(verdicts: Column) -> Column:
    """True if a pair that reached the new-name test has a value that is not a string."""
    return F.exists(
        verdicts,
        lambda v: ~v["is_text"]
        & ~F.coalesce(v["reason"], F.lit("")).isin(MASK_TOKEN, UNSUPPORTED_KEY, ABSENT),
    )


def accepted_map(verdicts: Column) -> Column:
    """The accepted pairs as ``map<string,string>``."""
    return F.map_from_entries(
        F.transform(
            F.filter(verdicts, lambda v: v["reason"].isNull()),
            lambda v: F.struct(v["old_name"], v["new_name"]),
        )
    )


def make_renamer():
    """``kernel(texts, olds, news)`` over Arrow arrays: the texts renamed by each row's pairs of names.

    A function made here travels to the workers by value, so the package need not be installed there.
    """

    def kernel(texts: pa.Array, olds: pa.Array, news: pa.Array) -> pa.Array:
        import re

        token = re.compile(f"([{IDENTIFIER_CHARS}]+)")

        def one(value, old, new):
            if value is None or not old:
                return value
            names = {a: b or "" for a, b in zip(old, new)}  # a null takes the name out
            parts = token.split(value)
            parts[1::2] = [names.get(part, part) for part in parts[1::2]]
            return "".join(parts)

        # Python objects are made of some rows at a time; the rest of a batch stays in Arrow's buffers.
        done = []
        for at in range(0, len(texts), KERNEL_ROWS):
            rows = zip(*(c.slice(at, KERNEL_ROWS).to_pylist() for c in (texts, olds, news)))
            done.append(pa.array([one(*row) for row in rows], texts.type))
        return pa.concat_arrays(done) if done else texts

    return kernel


def rename_tokens(text: Column, mapping: Column) -> Column:
    """Rename whole tokens, all at once: ``{a: b, b: a}`` swaps. An empty or null mapping changes nothing.

    Columns have no keyed lookup (an element of a map is found by going through its keys), so the one step
    that looks up every token is a small Arrow kernel over text and pairs; its cost is linear in both.
    """

    kernel = F.arrow_udf(make_renamer(), "string")
    return kernel.asNondeterministic()(text, F.map_keys(mapping), F.map_values(mapping))


def document_words(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, word)``: the distinct identifier tokens of each document, one row each."""
    words = unnest(documents.select(key, text), F.array_distinct(identifier_tokens(F.col(text))), key, item="word")
    return words.select(key, "word").distinct()


def _beside(pairs: DataFrame, words: DataFrame, key: str, how: str) -> DataFrame:
    """Pairs joined with the words of their document by key and name, so that rows of one document spread."""
    words = words.select(F.col(key).alias("_document"), F.col("word").alias("_word"), F.lit(True).alias("_present"))
    return pairs.join(words, (pairs[key] == words["_document"]) & (pairs["old_name"] == words["_word"]), how)


def judge_mapping_table(
    mappings: DataFrame, documents: DataFrame, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Judge a long mapping table ``(key, ord, old_name, new_name)`` against its documents.

    Same rules as :func:`judge_entries`, for mappings that do not sit on their document's row and may have
    any number of pairs: a name meets its document's word as one row does another. ``ord`` numbers a
    document's pairs from 0.
    """
    rows = _beside(mappings, document_words(documents, key=key, text=text), key, "left")
    old, new = F.col("old_name"), F.col("new_name")
    reason = _first_reason(old, new, F.coalesce("_present", F.lit(False)))
    rows = rows.select(key, "ord", "old_name", "new_name", reason.alias("reason"))
    # One group holds a document's claims on one name, in order; its first row alone is looked at.
    claims = Window.partitionBy(key, "new_name", F.col("reason").isNull()).orderBy("ord")
    return rows.select(
        key,
        "ord",
        "old_name",
        "new_name",
        F.coalesce(
            "reason",
            F.when(F.row_number().over(claims) > 1, COLLISION),
            F.when(~is_candidate(F.col("old_name")), NOT_CANDIDATE),
        ).alias("reason"),
    )


def _rename_by_present(documents: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """Rename by pairs whose names all occur in their document, each once."""
    mapping = pairs.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("old_name", "new_name"))).alias("_mapping")
    )
    return (
        documents.join(mapping, key, "left")
        .withColumn(text, rename_tokens(F.col(text), F.col("_mapping")))
        .drop("_mapping")
    )


def rename_by_table(
    documents: DataFrame, accepted: DataFrame, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rename documents by a long table of accepted pairs ``(key, ord, old_name, new_name)``.

    Of an old name listed twice for a document the last new name counts. A mapping may be longer than any
    row: names are looked up as rows, and only the pairs whose names occur in a document's text come
    to its row, which are never more than the text has words. Texts are shuffled once.
    """
    last = accepted.groupBy(key, "old_name").agg(F.max_by("new_name", "ord").alias("new_name"))
    present = _beside(last, document_words(documents, key=key, text=text), key, "left_semi")
    return _rename_by_present(documents, present, key, text)


def rename_by_proposals(
    documents: DataFrame, mappings: DataFrame, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Judge a long table of proposed pairs and rename by those accepted, however many there are.

    As in a JSON object, a repeated old name keeps its first place and its last new name.
    """
    entries = mappings.groupBy(key, "old_name").agg(
        F.min("ord").alias("ord"), F.max_by("new_name", "ord").alias("new_name")
    )
    judged = judge_mapping_table(entries, documents, key=key, text=text)
    return _rename_by_present(documents, judged.where("reason is null"), key, text)


def reason_counts(judged: DataFrame) -> DataFrame:
    """Pairs per outcome over the whole table."""
    return judged.groupBy(F.coalesce("reason", F.lit(ACCEPTED)).alias("reason")).agg(
        F.count("*").alias("count")
    )


def exclude_words(names: DataFrame, words: DataFrame, *, on: str = "name") -> DataFrame:
    """Drop names listed in a caller's own word table (the built-in list is a plain predicate)."""
    return names.join(words.select(on).distinct(), on, "left_anti")

