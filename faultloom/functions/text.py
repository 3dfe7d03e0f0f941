"""Whitespace, lines, fenced blocks, JSON-in-text and identifiers, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind

# The whitespace and line-break sets of Python's str.split() and str.splitlines().
# Java's \s and \R cover different sets.
WHITESPACE_CHARS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_BREAK_CHARS = r"\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}"

# The matcher asks a long class range by range. Printable characters, nearly all of a text, are ruled
# out first by one or two ranges; this halves the time of a pass and changes no match.
WHITESPACE = rf"[[^!-~\xa1-\x{{167f}}]&&[{WHITESPACE_CHARS}]]"
_BREAK = rf"[[^ -~\xa0-\x{{2027}}]&&[{LINE_BREAK_CHARS}]]"
_NO_BREAK = rf"[[ -~\xa0-\x{{2027}}][^{LINE_BREAK_CHARS}]]"
LINE_BREAK = rf"{_BREAK}(?:(?<=\r)\n)?+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_$]*"
IDENTIFIER_CHARS = r"A-Za-z0-9_$"

FENCE = "```"

_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def collapse_whitespace(text: Column) -> Column:
    """Turn every whitespace run into one space and trim the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace (Unicode-aware)."""
    return F.regexp_replace(text, rf"\A{WHITESPACE}++|(?<!{WHITESPACE}){WHITESPACE}++\z", "")


def split_lines(text: Column) -> Column:
    """Lines without their terminators; a trailing terminator adds no empty line."""
    return bind(
        F.split(text, LINE_BREAK, -1),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
        ).otherwise(parts),
    )


def split_lines_keeping_ends(text: Column) -> Column:
    """Lines with their terminators attached."""
    pattern = rf"{_NO_BREAK}*+{LINE_BREAK}|{_NO_BREAK}++"
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def normalized_lines(text: Column) -> Column:
    """Lines with whitespace collapsed; blank lines stay as empty strings."""
    return F.transform(split_lines(text), collapse_whitespace)


def code_blocks(markdown: Column) -> Column:
    """Contents of the fenced blocks of a text, in order.

    A line opening with a fence toggles the state, whatever follows the fence on that line. A block
    left open at the end is dropped, an empty block is kept as an empty string.
    """
    fence_line = rf"\A{WHITESPACE}*+{FENCE}"

    def blocks(lines: Column) -> Column:
        fences = F.filter(
            F.transform(lines, lambda line, i: F.when(line.rlike(fence_line), i)),
            lambda i: i.isNotNull(),
        )
        return bind(fences, lambda at: between(lines, at))

    def between(lines: Column, at: Column) -> Column:
        pairs = F.floor(F.size(at) / 2).cast("int")
        nth = F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0)))

        def block(k: Column) -> Column:
            opened, closed = F.get(at, k * 2), F.get(at, k * 2 + 1)
            return F.array_join(F.slice(lines, opened + 2, closed - opened - 1), "\n")

        return F.when(pairs < 1, F.array().cast("array<string>")).otherwise(
            F.transform(nth, block)
        )

    # Texts without any fence skip the line split altogether; a NULL has no blocks either.
    return F.when(markdown.contains(FENCE), bind(split_lines(markdown), blocks)).otherwise(
        F.array().cast("array<string>")
    )


def is_json_object(candidate: Column) -> Column:
    """True for strict JSON whose top level is an object."""
    return F.from_json(candidate, "map<string,string>", _STRICT_JSON).isNotNull()


def first_json_object(text: Column) -> Column:
    """The first JSON object embedded in free text, else NULL.

    The object starts at the first ``{``. Only the brace that closes it outside strings can make it parse, so
    one pass over strings, braces and the stretches between them finds the end, and one parse decides.
    """
    tokens = r'"(?:[^"\\]++|\\[\s\S])*+"|[{}]|[^"{}]++|"'

    def step(state: Column, token: Column) -> Column:
        open_ = state["end"] < 0
        depth = state["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        at = state["at"] + F.length(token)
        return F.when(
            open_,
            F.struct(
                depth.cast("int").alias("depth"),
                at.cast("int").alias("at"),
                F.when(depth == 0, at).otherwise(-1).cast("int").alias("end"),
            ),
        ).otherwise(state)

    def search(tail: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))
        end = F.aggregate(F.regexp_extract_all(tail, F.lit(tokens), 0), start, step)["end"]
        return bind(
            F.when(end > 0, F.substring(tail, F.lit(1), end)), lambda found: F.when(is_json_object(found), found)
        )

    start = F.instr(text, "{")
    return F.when(start > 0, bind(F.substring(text, start, F.length(text)), search))


def json_entries(obj: Column) -> Column:
    """Entries of a JSON object as ``array<struct<ord,key,value,is_text>>``.

    A repeated key keeps its first position and its last value. ``is_text`` tells string values from
    numbers, booleans, nulls and nested values.
    """
    typed = F.from_json(obj, "map<string,variant>", _STRICT_JSON)

    def described(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        flat = F.transform(
            entries,
            lambda e: F.struct(
                e["key"].alias("key"),
                e["value"].cast("string").alias("value"),
                (F.schema_of_variant(e["value"]) == "STRING").alias("is_text"),
            ),
        )
        return bind(flat, lambda rows: bind(F.array_distinct(keys), lambda ks: last_of(rows, keys, ks)))

    def last_of(rows: Column, keys: Column, distinct_keys: Column) -> Column:
        def of_runs(own: Column) -> Column:
            """First place and last value of every key, from rows in the order of key and place."""
            edge = lambda i, step: ~F.coalesce(F.get(own, i + step)["key"].eqNullSafe(F.get(own, i)["key"]), F.lit(False))
            starts = F.filter(own, lambda x, i: (i == 0) | edge(i, -1))
            ends = F.filter(own, lambda x, i: edge(i, 1))
            joined = F.zip_with(
                starts,
                ends,
                lambda x, y: F.struct(x["at"].alias("at"), x["key"].alias("key"), y["value"].alias("value"), y["is_text"].alias("is_text")),
            )
            return F.transform(
                F.array_sort(joined),
                lambda x, i: F.struct(
                    i.cast("int").alias("ord"), x["key"].alias("key"), x["value"].alias("value"), x["is_text"].alias("is_text")
                ),
            )

        placed = F.transform(
            rows,
            lambda r, i: F.struct(r["key"].alias("key"), i.alias("at"), r["value"].alias("value"), r["is_text"].alias("is_text")),
        )

        unchanged = F.transform(
            rows,
            lambda r, i: F.struct(
                i.cast("int").alias("ord"),
                r["key"].alias("key"),
                r["value"].alias("value"),
                r["is_text"].alias("is_text"),
            ),
        )
        return F.when(F.size(rows) == F.size(distinct_keys), unchanged).otherwise(
            bind(F.array_sort(placed), of_runs)
        )

    return bind(F.map_entries(typed), described)


def is_identifier(name: Column) -> Column:
    """True when the whole string is one identifier."""
    return name.rlike(rf"\A{IDENTIFIER}\z")


def identifier_tokens(text: Column) -> Column:
    """Maximal runs of identifier characters, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(f"[{IDENTIFIER_CHARS}]+"), 0)
