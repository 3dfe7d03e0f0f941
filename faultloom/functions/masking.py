"""Replacing comments and string literals by numbered placeholders, and putting them back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind


@dataclass(frozen=True)
class MaskStyle:
    """What is masked and how the placeholders look.

    ``pattern`` finds the hits, ``kinds`` maps a hit's opening characters to the placeholder kind,
    ``template`` has ``{kind}`` and ``{n}`` slots.
    """

    pattern: str
    template: str
    kinds: tuple[tuple[str, str], ...] = ()

    @property
    def hit_pattern(self) -> str:
        """The pattern behind a look at the opening character, which rules out nearly all places."""
        return rf"(?=[/\"'])(?:{self.pattern})"

    @property
    def placeholder_pattern(self) -> str:
        kinds = "|".join(kind for _, kind in self.kinds)
        return self.template.replace("{kind}", f"(?:{kinds})").replace("{n}", "([0-9]+)")


# What counts as a comment or a string, and the placeholder formats. Possessive loops
# keep Java's matcher from recursing on long literals and match the same texts. KINDED takes the
# newline after a line comment and lets no backslash-newline into a string; PLAIN does the reverse.
# A based literal such as 2'b00 opens a single-quoted "string" in both.
KINDED = MaskStyle(
    pattern=(
        r"/\*[\s\S]*?\*/"
        r"|//[^\n]*+\n?"
        r'|"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"'
        r"|'[^'\\]*+(?:\\[^\n][^'\\]*+)*+'"
    ),
    template="__OBFUSCATE_MASK_{kind}_{n}__",
    kinds=(("/*", "CMT_BLOCK"), ("//", "CMT_LINE"), ('"', "STR_DQ"), ("'", "STR_SQ")),
)
PLAIN = MaskStyle(
    pattern=(
        r"//[^\n]*+"
        r"|/\*[\s\S]*?\*/"
        r'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
        r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"
    ),
    template="__MSK_{n}__",
)

# Based literals such as 2'b00 or 'hFF, to be stepped over instead of opening a string.
BASED_LITERAL = r"[0-9]*'[sS]?[bBoOdDhH][0-9a-fA-FxXzZ_?]+"


def _stepping_over(style: MaskStyle) -> str:
    return rf"(?=[/\"'0-9])(?:{BASED_LITERAL}|{style.pattern})"


def _is_masked(hit: Column) -> Column:
    return ~hit.rlike(rf"\A{BASED_LITERAL}\z")


def mask(text: Column, style: MaskStyle, *, keep_based_literals: bool = False) -> Column:
    """``struct<masked string, hits array<string>>`` of a text."""
    pattern = _stepping_over(style) if keep_based_literals else style.hit_pattern

    def joined(pieces: Column, found: Column) -> Column:
        if keep_based_literals:
            return bind(_numbered(found), lambda marks: _weave(pieces, found, marks))
        return F.array_join(
            F.flatten(
                F.transform(
                    pieces,
                    lambda piece, i: F.when(
                        i < F.size(found),
                        F.array(piece, _placeholder(F.get(found, i), i.cast("int"), style)),
                    ).otherwise(F.array(piece)),
                )
            ),
            "",
        )

    def _numbered(found: Column) -> Column:
        # Running count of masked hits before each position.
        return F.aggregate(
            found,
            F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("n")),
            lambda acc, hit: F.struct(
                F.array_append(acc["ids"], F.when(_is_masked(hit), acc["n"]).otherwise(-1)).alias("ids"),
                (acc["n"] + _is_masked(hit).cast("int")).alias("n"),
            ),
            lambda acc: acc["ids"],
        )

    def _weave(pieces: Column, found: Column, marks: Column) -> Column:
        return F.array_join(
            F.transform(
                pieces,
                lambda piece, i: F.concat(
                    piece,
                    F.when(i >= F.size(found), F.lit(""))
                    .when(F.get(marks, i) < 0, F.get(found, i))
                    .otherwise(_placeholder(F.get(found, i), F.get(marks, i), style)),
                ),
            ),
            "",
        )

    def build(found: Column) -> Column:
        hits = F.filter(found, _is_masked) if keep_based_literals else found
        return F.struct(
            bind(F.split(text, pattern, -1), lambda pieces: joined(pieces, found)).alias("masked"),
            hits.alias("hits"),
        )

    return bind(F.regexp_extract_all(text, F.lit(pattern), 0), build)


def _placeholder(hit: Column, n: Column, style: MaskStyle) -> Column:
    number = n.cast("string")
    if not style.kinds:
        before, after = style.template.split("{n}")
        return F.concat(F.lit(before), number, F.lit(after))
    kind = F.lit(style.kinds[-1][1])
    for opening, name in reversed(style.kinds[:-1]):
        kind = F.when(hit.startswith(opening), name).otherwise(kind)
    head, rest = style.template.split("{kind}")
    middle, tail = rest.split("{n}")
    return F.concat(F.lit(head), kind, F.lit(middle), number, F.lit(tail))


def unmask(text: Column, hits: Column, style: MaskStyle) -> Column:
    """Put the originals back in one pass; the placeholder's number is the position in ``hits``.

    A placeholder-like text without a hit of that number is left as it is.
    """
    pattern = style.placeholder_pattern

    def restored(originals: Column, found: Column, pieces: Column) -> Column:
        def original(i: Column) -> Column:
            literal = F.get(found, i)
            number = F.regexp_extract(literal, pattern, 1).try_cast("int")
            return F.coalesce(F.get(originals, number), literal)

        return F.array_join(
            F.transform(
                pieces,
                lambda piece, i: F.when(
                    i < F.size(found), F.concat(piece, original(i))
                ).otherwise(piece),
            ),
            "",
        )

    def woven(originals: Column) -> Column:
        return bind(
            F.regexp_extract_all(text, F.lit(pattern), 0),
            lambda found: bind(
                F.split(text, pattern, -1), lambda pieces: restored(originals, found, pieces)
            ),
        )

    return bind(hits, lambda originals: F.when(F.size(originals) == 0, text).otherwise(woven(originals)))
