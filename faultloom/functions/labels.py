"""Expected and actual detection labels, and rounded percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FENCE

# Label domain in category order, path patterns (regular expressions: the dot matches
# any character), the "nothing found" phrase and the shortest response that counts.
CONTAINS_BUG = "contains_bug"
NO_BUG = "no_bug"
LABELS = (CONTAINS_BUG, NO_BUG)
BUGGY_PATH = "/buggy."
BASE_PATH = "/base."
UNKNOWN = "unknown"
NO_MODIFICATIONS = "No modifications detected"
VERY_SHORT = "response_very_short"
NO_CODE_BLOCK = "response_contains_no_code_block"
MIN_RESPONSE_CHARS = 20


def expected_label(path: Column) -> Column:
    """Label implied by the file's role in its challenge folder."""
    return (
        F.when(path.rlike(BUGGY_PATH), CONTAINS_BUG).when(path.rlike(BASE_PATH), NO_BUG).otherwise(UNKNOWN)
    )


def actual_label(response: Column) -> Column:
    """Label implied by the response; the order of the tests matters, a NULL passes them all."""
    return (
        F.when(response.contains(NO_MODIFICATIONS), NO_BUG)
        .when(F.char_length(response) < MIN_RESPONSE_CHARS, VERY_SHORT)
        .when(~response.contains(FENCE), NO_CODE_BLOCK)
        .otherwise(CONTAINS_BUG)
    )


def checked_label(label: Column, *, strict: bool = False) -> Column:
    """Keep a label; with ``strict`` fail the job on anything outside the two-value domain."""
    if not strict:
        return label
    message = F.concat(F.lit("label outside ("), F.lit(", ".join(LABELS)), F.lit("): "), label)
    return F.when(label.isin(*LABELS) | label.isNull(), label).otherwise(
        F.raise_error(message).cast("string")
    )


def label_order(label: Column) -> Column:
    """Category position of a label for sorting; labels outside the domain come after it."""
    order = F.when(label == LABELS[0], 0)
    for position, name in enumerate(LABELS[1:], start=1):
        order = order.when(label == name, position)
    return order.otherwise(len(LABELS))


def percent(part: Column, whole: Column, factor: int = 1) -> Column:
    """``part / whole`` in percent (times ``factor``), rounded half-to-even at two places.

    The value is scaled, rounded and scaled back on doubles, so decimal-looking ties such as 1.015
    round by their binary value.
    """
    value = part / whole * F.lit(100.0)
    if factor != 1:
        value = value * F.lit(float(factor))
    return F.rint(value * F.lit(100.0)) / F.lit(100.0)
