"""Helpers for arrays built on the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (a let-binding for columns).

    Needed wherever a lambda looks at anything but its own variables: the optimizer merges a column's
    definition into its only user, and inside a lambda it would then be computed for every element.
    """
    return F.transform(F.array(value), body)[0]


def members(rows: Column, key: Callable[[Column], Column], marks: Column) -> Column:
    """``array<struct<row,hit>>``: which rows have their key among ``marks``, in the order of the keys.

    Both arrays hold a key once at most. One sort of the two together in place of a search per row, so the
    cost is n log n.
    """
    def together(x: Column) -> Column:
        none = lambda: F.get(x["rows"], F.lit(-1))
        marked = F.transform(x["marks"], lambda m: F.struct(m.alias("key"), F.lit(0).alias("kind"), none().alias("row")))
        listed = F.transform(x["rows"], lambda r: F.struct(key(r).alias("key"), F.lit(1).alias("kind"), r.alias("row")))
        return bind(F.array_sort(F.concat(marked, listed)), looked_up)

    def looked_up(own: Column) -> Column:
        paired = F.transform(
            own,
            lambda x, i: F.struct(
                x["kind"].alias("kind"),
                x["row"].alias("row"),
                F.coalesce(F.get(own, i - 1)["key"].eqNullSafe(x["key"]) & (i > 0), F.lit(False)).alias("hit"),
            ),
        )
        kept = F.filter(paired, lambda x: x["kind"] == 1)
        return F.transform(kept, lambda x: F.struct(x["row"].alias("row"), x["hit"].alias("hit")))

    return bind(F.struct(rows.alias("rows"), marks.alias("marks")), together)


def unnest(df: DataFrame, values: Column, *keep: str, item: str = "item", pos: str = "pos") -> DataFrame:
    """One row per element of a computed array, with its position.

    A plain ``explode`` makes the optimizer infer a "not empty" filter below it, and a computed array
    would then be computed twice, once for the filter. The outer form has no such filter; the rows it
    adds for empty arrays are dropped right after.
    """
    exploded = df.select(*keep, F.posexplode_outer(values).alias(pos, item))
    return exploded.where(F.col(pos).isNotNull())
