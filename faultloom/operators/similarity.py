"""Best similarity of text sides against candidate blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import make_matcher


def make_scorer(stop_at: float = 1.0, autojunk: bool = True):
    """``best(sides, blocks)``: for every side the highest ``2M/T`` ratio over all blocks.

    M counts the characters of matching runs (see :mod:`matching`), T both lengths. Blocks come in the order
    of an exact upper bound, the characters both have in common, so a side's best block is met early; a block
    whose bound cannot beat the best so far ends the search, and a match ends as soon as what is left of both
    texts cannot.
    """
    match = make_matcher(autojunk)

    def best(sides, blocks):
        from collections import Counter

        if sides is None or blocks is None:
            return None
        counted = {block: Counter(block) for block in blocks}
        known: dict = {}
        for text in sides:
            if text in known:
                continue
            if text in counted:
                known[text] = 1.0
                continue
            own = Counter(text)
            bounds = []
            for block, held in counted.items():
                few, many = (own, held) if len(own) < len(held) else (held, own)
                common = sum(min(n, many[x]) for x, n in few.items() if x in many)
                if common:
                    bounds.append((2.0 * common / (len(text) + len(block)), block))
            bounds.sort(key=lambda b: -b[0])
            top = 0.0
            for bound, block in bounds:
                if bound <= top or top >= stop_at:
                    break
                runs = match(text, block, top)
                if runs is not None:
                    top = max(top, 2.0 * sum(n for *_, n in runs) / (len(text) + len(block)))
            known[text] = top
        return [known[text] for text in sides]

    return best


def best_similarity(
    sides: Column, blocks: Column, *, stop_at: float = 1.0, autojunk: bool = True
) -> Column:
    """For every side the highest ``2M/T`` ratio over all blocks, as ``array<double>``.

    Both inputs are ``array<string>`` of one row, so no pair is ever materialised. Searching a side ends once
    ``stop_at`` is reached; the default 1.0 is the highest possible ratio and keeps the maximum exact. An
    empty side scores 0 unless a block is empty too; null inputs give null.
    """
    best = make_scorer(stop_at, autojunk)

    @F.pandas_udf("array<double>")
    def kernel(side_lists: pd.Series, block_lists: pd.Series) -> pd.Series:
        return pd.Series([best(s, b) for s, b in zip(side_lists, block_lists)], dtype=object)

    # Declared nondeterministic so that filters on its result do not run it twice.
    return kernel.asNondeterministic()(sides, blocks)
