"""Matching runs of two sequences, as the longest-run-first rule of the stdlib matcher defines them.

The rule: the longest common run of a range (the first in ``a``, then in ``b``) is a match, then both sides
of it are ranges of their own. With the popularity heuristic an element that makes up over a hundredth of a
long ``b`` starts no run, but lengthens one.

Instead of a search per match, all matches of a range's greatest length are taken in one sweep from left to
right: the next match right of a longest one is the next run of that length, and whatever lies between two of
them has shorter runs only. So a range is searched once per different length, however many matches it has.
"""

from __future__ import annotations

# With the heuristic an element of ``b`` that makes up more than a hundredth of at least so
# many starts no run.
POPULAR_FROM = 200
POPULAR_SHARE = 100

# Comparisons (run starts times stretch searched) up to which substring search is used for a range; larger
# ranges are searched by numbers of all their stretches.
SEARCHED = 30_000_000


def make_matcher(heuristic: bool, searched: int = SEARCHED):
    """``match(a, b, floor)`` for two strings or two lists of hashable elements.

    It gives the runs ``(i, j, n)`` in no order, or None as soon as twice their number of elements cannot
    exceed ``floor`` times both lengths; a floor below zero never gives None. A function made here travels
    to the workers by value, so the package need not be installed there.
    """
    popular_from, popular_share = POPULAR_FROM, POPULAR_SHARE

    def popular(b) -> set:
        if not heuristic or len(b) < popular_from:
            return set()
        from collections import Counter

        most = len(b) // popular_share + 1
        return {x for x, n in Counter(b).items() if n > most}

    def coded(a, b):
        """Both sides as strings in which equal places are those where a run may lie."""
        out = popular(b)
        if isinstance(a, str):
            chars = set(a) | set(b)
            free = (c for c in map(chr, range(1, 0x110000)) if c not in chars)
            mark_a, mark_b = next(free), next(free)
            if not out:
                return a, b
            return a.translate(dict.fromkeys(map(ord, out), mark_a)), b.translate(dict.fromkeys(map(ord, out), mark_b))
        ids: dict = {}
        for x in a:
            ids.setdefault(x, len(ids) + 2)
        for x in b:
            ids.setdefault(x, len(ids) + 2)
        if len(ids) + 2 > 0x110000:
            raise ValueError("more different lines than code points")
        code = {x: chr(n) for x, n in ids.items()}
        return (
            "".join(chr(0) if x in out else code[x] for x in a),
            "".join(chr(1) if x in out else code[x] for x in b),
        )

    class Stretches:
        """Stretches of both sides by number, equal for equal ones: doubling of lengths, made when asked for."""

        def __init__(self, a: str, b: str) -> None:
            import numpy as np

            self.np = np
            joined = a + b
            raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.levels = [np.unique(raw, return_inverse=True)[1]]
            self.width = len(joined) + 1
            self.b_at = len(a)

        def numbers(self, length: int, start: int, stop: int):
            """Numbers of all stretches of ``length`` within ``[start, stop)`` of the joined sides."""
            k = length.bit_length() - 1
            while len(self.levels) <= k:
                last, half = self.levels[-1], 1 << (len(self.levels) - 1)
                self.levels.append(self.np.unique(last[:-half] * self.width + last[half:], return_inverse=True)[1])
            head = self.levels[k][start : stop - length + 1]
            shift = length - (1 << k)
            return head * self.width + self.levels[k][start + shift : start + shift + len(head)]

        def sides(self, length, alo, ahi, blo, bhi):
            at = self.b_at
            return self.numbers(length, alo, ahi), self.numbers(length, at + blo, at + bhi)

        def longest(self, alo, ahi, blo, bhi, most):
            def some(length):
                return bool(self.np.isin(*self.sides(length, alo, ahi, blo, bhi)).any())

            low, high = 0, 1
            while high < most and some(high):
                low, high = high, min(2 * high, most)
            while low < high:
                middle = (low + high + 1) // 2
                if some(middle):
                    low = middle
                else:
                    high = middle - 1
            return low

        def places(self, length, alo, ahi, blo, bhi):
            """``next(i, b_from)``: the first place of the stretch at ``i`` in ``b`` from ``b_from``; and all
            ``i`` that have one in the range."""
            np = self.np
            left, right = self.sides(length, alo, ahi, blo, bhi)
            order = np.argsort(right, kind="stable")
            held = right[order]
            first, last = np.searchsorted(held, left, "left"), np.searchsorted(held, left, "right")
            starts = np.flatnonzero(last > first)
            order = order + blo

            def following(i, b_from):
                own = order[first[i - alo] : last[i - alo]]
                at = int(np.searchsorted(own, b_from))
                return int(own[at]) if at < len(own) else -1

            return (starts + alo).tolist(), following

    def match(a, b, floor: float = -1.0):
        from bisect import bisect_left

        total = len(a) + len(b)
        sa, sb = coded(a, b)
        in_b = set(sb)
        starts = [i for i, x in enumerate(sa) if x in in_b]
        numbered = None

        def longest(alo, ahi, blo, bhi, most):
            best = 0
            for i in starts[bisect_left(starts, alo) : bisect_left(starts, ahi)]:
                while best < most and i + best < ahi:
                    j = sb.find(sa[i : i + best + 1], blo, bhi)
                    if j < 0:
                        break
                    best += 1
                    while i + best < ahi and j + best < bhi and sa[i + best] == sb[j + best]:
                        best += 1
            return best

        def places(length, alo, ahi, blo, bhi):
            own = starts[bisect_left(starts, alo) : bisect_left(starts, ahi - length + 1)]
            return own, lambda i, b_from: sb.find(sa[i : i + length], b_from, bhi)

        found, matched = [], 0
        todo, left = [(0, len(a), 0, len(b), min(len(a), len(b)))], min(len(a), len(b))
        while todo:
            if floor >= 0 and 2.0 * (matched + left) <= floor * total:
                return None
            alo, ahi, blo, bhi, most = todo.pop()
            left -= min(ahi - alo, bhi - blo)
            most = min(most, ahi - alo, bhi - blo)
            inside = bisect_left(starts, ahi) - bisect_left(starts, alo)
            length, own, following = 0, (), None
            if not inside or not most:
                pass
            elif inside * (bhi - blo) <= searched:
                length = longest(alo, ahi, blo, bhi, most)
                own, following = places(length, alo, ahi, blo, bhi) if length else ((), None)
            else:
                numbered = numbered or Stretches(sa, sb)
                length = numbered.longest(alo, ahi, blo, bhi, most)
                own, following = numbered.places(length, alo, ahi, blo, bhi) if length else ((), None)
            if not length and not alo and not blo:
                # A range without a run start is still compared from its corner. All other corners follow a
                # match that could not be lengthened.
                n = 0
                while n < ahi and n < bhi and a[n] == b[n]:
                    n += 1
                if n:
                    found.append((0, 0, n))
                    matched += n
                continue
            gaps = []
            at_a, at_b = alo, blo
            for i in own:
                if i < at_a:
                    continue
                j = following(i, at_b)
                if j < 0:
                    continue
                end_i, end_j = i + length, j + length
                while i > at_a and j > at_b and a[i - 1] == b[j - 1]:
                    i, j = i - 1, j - 1
                while end_i < ahi and end_j < bhi and a[end_i] == b[end_j]:
                    end_i, end_j = end_i + 1, end_j + 1
                found.append((i, j, end_i - i))
                matched += end_i - i
                gaps.append((at_a, i, at_b, j))
                at_a, at_b = end_i, end_j
            for gap in (*gaps, (at_a, ahi, at_b, bhi)):
                size = min(gap[1] - gap[0], gap[3] - gap[2])
                if size > 0 and (length > 1 or not (gap[0] or gap[2])):
                    todo.append((*gap, length - 1))
                    left += size
        return found

    return match


def make_run_finder(heuristic: bool, searched: int = SEARCHED):
    """``find(a, b)``: the maximal matching runs ``(i, j, n)`` in order, touching ones made one."""
    match = make_matcher(heuristic, searched)

    def find(a, b) -> list[tuple[int, int, int]]:
        runs: list = []
        for i, j, n in sorted(match(a, b)):
            if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
                i, j, n = runs[-1][0], runs[-1][1], runs.pop()[2] + n
            runs.append((i, j, n))
        return runs

    return find
