"""Spelling variants: a trie over letter-group counts finds words one edit apart.

A word's frequency vector counts its code points by letter group. One inserted code point raises one count
by one, one deleted lowers one, one replaced does both or neither. So the near words of a word lie in the
trie of all vectors within a surplus of one and a deficit of one, which a depth-first search spends on its
way down; the words at the leaves it reaches are verified code point by code point.

The trie is spread over the cluster by its upper part: a shard is the subtree below the first few counts, a
subtree with too many words is split by further counts, and a word visits the shards within its budget.
Each pair of vectors is met from one side only: the first count that differs must be a surplus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

# Code points fall into groups by their number modulo this; also the depth of the trie.
GROUPS = 12
# Depths at which the trie may be cut into shards; the words of a shard that is not cut further, and the
# queries one task answers from it.
CUTS = (3, 6, 9, 12)
SHARD_WORDS = 4_000

DELETE_MODULUS = 199
MIN_CHARS = 6
MIN_COUNT = 5
# A form has at least so many times the occurrences of its variant.
FORM_RATIO = 5

RUN = re.compile("[A-Za-zÀ-ÿ]+")
# Code points of a text looked at together, and distinct words a task counts before it passes them on.
SLICE_CHARS = 1 << 20
HELD_WORDS = 200_000


def lowered(run: str) -> str:
    """A-Z in lower case only; all code points of a run are below 256."""
    return run.encode("latin-1").lower().decode("latin-1")


def run_counts(text: str):
    """Occurrences of the lower-cased runs of a text, one Counter per slice; no run is cut."""
    start = 0
    while start < len(text):
        stop = start + SLICE_CHARS
        cut = RUN.match(text, stop) if stop < len(text) and RUN.match(text, stop - 1) else None
        stop = cut.end() if cut else stop
        found = Counter()
        for run, n in Counter(RUN.findall(text, start, stop)).items():
            found[lowered(run)] += n
        yield found
        start = stop


def thinned(key: str, run: str, modulus: int) -> str:
    """``run``, without one code point where the checksum of key and run says so."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    modulus: int = DELETE_MODULUS,
) -> DataFrame:
    """``(word, n)``: occurrences of the words over all documents, counted in each task before the shuffle."""

    def run(batches):
        held = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )
            held.clear()
            return batch

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                name = k.as_py() or ""
                for counts in run_counts(t.as_py() or ""):
                    for word, n in counts.items():
                        word = thinned(name, word, modulus)
                        if len(word) >= min_chars:
                            held[word] += n
                    if len(held) >= HELD_WORDS:
                        yield out()
        yield out()

    source = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def vector(word: str) -> list[int]:
    counts = [0] * GROUPS
    for c in word:
        counts[ord(c) % GROUPS] += 1
    return counts


def reachable(counts, start: int, stop: int, above: int, below: int):
    """Counts from group ``start`` to ``stop`` within the budget left, with what is then spent.

    ``above`` and ``below`` are the surplus and deficit spent so far. A deficit comes after the surplus only,
    so that of two different vectors the smaller one finds the larger.
    """
    if start == stop:
        yield (), above, below
        return
    own = counts[start]
    steps = [(own, above, below)]
    if not above:
        steps.append((own + 1, 1, below))
    if above and not below and own:
        steps.append((own - 1, above, 1))
    for count, a, b in steps:
        for rest, a2, b2 in reachable(counts, start + 1, stop, a, b):
            yield (count, *rest), a2, b2


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes the words equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :]


class Trie:
    """Words below one node: levels of counts, at the leaves the words by their first and last code points.

    One edit leaves the first or the last ``ends`` code points of a word of twice that length as they are, so
    a leaf with many words is searched through those that share one end with the query.
    """

    def __init__(self, depth: int, ends: int) -> None:
        self.depth, self.ends, self.root = depth, ends, {}

    def _ends(self, word: str):
        return (0, word[: self.ends]), (1, word[len(word) - self.ends :])

    def add(self, word: str, n: int) -> None:
        node = self.root
        for count in vector(word)[self.depth :]:
            node = node.setdefault(count, {})
        for end in self._ends(word):
            node.setdefault(end, []).append((word, n))

    def near(self, word: str, above: int, below: int):
        """Words one edit from ``word``; of a pair with equal vectors only the larger word is given."""
        counts = vector(word)
        stack = [(self.root, self.depth, above, below)]
        while stack:
            node, level, a, b = stack.pop()
            if level == GROUPS:
                pool = {w: n for end in self._ends(word) for w, n in node.get(end, ())}
                for other, n in pool.items():
                    if (a or word < other) and one_edit(word, other):
                        yield other, n
                continue
            own = counts[level]
            if own in node:
                stack.append((node[own], level + 1, a, b))
            if not a and own + 1 in node:
                stack.append((node[own + 1], level + 1, 1, b))
            if a and not b and own - 1 in node:
                stack.append((node[own - 1], level + 1, a, 1))


ROUTED = "shard string, leaf boolean, word string, n long, above int, below int"


def _spread(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows moved from shards of depth ``start`` to those of depth ``stop``: words to their own shard as
    leaves, queries to all that their budget reaches. At depth 0 every word is both."""

    def run(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                word, shard = row["word"], row["shard"]
                counts = vector(word)
                if row["leaf"] or not start:
                    own = shard + "".join(f"{c}," for c in counts[start:stop])
                    made.append((own, True, word, row["n"], 0, 0))
                if not row["leaf"] or not start:
                    for part, a, b in reachable(counts, start, stop, row["above"], row["below"]):
                        to = shard + "".join(f"{c}," for c in part)
                        made.append((to, False, word, row["n"], a, b))
            columns = list(zip(*made)) or [()] * 6
            types = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["shard", "leaf", "word", "n", "above", "below"]
            )

    return rows.mapInArrow(run, ROUTED)


def _search(rows: DataFrame, depth: int, ends: int) -> DataFrame:
    """Near pairs ``(word, n, other, other_n)`` of shards of one depth; a task holds one shard piece's trie."""

    def run(batches):
        trie, at = None, None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if (row["shard"], row["piece"], row["part"]) != at:
                    at, trie = (row["shard"], row["piece"], row["part"]), Trie(depth, ends)
                if row["leaf"]:
                    trie.add(row["word"], row["n"])
                else:
                    for other, n in trie.near(row["word"], row["above"], row["below"]):
                        made.append((row["word"], row["n"], other, n))
            columns = list(zip(*made)) or [()] * 4
            types = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["word", "n", "other", "other_n"]
            )

    place = ("shard", "piece", "part")
    dealt = rows.repartition(*place).sortWithinPartitions(*place, F.desc("leaf"))
    return dealt.mapInArrow(run, "word string, n long, other string, other_n long")


def _places(one: Column, rows: Column, most: int) -> Column:
    """Numbers of the pieces a row goes to, if a shard's ``rows`` of its kind lie in pieces of about ``most``:
    its own by its word's hash where ``one``, else all."""
    pieces = F.greatest(F.ceil(F.coalesce(rows, F.lit(0)) / most), F.lit(1)).cast("int")
    own = F.array(F.pmod(F.xxhash64("word"), pieces).cast("int"))
    return F.when(one, own).otherwise(F.sequence(F.lit(0), pieces - 1))


def near_pairs(
    scratch: Scratch, words: DataFrame, min_chars: int = MIN_CHARS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``(word, n, other, other_n)``: each unordered pair of words one edit apart, once.

    ``words`` holds each word once. Shards with over ``shard_words`` words are cut at the next depth; at the
    last one, where all words of a shard have one vector, they are cut by hash and asked piece by piece. A
    shard with more queries than that is copied, and each copy answers a part of them.
    """
    ends = max(min_chars // 2, 1)
    rows = words.select(
        F.lit("").alias("shard"), F.lit(True).alias("leaf"), "word", "n", F.lit(0).alias("above"), F.lit(0).alias("below")
    )
    found, start = [], 0
    for depth in CUTS:
        rows = scratch.table(_spread(rows, start, depth))
        sizes = rows.groupBy("shard").agg(F.count_if("leaf").alias("held"), F.count_if(~F.col("leaf")).alias("asked"))
        # Written, so that the join below knows the size of this table of the few large shards.
        large = scratch.table(sizes.where((F.col("held") > shard_words) | (F.col("asked") > shard_words)))
        sized = rows.join(large, "shard", "left")
        last = depth == CUTS[-1]
        settled = sized if last else sized.where(F.coalesce("held", F.lit(0)) <= shard_words)
        pieced = settled.withColumn("piece", F.explode(_places(F.col("leaf"), F.col("held"), shard_words)))
        pieced = pieced.withColumn("part", F.explode(_places(~F.col("leaf"), F.col("asked"), shard_words)))
        found.append(scratch.table(_search(pieced, depth, ends)))
        if last or large.where(F.col("held") > shard_words).isEmpty():
            break
        rows = sized.where(F.col("held") > shard_words).drop("held", "asked")
        start = depth
    return reduce(DataFrame.unionByName, found)


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words that have a form: forms followed to the last by doubling.

    Counts rise by ``FORM_RATIO`` with each step, so there is no cycle and a chain is as long as the
    logarithm of the largest count at most.
    """
    ways = scratch.table(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.table(ways.join(further, "root", "left").select("word", "root", "next"))
        if step.where("next is not null").isEmpty():
            return step.select("word", "root")
        ways = step.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: int = FORM_RATIO,
    modulus: int = DELETE_MODULUS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per word: ``word, form, root`` (strings), ``n, n_near, form_n`` (long).

    Words are runs of Latin letters up to U+00FF, A-Z lower-cased, thinned by the checksum of key and run.
    A word's form is its near word of most occurrences (ties: the smallest) if that has at least ``ratio``
    times the word's own; the root follows forms to the last. Null and empty texts have no words. A null key
    counts as an empty one in the checksum. Repeated rows and keys count each time. Other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(word_counts(docs, key, text, min_chars, min_count, modulus))
    pairs = near_pairs(scratch, words, min_chars, shard_words)
    turned = pairs.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")
    )
    rank = F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))
    best = pairs.unionByName(turned).groupBy("word").agg(F.count("*").alias("n_near"), F.min(rank).alias("best"))
    held = scratch.table(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"),
        )
    )
    forms = held.where("best is not null").select("word", F.col("best.word").alias("form"))
    return held.join(_roots(scratch, forms), "word", "left").select(
        "word",
        F.col("best.word").alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        "n_near",
        (-F.col("best.less")).alias("form_n"),
    )
