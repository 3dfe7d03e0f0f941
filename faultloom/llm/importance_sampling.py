"""Target-distribution importance resampling over hashed n-grams.

Runs of words are interned batch by batch in an open-addressed NumPy table: xxhash64 keys, linear probing, and
a comparison of the bytes wherever keys agree. A slot keeps its n-gram's bucket and count, so buckets are
computed once per distinct n-gram of a batch and counted by slots; when texts are weighed, each occurrence
gathers its bucket's gain through its slot id. Documents are then drawn without replacement by Gumbel keys.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import LOWER, WORD
from .shared import Scratch

# Words of the longest n-gram, buckets, words of a document that can be drawn, and the share drawn.
MAX_WORDS = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

# Bytes of text interned in one table; it has two slots or more for each occurrence.
BATCH_BYTES = 1 << 20

#: Bytes of words, A-Z lower-cased; all others become a space.
CANONICAL = bytes(int(LOWER[i]) if WORD[LOWER[i]] else 0x20 for i in range(256))


class SlotTable:
    """Open-addressed table of the spans of one buffer; ``slots`` has the slot id of every span."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        self.data, self.starts, self.ends = data, starts, ends
        self.size = 1 << max(2 * len(starts), 2).bit_length()
        hashed = map(xxhash.xxh64_intdigest, map(data.__getitem__, map(slice, starts.tolist(), ends.tolist())))
        self.slots = self._intern(np.fromiter(hashed, np.uint64, len(starts)))
        self.used = np.flatnonzero(self.owner >= 0)

    def _intern(self, keys: np.ndarray) -> np.ndarray:
        self.owner = np.full(self.size, -1, np.int64)  # the span whose bytes a slot stands for
        mask = self.size - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        found = np.empty(len(keys), np.int64)
        pending = np.arange(len(keys))
        while len(pending):
            here = at[pending]
            free = self.owner[here] < 0
            # Of several spans that meet a free slot the first one takes it: the last assignment stays.
            self.owner[here[free][::-1]] = pending[free][::-1]
            held = self.owner[here]
            same = np.flatnonzero(keys[held] == keys[pending])
            same = same[self._equal(held[same], pending[same])]
            found[pending[same]] = here[same]
            rest = np.ones(len(pending), bool)
            rest[same] = False
            pending = pending[rest]
            at[pending] = (at[pending] + 1) & mask
        return found

    def _equal(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which pairs of spans have the same bytes."""
        raw = np.frombuffer(self.data, np.uint8)
        sizes = self.ends[one] - self.starts[one]
        equal = sizes == self.ends[two] - self.starts[two]
        check = np.flatnonzero(equal & (one != two))
        if len(check):
            sizes = sizes[check]
            edges = np.cumsum(sizes) - sizes
            inner = np.arange(int(sizes.sum())) - np.repeat(edges, sizes)
            left = raw[np.repeat(self.starts[one[check]], sizes) + inner]
            right = raw[np.repeat(self.starts[two[check]], sizes) + inner]
            equal[check] = np.logical_and.reduceat(left == right, edges)
        return equal

    def buckets(self, count: int) -> np.ndarray:
        """The bucket of each slot in use, by the checksum of its bytes; slots not in use have bucket 0."""
        out = np.zeros(self.size, np.int64)
        own = self.owner[self.used]
        spans = map(self.data.__getitem__, map(slice, self.starts[own].tolist(), self.ends[own].tolist()))
        out[self.used] = np.fromiter(map(zlib.crc32, spans), np.int64, len(own)) % count
        return out

    def counts(self) -> np.ndarray:
        return np.bincount(self.slots, minlength=self.size)


def parts(texts, max_words: int):
    """Lists of ``(row, words already seen, canonical bytes)`` of about ``BATCH_BYTES`` bytes each.

    Longer texts come in several parts, cut between words. Each further one begins with the last
    ``max_words - 1`` words of the text before it, so that n-grams across the cut are seen once.
    """
    held, size = [], 0
    for row, text in enumerate(texts):
        raw = (text or b"").translate(CANONICAL)
        start, before = 0, []
        while True:
            stop = start + BATCH_BYTES
            cut = len(raw) if stop >= len(raw) else raw.find(b" ", stop)
            own = raw[start : cut if cut >= 0 else len(raw)].split()
            held.append((row, len(before), b" ".join(before + own)))
            size += len(held[-1][2])
            if size >= BATCH_BYTES:
                yield held
                held, size = [], 0
            if cut < 0 or cut >= len(raw):
                break
            start = cut
            before = (before + own)[1 - max_words :] if max_words > 1 else []
    if held:
        yield held


def interned(texts, max_words: int):
    """``(table, rows)`` per list of parts: the table of its n-grams and the row each one stands in; with
    ``(rows, words)``, the number of new words of each part."""
    for held in parts(texts, max_words):
        data = b"\n".join(p for _, _, p in held)
        raw = np.frombuffer(data, np.uint8)
        inside = np.concatenate([[False], raw > 0x20, [False]])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        words = np.array([p.count(b" ") + 1 if p else 0 for _, _, p in held], np.int64)
        seen = np.array([s for _, s, _ in held], np.int64)
        part = np.repeat(np.arange(len(held)), words)
        place = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
        first, last = [], []
        for n in range(1, max_words + 1):
            own = np.arange(max(len(starts) - n + 1, 0))
            # Inside one part, and not wholly inside the words that an earlier part has seen.
            good = (part[own] == part[own + n - 1]) & (place[own] + n > seen[part[own]])
            first.append(own[good])
            last.append(own[good] + n - 1)
        first, last = np.concatenate(first), np.concatenate(last)
        rows = np.array([r for r, _, _ in held], np.int64)
        yield SlotTable(data, starts[first], ends[last]), rows[part[first]], (rows, words - seen)


def _as_bytes(column) -> list:
    return column.cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, text: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: occurrences of n-grams per bucket, at most ``buckets`` rows from each task."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for table, _, _ in interned(_as_bytes(batch.column(0)), max_words):
                np.add.at(total, table.buckets(buckets)[table.used], table.counts()[table.used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths of a nat, from the counts of both sides; ``buckets`` numbers."""
    held = np.zeros((2, buckets))
    for side, counts in enumerate((source, target)):
        for row in counts.collect():
            held[side, row.bucket] = row.n
    s_all, t_all = held.sum(axis=1)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
            for s, t in zip(*held.tolist())
        ],
        np.int64,
    )


def weighed(docs: DataFrame, gain: np.ndarray, text: str, max_words: int) -> DataFrame:
    """``docs``, whose last column is the text, with ``n_words, n_features, weight`` in place of it."""
    share = docs.sparkSession.sparkContext.broadcast(gain)
    kept = docs.schema.fields[:-1]

    def run(batches):
        own = share.value
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for table, rows, (at, words) in interned(_as_bytes(batch.column(batch.num_columns - 1)), max_words):
                by_slot = own[table.buckets(len(own))]
                np.add.at(out[0], at, words)
                np.add.at(out[1], rows, 1)
                np.add.at(out[2], rows, by_slot[table.slots])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(x) for x in out)],
                [f.name for f in kept] + ["n_words", "n_features", "weight"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{fields}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """The key's draw from the Gumbel distribution in thousandths, rounded down, by its SHA-256 with the seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scratch: Scratch, rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in a total order, 1 first, whatever their number: sorted by ranges, then each
    range counts on from those before it. One number per range reaches the driver."""
    placed = scratch.table(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    before, starts = 0, []
    for row in sizes:
        starts.append((row["_part"], before))
        before += row["n"]
    start = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    found = placed.withColumn("_part", part).join(F.broadcast(start), "_part")
    return found.select(*rows.columns, (F.col("_start") + inside + 1).alias(name))


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    max_words: int = MAX_WORDS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per document row: ``key, n_features, weight, score, rank``.

    Features are all runs of 1 to ``max_words`` words. ``rank`` numbers the drawn rows, ``percent`` of those
    with at least ``least_words`` words, rounded down; others have none. Null and empty texts have no words
    and weigh 0. A null key draws as an empty one and comes after all others among ties; repeated rows are
    rows of their own that share a score and take neighbouring ranks. Either table may be empty: without a
    target the gains are those of no evidence. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    gain = gains(
        bucket_counts(docs, text, max_words, buckets), bucket_counts(target, target_text, max_words, buckets), buckets
    )
    source = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    score = (F.col("weight") + gumbel(F.col("key"), seed)).alias("score")
    scored = scratch.table(
        weighed(source, gain, "text", max_words).select("key", "row", "n_words", "n_features", "weight", score)
    )
    able = scored.where(F.col("n_words") >= least_words)
    draw = able.count() * percent // 100
    # The row number parts equal keys, so that no range of the sort holds all rows of a hot one.
    placed = ranked(scratch, able, [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs``, all columns, of the keys drawn by :func:`importance_sample`; rows that share a key with a
    drawn one come with it."""
    own = importance_sample(docs, target, key, **options).where("rank is not null")
    drawn = own.select(F.col(key).alias("_drawn")).distinct()
    return docs.join(drawn, docs[key].eqNullSafe(drawn["_drawn"]), "left_semi")
