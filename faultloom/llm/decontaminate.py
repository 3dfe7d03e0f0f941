"""Benchmark decontamination as a prefix-filtered set join of word shingles.

Item windows and document positions meet on shingles. A window is contained only where all its shingles
are, so by the prefix-filter principle one shingle, its rarest in the corpus, is a sufficient prefix. The
documents are read once: positions whose shingle passes a bitmap of fixed size over all item shingles are
kept as regions of text. Counts of those give the rarity order; the regions then join the windows' prefix
shingles, the offset of the shingle and the window's length bound the place, and the words decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import LOWER, buffer_of, mix, slices, spans, sums, words
from .shared import Scratch

WINDOW = 10
SHINGLE = 5
#: Bits of the bitmap that tasks receive: 1 MB, whatever the benchmark's size.
BITMAP_BITS = 1 << 23
SLICE_BYTES = 1 << 19


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` word hashes."""
    count = max(0, len(hashes) - width + 1)
    out = np.full(count, width, np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0x100000001B3) + hashes[j : j + count])
    return out


def item_windows(benchmark: DataFrame, item: str, text: str, window: int, shingle: int) -> DataFrame:
    """``(item_id, win, width, parts)`` per window; parts lists the shingles and their offsets."""

    def run(batches):
        for batch in batches:
            ids, wins, widths, parts = [], [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                data = LOWER[np.frombuffer(raw or b"", np.uint8)]
                starts, ends = words(data, np.zeros(0, np.int64))
                if not len(starts):
                    continue
                held = data.tobytes()
                tokens = [held[a:b] for a, b in zip(starts, ends)]
                width = min(window, len(tokens))
                size = min(shingle, width)
                hashes = shingle_hashes(spans(sums(data), starts, ends), size).view(np.int64).tolist()
                for at in range(len(tokens) - width + 1):
                    ids.append(key)
                    wins.append(b" ".join(tokens[at : at + width]).decode())
                    widths.append(width)
                    parts.append([{"h": hashes[at + o], "o": o} for o in range(width - size + 1)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch.column(0).type),
                    pa.array(wins, pa.string()),
                    pa.array(widths, pa.int32()),
                    pa.array(parts, pa.list_(pa.struct([("h", pa.int64()), ("o", pa.int32())]))),
                ],
                ["item_id", "win", "width", "parts"],
            )

    kind = benchmark.schema[item].dataType.simpleString()
    schema = f"item_id {kind}, win string, width int, parts array<struct<h: long, o: int>>"
    source = benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, schema)


def bitmap(shingles: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the hashes ``h``; at most ``bits`` / 64 numbers reach the driver."""
    at = F.col("h").bitwiseAND(bits - 1)
    rows = (
        shingles.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("slot"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def nominated(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of a bitmap."""
    slot = hashes & np.uint64(64 * len(bits) - 1)
    return ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


REGION = "array<struct<first: int, words: string, at: int, h: long>>"


def document_regions(docs: DataFrame, keep: list, text: str, filter_bits, window: int, sizes: list[int]) -> DataFrame:
    """The kept columns, ``n_words`` and the words around each nominated shingle of every row."""
    reach = window - 1

    def regions(held, starts, ends, hits):
        """The words that a window around each nominated position can reach, however close the positions lie."""
        out = []
        for p, h in sorted(hits):
            first = max(0, p - reach)
            own = b" ".join(held[starts[k] : ends[k]] for k in range(first, min(len(starts), p + window)))
            out.append({"first": first, "words": own.decode(), "at": p, "h": h})
        return out

    def piece(data, cuts, n_words, found, base):
        data = LOWER[data]
        starts, ends = words(data, cuts)
        edges = np.searchsorted(starts, cuts)
        n_words += np.diff(edges).tolist()
        hashes = spans(sums(data), starts, ends)
        owner = np.searchsorted(edges, np.arange(len(starts)), side="right") - 1
        hits = {}
        for size in sizes:
            h = shingle_hashes(hashes, size)
            slot = h & np.uint64(BITMAP_BITS - 1)
            hit = (filter_bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
            at = np.flatnonzero(hit)
            at = at[owner[at] == owner[at + size - 1]]
            for p, value in zip(at.tolist(), h[at].view(np.int64).tolist()):
                row = int(owner[p])
                hits.setdefault(row, []).append((p - int(edges[row]), value))
        held = data.tobytes() if hits else b""
        for row, own in hits.items():
            lo, hi = edges[row], edges[row + 1]
            found[base + row] = regions(held, starts[lo:hi], ends[lo:hi], own)

    region_type = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.string()), ("at", pa.int32()), ("h", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(batch.num_columns - 1))
            n_words, found = [], {}
            for a, b in slices(np.diff(offsets), SLICE_BYTES):
                piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n_words, found, a)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(n_words, pa.int64()),
                    pa.array([found.get(i, []) for i in range(batch.num_rows)], region_type),
                ],
                [*batch.schema.names[:-1], "n_words", "regions"],
            )

    source = docs.select(*keep, F.col(text).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, n_words long, regions {REGION}")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row per document row: ``key, text_sha256, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words and no hits. Repeated rows and keys stay rows of their own, null
    keys too. Repeated items count once; an item with a null id hits but is not listed. Empty tables on
    either side give no hits. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "contamination")
    wins = scratch.table(item_windows(benchmark, item, item_text, window, shingle))
    parts = wins.select("win", "width", F.explode("parts").alias("p")).select("win", "width", "p.h", "p.o").distinct()
    bits = bitmap(parts)
    sizes = [r[0] for r in wins.select(F.least("width", F.lit(shingle)).alias("s")).distinct().collect()]
    keep = [
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.sha2(F.col(text), 256).alias("stamp"),
    ]
    rows = scratch.table(document_regions(docs, keep, text, bits, window, sorted(sizes)))
    places = rows.select("row", F.explode("regions").alias("g")).select("row", "g.*")
    counts = rows.select(F.explode("regions.h").alias("h"))
    counts = counts.groupBy("h").agg(F.count("*").alias("seen"))
    ranked = parts.join(counts, "h", "left").groupBy("win", "width")
    prefix = ranked.agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "o")).alias("m"))
    prefix = prefix.where("m.seen > 0").select("win", "width", "m.h", "m.o")
    begin = F.col("at") - F.col("o")
    local = begin - F.col("first")
    near = places.join(prefix, "h").where(begin >= F.col("first"))
    near = near.where(F.array_join(F.slice(F.split("words", " "), local + 1, F.col("width")), " ") == F.col("win"))
    found = scratch.table(near.select("row", "win", begin.alias("begin"), (begin + F.col("width")).alias("end")).distinct())

    order = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest(F.col("begin"), F.coalesce(F.max("end").over(order), F.col("begin")))
    hit = found.select("row", F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy("row")
    hit = hit.agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = found.select("row", "win").distinct().join(wins.select("win", "item_id").distinct(), "win")
    items = items.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        rows.select("row", "key", "stamp", "n_words")
        .join(hit.join(items, "row", "left"), "row", "left")
        .select(
            F.col("key").alias(key),
            F.col("stamp").alias("text_sha256"),
            "n_words",
            n_hit.alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item window; a verdict follows the text alone."""
    bad = contamination(docs, benchmark, key, text).where("contaminated").select("text_sha256").distinct()
    return docs.join(bad, F.sha2(F.col(text), 256) == bad.text_sha256, "left_anti")
