"""Suffix-array dedup: bytes covered by a string of ``span`` bytes that starts more than once are removed.

Start positions fall into units. A trigger is a place whose 16 bytes hash into one of ``rate`` values; a unit is
the starts from one trigger (exclusive) to the next (inclusive), so starts of equal strings stand at equal
distances from equal triggers. Units are narrowed down without loss:

* a unit whose first ``core`` bytes from its trigger occur nowhere else repeats nowhere;
* all starts of units that are equal up to the end of their last string repeat;
* the remaining different units around an equal core, one of each kind, are sorted as suffixes.

The sort is the difference-cover scheme on 8-byte symbols: triples at the sampled places are named by a
distributed sort, names are the symbols of the next level until a string has one symbol left, and the
symbols not sampled are merged as the leading part of the key. Neighbours in suffix order are compared for
their common prefix; the starts before a trigger are merged in by their bytes up to it and the trigger's
place in suffix order. Starts without a trigger near, and units around a core with very many kinds, are
compared as strings of their own by hash and count, which splits any hot value.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import buffer_of, every, mix, spans, sums
from .decontaminate import BITMAP_BITS, bitmap, nominated
from .shared import Scratch

GRAM = 16


@dataclass(frozen=True)
class Law:
    """Bytes of the strings that must not repeat, and how their starts are put into units: one place in
    ``rate`` is a trigger, and one at most ``reach`` bytes on is shared by all starts of a unit."""

    span: int = 400
    reach: int = 192
    rate: int = 32

    @property
    def core(self) -> int:
        return self.span - self.reach


#: Strings of 400 bytes.
LONG = Law()
#: Strings of 200 bytes, which over 50 words of four bytes with their spaces hold.
PASSAGE = Law(200, 96, 16)

#: Kinds around one core that one task sorts together; more take the way by hash.
KINDS = 50_000


def text_id() -> tuple:
    """Two hashes that name a text."""
    return F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2")


def units(data: np.ndarray, law: Law):
    """Units ``(low, high, place)`` of a text, explicit starts, and its prefix sums."""
    n = len(data)
    prefix = sums(data)
    trigger = np.flatnonzero(every(prefix, GRAM) < np.uint64((1 << 64) // law.rate))
    before = np.concatenate([[-1], trigger])[:-1] if len(trigger) else trigger
    low = np.maximum(before + 1, trigger - law.reach + 1)
    high = np.minimum(trigger, n - law.span)
    good = low <= high
    bounds = np.concatenate([trigger - law.reach, [n - law.span]])
    begins = np.concatenate([before, trigger[-1:] if len(trigger) else [-1]]) + 1
    bounds = np.minimum(bounds, n - law.span)
    some = bounds >= begins
    lone = [np.arange(b, e + 1) for b, e in zip(begins[some].tolist(), bounds[some].tolist())]
    return low[good], high[good], trigger[good], np.concatenate(lone) if lone else np.zeros(0, np.int64), prefix


def unit_hashes(prefix, low, high, place, law):
    core = spans(prefix, place, place + law.core)
    shape = ((place - low) * 4096 + (place - high)).astype(np.uint64)
    return core, mix(spans(prefix, low, high + law.span) + mix(shape + np.uint64(1)))


def halves(prefix, starts, law):
    """Two hashes that name the string at each start."""
    middle = starts + law.span // 2
    return spans(prefix, starts, middle), spans(prefix, middle, starts + law.span)


def _signed(values):
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _texts(batch, column, law):
    """``(row, bytes)`` of the rows that are long enough to repeat a string."""
    data, offsets = buffer_of(batch.column(column))
    for row in np.flatnonzero(np.diff(offsets) >= law.span).tolist():
        yield row, data[offsets[row] : offsets[row + 1]]


def _batches(names, parts, flush: int = 200_000):
    """Record batches from tuples of arrays, put together until ``flush`` rows are held."""
    held, count = [], 0
    for part in parts:
        held.append(part)
        count += len(part[0])
        if count >= flush:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, count = [], 0
    if count:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def _as_long(values):
    return np.asarray(values, np.uint64).view(np.int64)


def _lone_windows(lone, prefix, law):
    """Of the starts that belong to no unit: hashes, starts and how often each string is among them."""
    h1, h2 = halves(prefix, lone, law)
    order = np.lexsort((lone, h2, h1))
    h1, h2, lone = h1[order], h2[order], lone[order]
    new = np.ones(len(lone), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    group = np.cumsum(new) - 1
    return h1, h2, lone, new, np.bincount(group, minlength=int(new.sum()))[group] if len(lone) else lone


def _joined(one, two):
    """Rows for units and rows for lone starts, one below the other, told apart by a first column."""
    sizes = len(one[0]), len(two[0])
    return (np.repeat([False, True], sizes), *(np.concatenate([a, b]) for a, b in zip(one, two)))


def repeated_hashes(texts: DataFrame, law: Law) -> DataFrame:
    """``(lone, x, z, several)`` of what occurs more than once, from one reading of the texts.

    Of units ``x`` names the core; several: around different units. Of starts outside units, ``lone``, x and
    z name the string; they are counted per text first.
    """

    def run(batches):
        def parts():
            for batch in batches:
                for _, data in _texts(batch, 0, law):
                    low, high, place, lone, prefix = units(data, law)
                    core, unit = unit_hashes(prefix, low, high, place, law)
                    none, one = np.zeros(len(core), np.int64), np.ones(len(core), np.int64)
                    of_units = (_as_long(core), none, one, _as_long(unit))
                    if not len(lone):  # most texts
                        yield (none != 0, *of_units)
                        continue
                    h1, h2, _, new, times = _lone_windows(lone, prefix, law)
                    yield _joined(
                        of_units,
                        (_as_long(h1[new]), _as_long(h2[new]), times[new], np.zeros(int(new.sum()), np.int64)),
                    )

        yield from _batches(["lone", "x", "z", "n", "unit"], parts())

    rows = texts.select("text").mapInArrow(run, "lone boolean, x long, z long, n long, unit long")
    found = rows.groupBy("lone", "x", "z").agg(F.sum("n").alias("n"), F.min("unit").alias("a"), F.max("unit").alias("b"))
    return found.where("n > 1").select("lone", "x", "z", (F.col("a") != F.col("b")).alias("several"))


#: Bits of the largest bitmap that tasks receive, 16 MB; over 16 million hashes it lets more of the others pass.
MOST_BITS = 1 << 27


def sized_bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the hashes ``h`` with eight bits or more for each of them, up to ``MOST_BITS``."""
    wanted = max(8 * hashes.count(), BITMAP_BITS)
    return bitmap(hashes, min(1 << (wanted - 1).bit_length(), MOST_BITS))


def occurrences(texts: DataFrame, often: DataFrame, law: Law) -> DataFrame:
    """Where what occurs more than once stands: ``(lone, core, unit, t1, t2, low, high, place, several)``.

    For lone starts ``low`` to ``high`` are starts that repeat; those that repeat within their text are sure
    and need no partner in the join.
    """
    cores = sized_bitmap(often.where("not lone").select(F.col("x").alias("h")))
    strings = sized_bitmap(often.where("lone").select(F.col("x").alias("h")))

    def run(batches):
        def parts():
            for batch in batches:
                ids = [batch.column(i).to_numpy() for i in (1, 2)]
                for row, data in _texts(batch, 0, law):
                    low, high, place, lone, prefix = units(data, law)
                    core, unit = unit_hashes(prefix, low, high, place, law)
                    hit = nominated(cores, core)
                    size = int(hit.sum())
                    none = np.zeros(size, np.int64)
                    of_units = (_as_long(core[hit]), none, low[hit], high[hit], place[hit], _as_long(unit[hit]), none != 0)
                    if not len(lone):  # most texts
                        if size:
                            yield (none != 0, *of_units, *(np.full(size, i[row]) for i in ids))
                        continue
                    h1, h2, lone, _, times = _lone_windows(lone, prefix, law)
                    own = np.sort(lone[times > 1])
                    first = np.flatnonzero(np.diff(own, prepend=-2) != 1)
                    last = np.append(first[1:] - 1, len(own) - 1)[: len(first)]
                    ask = nominated(strings, h1) & (times == 1)
                    count = len(first) + int(ask.sum())
                    # The keys of sure rows only spread them over the join.
                    x = np.concatenate([own[first] ^ ids[0][row], _as_long(h1[ask])])
                    z = np.concatenate([np.full(len(first), ids[1][row]), _as_long(h2[ask])])
                    low, high = np.concatenate([own[first], lone[ask]]), np.concatenate([own[last], lone[ask]])
                    none = np.zeros(count, np.int64)
                    rows = _joined(of_units, (x, z, low, high, none, none, np.arange(count) < len(first)))
                    yield (*rows, *(np.full(size + count, i[row]) for i in ids))

        yield from _batches(["lone", "x", "z", "low", "high", "place", "unit", "sure", "t1", "t2"], parts())

    kinds = "lone boolean, x long, z long, low long, high long, place long, unit long, sure boolean, t1 long, t2 long"
    rows = texts.select("text", "t1", "t2").mapInArrow(run, kinds)
    rows = rows.join(often, ["lone", "x", "z"], "left").where("sure or several is not null")
    return rows.select("lone", F.col("x").alias("core"), "unit", "t1", "t2", "low", "high", "place", "several")


CONTENT = "core long, unit long, down int, up int, left binary, right binary"


def contents(texts: DataFrame, chosen: DataFrame, law: Law) -> DataFrame:
    """Bytes of one example of each chosen unit: those before its trigger and those from it on."""
    wanted = chosen.groupBy("t1", "t2").agg(F.collect_list(F.struct("core", "unit", "low", "high", "place")).alias("own"))
    one_each = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    rows = one_each.join(wanted, ["t1", "t2"]).select("text", "own")

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("core", "unit", "down", "up", "left", "right")}
            for text, own in zip(batch.column(0).cast(pa.large_binary()), batch.column(1)):
                raw = text.as_py()
                for u in own.as_py():
                    low, high, place = u["low"], u["high"], u["place"]
                    out["core"].append(u["core"])
                    out["unit"].append(u["unit"])
                    out["down"].append(place - low)
                    out["up"].append(place - high)
                    out["left"].append(raw[low:place])
                    out["right"].append(raw[place : high + law.span])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return rows.mapInArrow(run, CONTENT)


def named(scratch: Scratch, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct tuples of ``columns`` with ``name``: their place in sorted order from 1, by a range sort."""

    def number(batches):
        import itertools

        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            at = pa.array([next(count) for _ in range(batch.num_rows)], pa.int64())
            where = pa.array(np.full(batch.num_rows, part, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, where, at], [*batch.schema.names, "part", "at"])

    ordered = rows.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    kinds = ", ".join(f"{c} long" for c in columns)
    placed = scratch.table(ordered.mapInArrow(number, f"{kinds}, part long, at long"))
    sizes = sorted(tuple(r) for r in placed.groupBy("part").count().collect())  # one row per partition
    offsets, total = {}, 1
    for part, size in sizes:
        offsets[part] = total
        total += size
    pairs = [F.lit(x).cast("long") for p in offsets.items() for x in p]
    offset = F.create_map(*pairs)[F.col("part")] if pairs else F.lit(1).cast("long")
    return placed.select(*columns, (offset + F.col("at")).alias("name"))


def suffix_keys(scratch: Scratch, held: DataFrame, core: int) -> DataFrame:
    """``(id, keys)``: the order of ``keys`` is that of the bytes after the core."""

    @F.pandas_udf("array<long>")
    def symbols(right: pd.Series) -> pd.Series:
        out = []
        for raw in right:
            tail = raw[core:]
            tail += b"\0" * (-len(tail) % 8)
            big = np.frombuffer(tail, ">u8").astype(np.uint64)
            out.append((big ^ np.uint64(1 << 63)).view(np.int64))
        return pd.Series(out)

    now = held.select("id", symbols("right").alias("s"))
    now = scratch.table(now.select("id", F.array(F.get("s", F.lit(0))).alias("keys"), _rest("s").alias("s")))
    while now.agg(F.max(F.size("s"))).first()[0]:
        triples = now.select("id", F.posexplode(_triples("s")).alias("at", "t"))
        triples = triples.select("id", "at", F.col("t")[0].alias("x"), F.col("t")[1].alias("y"), F.col("t")[2].alias("z"))
        triples = scratch.table(triples)
        names = named(scratch, triples, ["x", "y", "z"])
        levels = triples.join(names, ["x", "y", "z"]).groupBy("id")
        levels = levels.agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("own"))
        levels = levels.select("id", F.col("own.name").alias("next"))
        now = scratch.table(
            now.join(levels, "id", "left").select(
                "id",
                F.array_append("keys", F.coalesce(F.get("next", F.lit(0)), F.lit(0))).alias("keys"),
                F.coalesce(_rest("next"), F.array().cast("array<long>")).alias("s"),
            ),
            replaces=now,
        )
        scratch.drop(triples)
    return now.select("id", "keys")


def _rest(name):
    return F.slice(F.col(name), 2, F.greatest(F.size(name) - 1, F.lit(0)))


def _triples(name):
    """The sampled symbols in threes; the last is filled up with a symbol below all others."""
    least = F.lit(-(2**63)).cast("long")
    count = F.ceil(F.size(name) / 3).cast("int")
    at = F.when(F.size(name) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    pick = lambda i, j: F.coalesce(F.get(F.col(name), (i * 3 + j).cast("int")), least)
    return F.transform(at, lambda i: F.array(pick(i, 0), pick(i, 1), pick(i, 2)))


def repeated_starts(batch: pa.Table, span: int):
    """Of units in suffix order: ``(unit row, first, last)`` runs of distances before the trigger that repeat."""
    count = batch.num_rows
    core = batch.column("core").to_numpy()
    down, up = batch.column("down").to_numpy(), batch.column("up").to_numpy()
    left = [v.as_py() for v in batch.column("left")]
    right = [v.as_py() for v in batch.column("right")]
    sizes = np.array([len(r) for r in right])
    common = np.zeros(count, np.int64)  # prefix in common with the unit before
    wide = np.zeros((min(count, 4096) + 1, span), np.uint8)
    for at in range(0, count, 4096):
        rows = range(max(0, at - 1), min(count, at + 4096))
        for k, i in enumerate(rows):
            wide[k, : sizes[i]] = np.frombuffer(right[i], np.uint8)
            wide[k, sizes[i] :] = 0
        differ = wide[1 : len(rows)] != wide[: len(rows) - 1]
        same = np.where(differ.any(1), differ.argmax(1), span)
        own = np.arange(rows[0] + 1, rows[-1] + 1)
        common[own] = np.minimum(same, np.minimum(sizes[own], sizes[own - 1]))
    common[np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))] = -1
    part = np.zeros(count, np.int64)
    open_at = np.full(count, -1)
    found = []
    live = np.arange(count)
    a = 0
    while len(live):
        able = live[up[live] <= a]
        if len(able):
            group = np.cumsum(common < span - a)[able]
            key = group * (count + 1) + part[able]
            _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
            repeats = times[inverse] > 1
            begin = able[repeats & (open_at[able] < 0)]
            open_at[begin] = a
            ended = able[~repeats & (open_at[able] >= 0)]
            found += [(i, int(open_at[i]), a - 1) for i in ended.tolist()]
            open_at[ended] = -1
        last = live[(down[live] <= a)]
        found += [(i, int(open_at[i]), a) for i in last[open_at[last] >= 0].tolist()]
        live = live[down[live] > a]
        if len(live):
            byte = np.fromiter((left[i][-1 - a] for i in live.tolist()), np.int64, len(live))
            _, part[live] = np.unique(part[live] * 256 + byte, return_inverse=True)
        a += 1
    return found


def sorted_runs(scratch: Scratch, held: DataFrame, law: Law) -> DataFrame:
    """``(core, unit, first, last)`` from the suffix order of the units of each core."""
    keys = suffix_keys(scratch, held, law.core)
    rows = held.join(keys, "id").repartition("core").sortWithinPartitions("core", "keys").drop("keys", "id")

    def run(batches):
        held, size = [], 0

        def result(table):
            found = repeated_starts(table, law.span)
            rows, first, last = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            core, unit = (table.column(c).to_numpy()[rows] for c in ("core", "unit"))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (core, unit, first, last)], ["core", "unit", "first", "last"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * KINDS:  # all complete cores; the last may go on
                table = pa.Table.from_batches(held).combine_chunks()
                core = table.column("core").to_numpy()
                cut = int(np.flatnonzero(core != core[-1])[-1]) + 1 if (core != core[-1]).any() else 0
                if cut:
                    yield result(table[:cut])
                    held = table[cut:].to_batches()
                    size -= cut
        if size:
            yield result(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, "core long, unit long, first long, last long")


def hashed_runs(held: DataFrame, law: Law) -> DataFrame:
    """The same for units of cores with very many kinds, by the hash of every string."""

    def run(batches):
        def parts():
            for batch in batches:
                cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    raw = np.frombuffer(cols["left"][i].as_py() + cols["right"][i].as_py(), np.uint8)
                    down, up = cols["down"][i].as_py(), cols["up"][i].as_py()
                    starts = np.arange(0, down - up + 1)
                    h1, h2 = halves(sums(raw), starts, law)
                    fill = [np.full(len(starts), cols[c][i].as_py(), np.int64) for c in ("core", "unit")]
                    yield _as_long(h1), _as_long(h2), *fill, down - starts

        yield from _batches(["h1", "h2", "core", "unit", "first"], parts())

    rows = held.drop("id").mapInArrow(run, "h1 long, h2 long, core long, unit long, first long")
    often = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(often, ["h1", "h2"]).select("core", "unit", "first", F.col("first").alias("last"))


def repeated_ranges(scratch: Scratch, texts: DataFrame, law: Law) -> DataFrame:
    """``(t1, t2, ranges)``: per text the ranges of starts, last included, whose strings start elsewhere too."""
    texts = texts.where(F.octet_length("text") >= law.span)
    often = scratch.table(repeated_hashes(texts, law))
    places = scratch.table(occurrences(texts, often, law))
    seen = places.where("not lone").drop("lone")
    kinds = seen.groupBy("core", "unit").agg(
        F.count("*").alias("n"),
        F.first("several").alias("several"),
        F.min(F.struct("t1", "t2", "low", "high", "place")).alias("example"),
    )
    kinds = scratch.table(kinds)
    several = kinds.where("several").select("core", "unit", "example.*")
    many = several.groupBy("core").agg(F.count("*").alias("kinds")).where(f"kinds > {KINDS}").select("core")
    chosen = sized_bitmap(several.select(F.col("t1").alias("h")))
    held = contents(texts.where(_may(chosen)("t1")), several, law)
    held = scratch.table(held.select(F.monotonically_increasing_id().alias("id"), "*"), replaces=often)
    runs = sorted_runs(scratch, held.join(many, "core", "left_anti"), law)
    runs = runs.unionByName(hashed_runs(held.join(many, "core", "left_semi"), law))
    none = F.lit(None).cast("long")
    whole = kinds.where("n > 1").select("core", "unit", none.alias("first"), none.alias("last"))
    verdicts = scratch.table(whole.unionByName(runs), replaces=held)
    found = seen.join(verdicts, ["core", "unit"]).select(
        "t1",
        "t2",
        F.coalesce(F.col("place") - F.col("last"), "low").alias("a"),
        F.coalesce(F.col("place") - F.col("first"), "high").alias("b"),
    )
    lone = places.where("lone").select("t1", "t2", F.col("low").alias("a"), F.col("high").alias("b"))
    ranges = scratch.table(found.distinct().unionByName(lone), replaces=places)
    return ranges.groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def _may(bits: np.ndarray):
    """A filter on a long column that lets everything in the bitmap pass."""

    @F.pandas_udf("boolean")
    def hit(values: pd.Series) -> pd.Series:
        return pd.Series(nominated(bits, values.to_numpy(np.int64).view(np.uint64)))

    return hit


def cut_text(raw: bytes, ranges, span: int) -> tuple[bytes, int]:
    """What is left of a text without the strings at the given starts, and the number of removed runs.

    ``ranges`` are two arrays, first and last starts.
    """
    first, last = ranges
    if not len(first):
        return raw, 0
    edge = np.bincount(first, minlength=len(raw) + 1) - np.bincount(last + span, minlength=len(raw) + 1)
    gone = np.cumsum(edge[:-1]) > 0
    spans_gone = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), spans_gone


def _cut(docs: DataFrame, text: str, keep: list, result, schema: str, law: Law):
    """Rows with repeats go through ``result(text bytes, ranges)``; the others stay as they are."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, body.alias("text")).select("*", *text_id())
    ranges = scratch.table(repeated_ranges(scratch, rows.select("text", "t1", "t2"), law))
    may = _may(sized_bitmap(ranges.select(F.col("t1").alias("h"))))
    names = [f for f in rows.schema.fieldNames() if f not in ("t1", "t2", "text")]
    with_ranges = rows.where(may("t1")).join(ranges, ["t1", "t2"], "left").select(*names, "text", "ranges")
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(len(names)).cast(pa.large_binary()), batch.column(len(names) + 1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            first, last = (lists.flatten().field(n).to_numpy() for n in ("a", "b"))
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tolist()
            out = [result(t.as_py(), (first[i:j], last[i:j])) for t, i, j in zip(texts, at, at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *_columns(out, schema)], [*names, *schema.split()[::2]])

    return with_ranges.mapInArrow(run, f"{kinds}, " + ", ".join(f"{a} {b}" for a, b in _pairs(schema))), rows.where(~may("t1")), names


def _pairs(schema):
    parts = schema.split()
    return list(zip(parts[::2], parts[1::2]))


def _columns(out, schema):
    kinds = {"long": pa.int64(), "string": pa.string()}
    return [pa.array([o[i] for o in out], kinds[k]) for i, (_, k) in enumerate(_pairs(schema))]


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", law: Law = LONG) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)`` per row of ``docs``.

    Null texts are empty. Equal texts are copies of each other: of ``span`` bytes and more, all of them go, as
    the strings of each start elsewhere. Shorter texts are kept whole. Repeated rows and null keys stay rows
    of their own; an empty table gives no rows; other columns are ignored.
    """

    def result(raw, ranges):
        left, gone = cut_text(raw, ranges, law.span)
        return len(raw), len(raw) - len(left), gone, hashlib.sha256(left).hexdigest()

    columns = "n_bytes long n_removed long n_spans long kept_sha256 string"
    cut, rest, _ = _cut(docs, text, [F.col(key).alias("key")], result, columns, law)
    none = F.lit(0).cast("long")
    rest = rest.select(
        "key",
        F.octet_length("text").cast("long").alias("n_bytes"),
        none.alias("n_removed"),
        none.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
    return cut.unionByName(rest).withColumnRenamed("key", key)


def cut_repeats(docs: DataFrame, text: str = "text", length: str | None = "n_chars", law: Law = LONG) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` and ``length`` set to the characters left.

    Bytes of characters that a cut divides are dropped with it. Null texts stay null; no row goes.
    """

    def result(raw, ranges):
        return (cut_text(raw, ranges, law.span)[0].decode(errors="ignore"),)

    others = [c for c in docs.columns if c != text]
    keep = [F.col(c).alias(f"c{i}") for i, c in enumerate(others)] + [F.col(text).isNull().alias("none")]
    cut, rest, names = _cut(docs, text, keep, result, "left string", law)
    both = cut.unionByName(rest.select(*names, F.col("text").alias("left")))
    left = F.when(~F.col("none"), F.col("left"))
    out = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text: left}
    if length in out:
        kind = docs.schema[length].dataType
        out[length] = F.when(F.col("none"), out[length]).otherwise(F.length(left).cast(kind))
    return both.select(*(out[c].alias(c) for c in docs.columns))
