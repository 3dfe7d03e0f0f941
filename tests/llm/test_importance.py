"""Importance resampling against a plain model of the same law, and its table against a dictionary."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from faultloom.llm import importance_sampling
from faultloom.llm.importance_sampling import SlotTable, drawn_documents, importance_sample, interned
from tests.llm.test_llm import ODD, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)], len(words)


def brute(rows, target, most=1, buckets=10_000, least=20, percent=10, seed=2024):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s = Counter(bucket(f) for _, text in rows for f in features(text, most)[0])
    t = Counter(bucket(f) for text in target for f in features(text, most)[0])
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))

    out = []
    for key, text in rows:
        own, words = features(text, most)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(own), weight, score, None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[: len(able) * percent // 100]):
        row[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def texts(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["tiger", "Löwe", "x1", "日本", "the", "of", "a", "é", "ABBA"] + [f"w{i}" for i in range(60)]
    return [
        "".join(rnd.choice(vocabulary[: rnd.choice([6, 69])]) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(rnd.randint(0, 70)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("most, buckets, percent", [(1, 10_000, 10), (3, 50, 33), (2, 1, 100)])
def test_equals_brute_force(spark, monkeypatch, most, buckets, percent):
    rows = list(enumerate(texts(150, 1))) + ODD + [(3, t) for t in texts(1, 2) * 60]
    target = texts(20, 3) + [None, ""]
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, bucket int")
    got = importance_sample(documents(spark, rows), items, max_words=most, buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, target, most, buckets, 20, percent)


def test_table_interns_like_a_dictionary(monkeypatch):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))).encode() for _ in range(3000)]
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    for hashed in (None, lambda b: len(b), lambda b: 2**64 - 1):  # also keys that collide
        if hashed:
            monkeypatch.setattr(importance_sampling.xxhash, "xxh64_intdigest", hashed)
        table = SlotTable(data, starts, ends)
        slot_of = dict(zip(words, table.slots.tolist()))
        assert [slot_of[w] for w in words] == table.slots.tolist()
        assert len(set(slot_of.values())) == len(slot_of) == len(table.used)
        counts = Counter(words)
        assert {w: int(table.counts()[s]) for w, s in slot_of.items()} == counts
        assert {w: int(table.buckets(97)[s]) for w, s in slot_of.items()} == {w: zlib.crc32(w) % 97 for w in counts}


@pytest.mark.parametrize("most", [1, 2, 4])
def test_long_texts_are_cut_without_loss(monkeypatch, most):
    monkeypatch.setattr(importance_sampling, "BATCH_BYTES", 7)
    rows = texts(40, 5) + ["", None, "x" * 100 + " y", " . ", "a " * 30, "ende"]
    got, n_words = [Counter() for _ in rows], [0] * len(rows)
    for table, own, (at, words) in interned([None if t is None else t.encode() for t in rows], most):
        for row, start, end in zip(own.tolist(), table.starts.tolist(), table.ends.tolist()):
            got[row][table.data[start:end].decode()] += 1
        for row, n in zip(at.tolist(), words.tolist()):
            n_words[row] += n
    want = [features(t, most) for t in rows]
    assert got == [Counter(f) for f, _ in want] and n_words == [n for _, n in want]


def test_empty_tables_and_drawn_rows(spark):
    rows = list(enumerate(texts(80, 6)))
    docs = documents(spark, rows)
    items = spark.createDataFrame([(1, t) for t in texts(10, 7)], "item_id long, text string")
    assert importance_sample(docs.limit(0), items).count() == 0
    none = importance_sample(docs, items.limit(0))
    assert sorted((tuple(r) for r in none.collect()), key=str) == brute(rows, [])
    drawn = drawn_documents(docs.withColumn("rank", docs.key).withColumn("_drawn", docs.key), items, percent=40)
    assert drawn.columns == [*docs.columns, "rank", "_drawn"]
    want = {r[0] for r in brute(rows, [r.text for r in items.collect()], percent=40) if r[4] is not None}
    assert {r.doc_id for r in drawn.collect()} == want and want
