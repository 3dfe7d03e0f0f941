"""The training-data operators against brute force, round trips and odd inputs."""

from __future__ import annotations

import base64
import hashlib
import html
import io
import itertools
import pickle
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from faultloom.llm import byte_bpe, decontaminate, embedding_dedup, hnsw, html_text, language_id, suffix_dedup, toxicity, warc
from faultloom.llm.bytehash import mix
from faultloom.llm.embedding_dedup import embedding_groups
from faultloom.llm.html_text import extract_text, main_text
from faultloom.llm.language_id import languages
from faultloom.llm.ring_shards import ring_shards
from faultloom.llm.shared import Scratch, components
from faultloom.llm.simhash_dedup import (
    drop_near_copies,
    fingerprint,
    fingerprint_classes,
    plant,
    route,
    shard_forest,
    simhash_groups,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASH = "row long, key string, fp long, stamp string, regions string, ranges string, t1 long, shard string, _score double, _row_stamp string, _k long, _S long, _n long"


def documents(spark, rows):
    """Documents with null-able columns and further columns whose names operators use themselves."""
    out = spark.createDataFrame(
        [(k, t, None, None, None, 1, "k", 2, "s", "r", "x", 3, "h", 0.25, "own", 4, 5, 6) for k, t in rows],
        f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}",
    )
    return out.repartition(3)


ODD = [
    (1, None),
    (2, ""),
    (3, "one"),
    (4, "Two words"),
    (5, "a b c d e f g h i j k l"),
    (5, "a b c d e f g h i j k l"),
    (None, "a null key here"),
    (None, None),
    (6, "näïve ÄB 日本 \x00   end"),
    (7, "x" * 3000 + " " + "word " * 4000),
    (8, " \t\n "),
]


def brute_components(nodes, pairs):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (500, 500)]
    pairs += [(200, 200 + i) for i in range(1, 30)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components(Scratch(spark, "t"), df).collect()}
    assert got == brute_components({x for p in pairs for x in p}, pairs)
    assert components(Scratch(spark, "t"), df.limit(0)).count() == 0


# 1 embeddings


def test_embedding_groups(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] + rng.normal(size=16) * 0.08).tolist()) for i in range(120)]
    rows += [(300, base[0].tolist()), (301, (3 * base[0]).tolist()), (300, base[0].tolist()), (302, (-base[0]).tolist())]
    bad = [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] + [1.0] * 15), (405, [float("inf")] + [1.0] * 15)]
    short = [(500, [1.0, 0.0]), (501, [1.0, 0.01])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + bad + short], "vec_id long, embedding array<double>, label int, cls string")
    got = defaultdict(list)
    for r in embedding_groups(df).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    ids = [i for i, _ in rows]
    comp = brute_components(set(ids), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    for at, i in enumerate(ids):
        assert set(got[i]) == {(int(near[at].sum()) - 1, comp[i], comp[i] == i)}
    assert len(got[300]) == 2
    for i, _ in bad:
        assert got[i] == [(0, i, True)]
    assert got[500] == [(1, 500, True)] and got[501] == [(1, 500, False)]
    assert embedding_groups(df.limit(0)).count() == 0


def test_hnsw_finds_neighbours():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, _ = hnsw.build(x)
    ids, sims = graph.search(graph.vectors[:200], 64)
    truth = np.argsort(-(graph.vectors[:200] @ graph.vectors.T), 1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(truth.tolist(), ids.tolist())]) > 0.9
    assert (np.diff(sims, axis=1) <= 1e-6).all()


@pytest.mark.parametrize("hot", [0, 250])
def test_embedding_audit_sees_lost_points(spark, hot):
    """A graph that cannot reach some linked points is not trusted, also beside a hot group that it finds."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500 + hot, 16))
    x[10:20] = x[:10] + rng.normal(size=(10, 16)) * 0.02  # 10 links among hundreds of vectors
    x[500:] = x[499] + rng.normal(size=(hot, 16)) * 0.02
    shard = embedding_dedup.build_shard(
        pa.table({"shard": np.zeros(len(x), np.int32), "cls": np.arange(len(x)), "vec": pa.array([v.tobytes() for v in x], pa.binary())})
    )
    state = pickle.loads(shard.column("graph")[0].as_py())
    lost = np.flatnonzero(np.isin(state["ids"], range(10, 20)) & (np.arange(len(x)) > 0))
    for layer in state["layers"]:
        layer[np.isin(layer, lost)] = -1
    classes = spark.createDataFrame([(i, v.tobytes(), 1, i) for i, v in enumerate(x)], "cls long, vec binary, n long, first_key long")
    graphs = spark.createDataFrame([(0, bytearray(pickle.dumps(state)))], "shard int, graph binary")
    beam, _ = embedding_dedup.audited_beam(classes, graphs, 0.95)
    graph, raw, units, ids = embedding_dedup.load(pickle.dumps(state))
    q, p = embedding_dedup.range_search(graph, raw, units, x[:20], beam, 0.95)
    assert {(a, b) for a, b in zip(q.tolist(), ids[p].tolist()) if a != b} >= {(a, a + 10) for a in range(10)}


# 2 archives


def test_warc_round_trip(spark):
    same = "<p>" + "é" * 800
    rows = [(1, "http://a/", same), (9, "http://b/\r\nX: y", same), (4, None, same), (4, "u", same), (None, "u", same)]
    rows += [(5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (20, "u", "x" * 3_000_000), (None, "u", "y" * 1500)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, name string").repartition(2)
    got = Counter(tuple(r) for r in warc.archive_round_trip(df).collect())
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        refers = 9 if html == same and page != 9 else None
        want[(page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers)] += 1
    assert got == want
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def archive(records, dictionary=b"", frame=None):
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return io.BytesIO((frame or warc.dictionary_frame(dictionary)) + b"".join(press.compress(r) for r in records))


def record(payload=b"<p>hello", kind="response"):
    return warc.record_bytes(
        {
            "payload": payload,
            "record_type": kind,
            "payload_digest": hashlib.sha1(payload).hexdigest(),
            "name": "n",
            "url": "http://x/",
            "page_id": 3,
            "refers_to": 4,
        }
    )


def test_warc_dictionary_and_faults():
    samples = [b"<html><body>%d some page text %d</body>" % (i, i * i) * 20 for i in range(200)]
    trained = zstandard.train_dictionary(4096, samples).as_bytes()
    raw = [record(s) for s in samples[:5]] + [record(kind="revisit")]
    pages = [warc.page_of(r) for r in warc.read_archive(archive(raw, trained), block=97)]
    assert [p["payload"] for p in pages] == samples[:5] + [None]
    assert pages[5]["refers_to"] == 4 and pages[5]["payload_bytes"] == 8
    packed = zstandard.ZstdCompressor().compress(trained)
    frame = warc.SKIPPABLE + len(packed).to_bytes(4, "little") + packed
    assert len(list(warc.read_archive(archive(raw, trained, frame)))) == 6
    whole = archive(raw).getvalue()
    faults = [
        archive(raw, frame=b"no frame at all"),
        io.BytesIO(whole[:-3]),
        io.BytesIO(whole[:10] + b"\xff" + whole[11:]),
        archive([raw[0] + b"x"]),
        archive([raw[0].replace(b"Content-Length: ", b"Content-Length: 1", 1)]),
        archive([raw[0].replace(b"some page", b"same page", 1)]),
        archive([raw[0].replace(b"WARC/1.1", b"WARC/9", 1)]),
        archive([b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"]),
    ]
    for fault in faults:
        with pytest.raises(warc.WarcError):
            [warc.page_of(r) for r in warc.read_archive(fault)]


# 3 shards


@pytest.mark.parametrize("shards,nodes", [(40, 64), (7, 5), (1, 1)])
def test_ring_shards(spark, shards, nodes):
    rows = ODD + [(i, f"text {i}") for i in range(100, 400)] + [(50, "same row")] * 150
    got = ring_shards(documents(spark, rows), shards, nodes).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((k, size(t), zlib.crc32((t or "").encode())) for k, t in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(shards)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def plain_ring(rows, shards, nodes):
    """Shard of each distinct row, by walking the ring: own keys first, then a queue of those that overflow."""

    def point(name):
        return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)

    ring = sorted((point(f"shard {s} node {n}"), s, n) for s in range(shards) for n in range(nodes))
    arcs = [[] for _ in ring]
    for row in rows:
        key, size, crc = row
        p = point(":".join(str(x) for x in (key, crc, size) if x is not None))
        at = next((i for i, (end, *_) in enumerate(ring) if p <= end), 0)
        arcs[at].append((p, key is not None, key or 0, size, crc, row))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    shard_of, over = {}, []
    left = list(room)
    for (_, s, _), own in zip(ring, arcs):
        own.sort()
        over.append([])
        for *_, row in own:
            if left[s]:
                left[s] -= 1
                shard_of[row] = s
            else:
                over[-1].append(row)
    free, turn = [], Counter()
    for _, s, _ in ring:
        free.append(left[s] * (turn[s] + 1) // nodes - left[s] * turn[s] // nodes)
        turn[s] += 1
    carried = list(itertools.accumulate(len(o) - f for o, f in zip(over, free)))
    start = carried.index(min(carried)) + 1
    queue = []
    for step in range(len(ring)):
        at = (start + step) % len(ring)
        queue += over[at]
        for _ in range(free[at]):
            shard_of[queue.pop(0)] = ring[at][1]
    assert not queue
    return shard_of


@pytest.mark.parametrize("shards, nodes, n", [(7, 5, 300), (40, 64, 900), (3, 1, 50)])
def test_ring_places_equal_a_walk(spark, shards, nodes, n):
    rows = [(i, f"text {i % 97}") for i in range(n)] + [(None, "no key"), (n, None)]
    got = {(r.doc_id, r["size"], r.text_crc32): r.shard for r in ring_shards(documents(spark, rows), shards, nodes).collect()}
    plain = [(k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows]
    assert got == plain_ring(plain, shards, nodes)


def test_ring_is_stable_and_moves_little(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(3000)])
    place = lambda n: {r.doc_id: r.shard for r in ring_shards(docs, n).collect()}
    first = place(20)
    assert first == place(20)
    # One more shard must take 1 in 21; equal counts make others move too.
    assert sum(first[k] != v for k, v in place(21).items()) < 4 / 21 * 3000
    assert ring_shards(docs.limit(0)).count() == 0


# 4 decontamination


def brute_contamination(docs, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            wins[tuple(w[i : i + size])].add(item)
    out = Counter()
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if (own := tuple(w[i : i + size])) in wins:
                    hit |= set(range(i, i + size))
                    ids |= {str(x) for x in wins[own] if x is not None}
        out[(key, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    return out


def test_contamination(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "日本"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 25)))) for i in range(12)]
    items += [(3, items[0][1]), (None, items[1][1]), (90, None), (91, ""), (92, "..."), (93, "same " * 14)]
    docs = list(ODD)
    for i in range(60):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if i % 2:
            source = rnd.choice(items)[1] or ""
            w[len(w) // 2 : len(w) // 2] = source.upper().replace("É", "é").split() if i % 4 == 1 else source.split()
        docs.append((i + 100, "; ".join(w)))
    docs += [(300, "same " * 40), (300, "same " * 40), (301, "same " * 9)]
    bench = spark.createDataFrame([(*i, "w") for i in items], "item_id long, text string, win string")
    got = decontaminate.contamination(documents(spark, docs), bench).drop("text_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_contamination(docs, items)
    clean = decontaminate.drop_contaminated(documents(spark, docs), bench)
    want = Counter(k for (k, *_, bad), n in brute_contamination(docs, items).items() for _ in range(n) if not bad)
    assert Counter(r.doc_id for r in clean.collect()) == want and clean.columns == documents(spark, docs).columns
    empty = decontaminate.contamination(documents(spark, docs), bench.limit(0)).collect()
    assert len(empty) == len(docs) and not any(r.contaminated for r in empty)
    assert decontaminate.contamination(documents(spark, docs).limit(0), bench).count() == 0


def test_contamination_of_long_repetitive_texts(spark):
    """Work grows with the text, not with its square: every word is a candidate."""
    items = [(1, "same " * 14), (2, "same other"), (3, "x y z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    spent = []
    for n in (5_000, 40_000):
        rows = [(1, "same " * n), (2, "same other " * n), (3, None)]
        start = time.time()
        got = decontaminate.contamination(documents(spark, rows), bench).collect()
        spent.append(time.time() - start)
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == {1: (n, n, 1), 2: (2 * n, 2 * n, 1), 3: (0, 0, 0)}
    assert spent[1] < 40


# 5 suffixes


def brute_repeats(texts, span=400):
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left))
    return out


def repeating_texts():
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh é\n") for _ in range(3000))
    texts = []
    for _ in range(40):
        t = "".join(rnd.choice("abcdefghij é") for _ in range(rnd.randint(0, 500)))
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, 2200)
            t += base[at : at + rnd.randint(350, 800)] + "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 60)))
        texts.append(t)
    texts += ["a" * 900, "ab" * 500, "", None, base, base[:399], base[:400], base[1:401], texts[3], texts[3], "\0" * 450 + "z", "\0" * 449]
    return texts


@pytest.mark.parametrize("law", [suffix_dedup.LONG, suffix_dedup.PASSAGE, suffix_dedup.Law(40, 20, 4)])
@pytest.mark.parametrize("kinds", [50_000, 1])
def test_suffix_dedup(spark, monkeypatch, kinds, law):
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    texts = repeating_texts()
    docs = documents(spark, [(None if i == 7 else i, t) for i, t in enumerate(texts)])
    got = Counter(tuple(r) for r in suffix_dedup.suffix_dedup(docs, law=law).collect())
    brute = brute_repeats([(t or "").encode() for t in texts], law.span)
    assert got == Counter((None if i == 7 else i, *b[:4]) for i, b in enumerate(brute))


def test_cut_repeats_keeps_rows_and_columns(spark):
    texts = repeating_texts()
    docs = documents(spark, list(enumerate(texts)))
    out = suffix_dedup.cut_repeats(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    brute = brute_repeats([(t or "").encode() for t in texts])
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        want = None if t is None else brute[i][4].decode(errors="ignore")
        assert got[i].text == want and got[i].n_chars == (None if want is None else len(want))
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_passages_of_over_fifty_words_are_cut(spark):
    rnd = random.Random(9)

    def prose(n):
        return " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 7))) for _ in range(n))

    passages = [prose(51) for _ in range(6)]
    rows = [(i, f"{prose(60)} {passages[i % 6]} {prose(60)}") for i in range(18)] + [(100 + i, prose(150)) for i in range(18)]
    got = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(documents(spark, rows), law=suffix_dedup.PASSAGE).collect()}
    assert all(passages[i % 6][5:-5] not in got[i] for i in range(18))
    assert all(got[k] == t for k, t in rows if k >= 100)


# 6 toxicity


def toxic_documents(n=900):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdeghiklmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        if i % 3 == 0:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["zwockel", "quaffjerk", "vyxxon"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    return docs, labels, words


def test_toxicity(spark):
    docs, labels, words = toxic_documents()
    marked = spark.createDataFrame([(*x, None) for x in labels], "doc_id long, toxic int, text string")
    more = [(9001, " ".join(words[:30]) + " zwockell qwaffjerk vyxxonn"), (9002, " ".join(words[30:70]))]
    rows = documents(spark, docs + ODD[:4] + [(None, None)] + more)
    got = toxicity.toxicity_scores(rows, marked).collect()
    assert len(got) == len(docs) + 7
    truth = dict(labels)
    for r in got:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id >= 10]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]) > 0.9
    by = {r.doc_id: r for r in got}
    assert by[9001].predicted == 1 and by[9002].predicted == 0
    none = toxicity.toxicity_scores(rows, marked.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.toxicity_scores(rows.limit(0), marked).count() == 0
    kept = toxicity.drop_toxic(rows, marked)
    assert kept.columns == rows.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert {(r["_score"], r["_n"]) for r in kept.collect()} == {(0.25, 6)}


def test_toxicity_scores_equal_a_plain_model(monkeypatch):
    """Scores by loops over words and n-grams; long texts are scored in parts without a difference."""
    rnd = random.Random(11)
    weights = np.random.default_rng(1).normal(0, 30, toxicity.BUCKETS).astype(np.float32)

    def plain(text):
        means = []
        for word in toxicity.words_of(text):
            marked, found = f"<{word}>", []
            for size in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
                for at in range(len(marked) - size + 1):
                    h = 0
                    for c in marked[at : at + size]:
                        h = (h * 0x110001 + ord(c)) % 2**64
                    found.append(weights[int(mix(np.array([(h + size) % 2**64], np.uint64))[0] % np.uint64(toxicity.BUCKETS))])
            means.append(sum(map(float, found)) / len(found))
        return 1 / (1 + np.exp(-np.clip(sum(means) / (len(means) + toxicity.CALM) - 1.5, -30, 30)))

    score = toxicity.Scorer(weights, -1.5)
    texts = [" ".join("".join(rnd.choice("abcé日X_9") for _ in range(rnd.randint(1, 9))) for _ in range(n)) for n in range(40)]
    whole = [score(t) for t in texts + [None, ""]]
    assert np.allclose(whole, [plain(t) for t in texts + [None, ""]], atol=1e-5)
    monkeypatch.setattr(toxicity, "PART_WORDS", 7)
    assert np.allclose(whole, [score(t) for t in texts + [None, ""]], atol=1e-6)


def test_toxicity_learns_rare_words():
    """Held-out recall on a small table: every telling word occurs in fewer than 30 texts, some misspelt."""
    rnd = random.Random(61)
    words = ["".join(rnd.choice("abcdeghiklmnoprstu") for _ in range(rnd.randint(3, 8))) for _ in range(60)]
    telling = ["zwockel", "quaffjerk", "vyxxon"]
    told = telling + ["zwockell", "qwaffjerk", "vyxxonn"]
    texts, truth = [], []
    for i in range(420):
        own = [rnd.choice(words) for _ in range(rnd.randint(5, 10))]
        if i % 5 == 0:
            own[rnd.randrange(len(own))] = rnd.choice(telling if i < 300 else told)
        texts.append(" ".join(own))
        truth.append(int(i % 5 == 0))
    assert all(0 < sum(w in t.split() for t in texts[:300]) < 30 for w in telling)
    weights, bias = toxicity.train(texts[:300], truth[:300])
    assert all(weights[toxicity.grams([w])[1]].all() for w in telling)
    score = toxicity.Scorer(weights, bias)
    found = np.array([score(t) >= 0.5 for t in texts[300:]])
    toxic = np.array(truth[300:], bool)
    assert found[toxic].mean() >= 0.75 and found[~toxic].mean() <= 0.1


def most_held(work):
    """What ``work`` returns and the bytes that it held at most, what it returns included."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def distinct_words(count):
    return [hashlib.sha256(str(i).encode()).hexdigest()[:8] for i in range(count)]


def test_toxicity_training_holds_ngrams_in_parts(monkeypatch):
    """The n-grams of the whole vocabulary, as 64-bit numbers and several times over, took 25 bytes and more each."""
    words = distinct_words(60_000)
    texts = [" ".join(words[i::30]) for i in range(30)]
    monkeypatch.setattr(toxicity, "PART_WORDS", 1_000)
    bags, most = most_held(lambda: toxicity.Bags(texts))
    spare = most_held(lambda: dict.fromkeys(distinct_words(60_000), 0))[1]
    assert most - spare < 14 * len(bags.grams)
    few = toxicity.Bags(texts[:3] + ["", "é 日"])
    monkeypatch.setattr(toxicity, "PART_WORDS", 10**9)
    whole = toxicity.Bags(texts[:3] + ["", "é 日"])
    known = np.arange(toxicity.BUCKETS) % 3 > 0
    for one in (few, whole):
        one.restrict(known)
    for name in ("rows", "ids", "weights", "sizes", "grams", "starts", "shares"):
        assert np.array_equal(getattr(few, name), getattr(whole, name))
    owner, buckets = toxicity.grams(list(dict.fromkeys(toxicity.words_of(" ".join(texts[:3] + ["é 日"])))))
    assert np.array_equal(few.sizes, np.bincount(owner[known[buckets]], minlength=len(few.sizes)))
    assert toxicity.Bags(["", None]).sizes.shape == (0,)


# 7 BPE


def byte_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(65_536, 512), (300, 20), (37, 5)])
def test_bpe_like_the_library(spark, chunk, overlap):
    rnd = random.Random(7)
    rows = ODD + [(100 + i, "".join(rnd.choice(" aabé ñ\n\tÈ1日'st.,") for _ in range(rnd.randint(0, 700)))) for i in range(40)]
    rows += [(200, " " * 900), (201, "z" * 900), (202, "<|endoftext|> it's\r\n\r\n  x"), (203, "1" * 70 + "a" * 70)]
    encode = byte_encoding().encode_ordinary
    want = Counter()
    for key, text in rows:
        ids = encode(text or "")
        digest = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (text or "").encode())]
        want[(key, len(ids), *digest)] += 1
    docs = documents(spark, rows)
    got = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert byte_bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_memo_is_small():
    """Bytes of a remembered piece, its key and its share of the table included; a text of ids, digits and bytes took 330."""
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(None, RANKS))
    words = distinct_words(20_000)

    def remember():
        for at in range(0, len(words), 100):
            encoder.encode(words[at : at + 100])

    _, most = most_held(remember)
    assert len(encoder.memo) == len(words) and most / len(words) < 160
    assert encoder.encode([]) == (0, b"", b"")


# 8 languages


def test_languages(spark):
    rnd = random.Random(8)
    parts = {"aa": "ka lo mi nu".split(), "bb": "sch ung ver eit".split(), "cc": "ção nha qu ão".split()}
    docs = [(i, "".join(rnd.choice(p) + rnd.choice(["", " "]) for _ in range(40)), lang) for i in range(300) for lang, p in [list(parts.items())[i % 3]]]
    more = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "cc"), (903, "ka lo", None), (903, "ka lo", None), (None, "sch ung", None)]
    df = spark.createDataFrame([(*d, "k", "p") for d in docs + more], "doc_id long, text string, lang string, key string, lang_pred string")
    got = languages(df).collect()
    assert len(got) == 306
    truth = {d[0]: d[2] for d in docs}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert r.lang_pred == "und"
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    unlearnt = languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlearnt} == {"und"}
    assert languages(df.limit(0)).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    """300 languages, a third of all rows under one key, a language of long texts only."""
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 900)
    rnd = random.Random(8)
    letters = [chr(0x400 + i) for i in range(300)]
    rows = [(k, f"{letters[k % 300]}{letters[(k * 7) % 300]} " * rnd.randint(2, 6), f"l{k % 300}") for k in range(1800)]
    rows += [(5, "hot row", "l0")] * 900 + [(2000 + k, "ω ψ " * 4000, "long") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sample = language_id.training_rows(docs, "doc_id", "text", "lang")
    seen = Counter(r.lang for r in sample)
    assert len(seen) == 301 and max(seen.values()) == 2 and len(sample) <= 900
    assert max(len(r.text) for r in sample) == language_id.TRAIN_CHARS
    assert sample == language_id.training_rows(docs.repartition(5), "doc_id", "text", "lang")
    got = {r.doc_id: r.lang_pred for r in languages(docs).collect()}
    assert all(got[2000 + k] == "long" for k in range(9))


def test_language_scores_in_batches_equal_a_plain_model():
    """Kernel values and the arg max of each text by itself, with sets of n-grams in place of matrices."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcd é"[: 3 + k % 4]) for _ in range(rnd.randint(1, 90))) for k in range(150)]
    model = language_id.fit(texts[:100], [f"l{k % 4}" for k in range(100)])
    for text, (lang, score) in zip(texts, model.predict(texts)):
        own = sorted(set(np.flatnonzero(language_id.presence([text])[0]).tolist()))
        kernel = [sum(mark[own]) / max(len(own), 1) ** 0.5 for mark in model.landmarks]
        values = model.offset + np.array(kernel) @ model.weights
        best = int(values.argmax())
        chance = np.exp(4 * (values - values.max()))
        assert abs(score - chance[best] / chance.sum()) < 1e-3
        assert lang == model.languages[best] or np.sort(values)[-1] - np.sort(values)[-2] < 1e-3


# 9 pages


PAGES = {
    "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div class='ad x'>Buy this thing now</div>"
    "<article><h1>Head &amp; line</h1><p><b>Long <i>body</i> text of the article goes here.<br>Next</p><p>Of.</p></article>"
    "<div id='comments'>I disagree with this article</div><footer>foot</footer>": "Head & line Long body text of the article goes here. Next Of.",
    "plain  text\n only": "plain text only",
    "<script>var a = '<p>x</p>';</script><style>p{}</style>": "",
    "<main><p>one<p>two</main><aside>side side side side</aside>": "one two",
    "<div><p>a&nbsp;&#x41;&lt;b&gt;</p><form><p>name</p></form></div>": "a A<b>",
    "<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>": "x y 1 2",
}


def article_text(page):
    """The text of a page's article element by patterns; these pages have no furniture inside it."""
    body = re.search(r"<article[^>]*>(.*?)</article>", page, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())


def test_pages_equal_their_article_and_ratios_decide_without_marks(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    want = [article_text(p) for p in pages]
    assert [main_text(p) for p in pages] == want
    # No element, class or id tells the article from menus and footers: only lines and their ratios do.
    bare = [re.sub(r"<(/?)(article|nav|footer|header|aside)\b[^>]*>", r"<\1div>", p) for p in pages]
    bare = [re.sub(r'<(\w+) (?:class|id)="[^"]*">', r"<\1>", p) for p in bare]
    got = [main_text(p) for p in bare]
    assert all(w in g for w, g in zip(want, got))
    assert np.mean([w == g for w, g in zip(want, got)]) > 0.75
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html_text, "smooth", lambda values, sigma=0: rng.random(len(values)))
    assert np.mean([w == main_text(p) for w, p in zip(want, bare)]) < 0.05


def test_html_text(spark):
    for html, text in PAGES.items():
        assert main_text(html) == text
    long = "<article>" + "<p>word " * 30_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", long), (3, "u", long)]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extract_text(df).collect()
    assert Counter((r.page_id, r.url, r.n_chars) for r in got) == Counter([(1, "u", 0), (2, None, 0), (None, "u", 1), (3, "u", 149_999), (3, "u", 149_999)])
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "body,words",
    [
        ("<p>{a}</p><p>{b}</p>", "a b"),
        ("<div>" + "<p>{a}</p>" * 5 + "</div><div><p>{a}</p></div>", "a a a a a a"),
        ("<div id=content><h1>Head</h1><p>{b}</p><div class=body><p>{a}</p><p>{a}</p></div></div>", "Head b a a"),
        ("<div><p>Short lead</p><ul><li>{a}</li><li>Two</li></ul></div>", "Short lead a Two"),
        ("<nav>Home</nav><div><h2>Head</h2><div><p>{a}</p></div></div><footer>End</footer>", "Head a"),
    ],
)
def test_html_text_without_article(body, words):
    texts = {"a": "Long words. " * 90, "b": "Other words. " * 8}
    want = " ".join(texts[w].strip() if w in texts else w for w in words.split())
    assert main_text(f"<html><body>{body.format(**texts)}</body></html>") == want


# 10 fingerprints


def test_simhash_groups(spark):
    rnd = random.Random(10)
    words = [f"w{i}" for i in range(200)]
    rows = list(ODD)
    for i in range(60):
        w = [rnd.choice(words) for _ in range(120)]
        rows.append((100 + 3 * i, " ".join(w)))
        for j in (1, 2):
            w[rnd.randrange(len(w))] = "other"
            rows.append((100 + 3 * i + j, " ".join(w)))
    docs = documents(spark, rows)
    got = simhash_groups(docs).collect()
    prints = [fingerprint((t or "").encode()) for _, t in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    comp = brute_components(range(len(rows)), near)
    least = defaultdict(list)
    for at, (key, _) in enumerate(rows):
        if key is not None:
            least[comp[at]].append(key)
    want = Counter((k, f"{prints[at]:016x}", min(least[comp[at]], default=None)) for at, (k, _) in enumerate(rows))
    assert Counter(tuple(r) for r in got) == want and any(n > 1 for n in Counter(comp.values()).values())
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {(r["_row_stamp"], r["_k"], r["_S"], r["_n"]) for r in kept.collect()} == {("own", 4, 5, 6)}
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter(min(least[c], default=None) for c in set(comp.values()))
    assert simhash_groups(docs.limit(0)).count() == 0 and drop_near_copies(docs.limit(0)).count() == 0


def test_simhash_fingerprint_by_definition():
    import xxhash

    for text in ("a b c d e f", "One", "Two words", "É é x x x x"):
        w = text.encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert fingerprint(None) == fingerprint(b" \t") == 0


def test_vantage_trees_lose_no_pair(spark):
    rng = np.random.default_rng(11)
    points = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    flips = [p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))) for p in points[:500]]
    points = np.unique(np.concatenate([points, np.array(flips, np.uint64), np.uint64(7) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    pairs = list(zip(*np.nonzero(np.triu(near, 1))))
    want = brute_components(range(len(points)), pairs)
    labels = shard_forest(points, np.ones(len(points), bool), 3)
    assert labels.tolist() == [want[i] for i in range(len(points))]
    depth = 4
    vantages, radii = plant(points[::5], depth)
    leaf, row, home = route(points, vantages, radii, depth, 3)
    assert home.sum() == len(points) and len(set(leaf.tolist())) > 8
    meets = defaultdict(set)
    for where, r, h in zip(leaf.tolist(), row.tolist(), home.tolist()):
        meets[where].add((r, h))
    met = {frozenset((a, b)) for own in meets.values() for (a, ha), (b, hb) in itertools.combinations(own, 2) if ha or hb}
    assert all(frozenset(p) in met for p in pairs)
    frame = spark.createDataFrame([(i, int(np.int64(p.view(np.int64)))) for i, p in enumerate(points)], "key long, fp long")
    got = {r.first_key: r.component for r in fingerprint_classes(Scratch(spark, "t"), frame).collect()}
    assert got == want


def test_cut_text_by_arrays_of_starts():
    rng = np.random.default_rng(3)
    for _ in range(50):
        raw, span = bytes(rng.integers(0, 256, 200, dtype=np.uint8)), 20
        first = rng.integers(0, 170, rng.integers(0, 5))
        last = first + rng.integers(0, 10, len(first))
        gone = {at for a, b in zip(first.tolist(), last.tolist()) for at in range(a, b + span)}
        runs = sum(at in gone and at - 1 not in gone for at in range(200))
        assert suffix_dedup.cut_text(raw, (first, last), span) == (bytes(x for at, x in enumerate(raw) if at not in gone), runs)


def test_texts_without_lone_starts_are_not_hashed_for_them(monkeypatch):
    """Most texts have none; over a third of both readings of the texts went into them all the same."""
    kernels, asked = [], []

    class Texts:
        def select(self, *names):
            return self

        def mapInArrow(self, run, kinds):
            kernels.append(run)
            raise StopIteration

    lone_windows = suffix_dedup._lone_windows
    monkeypatch.setattr(suffix_dedup, "_lone_windows", lambda lone, *rest: asked.append(len(lone)) or lone_windows(lone, *rest))
    with pytest.raises(StopIteration):
        suffix_dedup.repeated_hashes(Texts(), suffix_dedup.LONG)
    rng = np.random.default_rng(5)
    texts = pa.array(["".join(map(chr, rng.integers(97, 123, 1_500))) for _ in range(200)])
    rows = pa.Table.from_batches(kernels[0](iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    assert rows.num_rows > 200 * 20 and asked and min(asked) > 0
