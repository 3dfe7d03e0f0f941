"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from faultloom.llm.shared import Scratch
from faultloom.llm.spelling_variants import (
    GROUPS,
    SLICE_CHARS,
    near_pairs,
    one_edit,
    reachable,
    run_counts,
    spelling_variants,
    vector,
)
from tests.llm.test_llm import ODD, documents


def edits(word, alphabet):
    """All words one edit away."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def brute(rows, modulus=199, min_chars=6, min_count=5, ratio=5):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    alphabet = sorted({c for w in words for c in w})
    near = {w: sorted(edits(w, alphabet) & words.keys(), key=lambda o: (-words[o], o)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= ratio * words[w] else None for w in words}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def misspelt(seed=5):
    rnd = random.Random(seed)
    base = ["kathedrale", "Ñandúes", "ça-và", "window", "widnow", "straßen", "STRASSEN", "éléphant", "x", "lemonade"]
    rows = []
    for k in range(250):
        words = []
        for _ in range(40):
            w = rnd.choice(base[: 3 + k % 8])
            if rnd.random() < 0.2 and len(w) > 3:
                i = rnd.randrange(len(w))
                w = w[:i] + rnd.choice(["", "e", "a", w[i] * 2]) + w[i + 1 :]
            words.append(w)
        rows.append((k % 120, rnd.choice([" ", "\n", "×", "7", ", "]).join(words)))
    return rows


@pytest.mark.parametrize("shard_words, modulus", [(20_000, 199), (3, 7), (1, 2)])
def test_equals_brute_force(spark, shard_words, modulus):
    rows = misspelt() + ODD * 5 + [(9, "ladder " * 700 + "laddere " * 130 + "ladderen " * 21 + "laddre " * 30)]
    got = found(spelling_variants(documents(spark, rows), shard_words=shard_words, modulus=modulus))
    want = brute(rows, modulus)
    assert got == want
    assert modulus < 199 or any(form and form != root for _, form, root, *_ in want)


def test_one_edit_and_reachable_vectors():
    rnd = random.Random(1)
    for _ in range(300):
        a = "".join(rnd.choice("abcmnÀ") for _ in range(rnd.randint(1, 7)))
        b = "".join(rnd.choice("abcmnÀ") for _ in range(rnd.randint(1, 7)))
        assert one_edit(a, b) == (b in edits(a, "abcmnÀ")) == one_edit(b, a)
        for other in edits(a, "abmÀ"):
            one, two = tuple(vector(a)), tuple(vector(other))
            ways = [tuple(p) for p, *_ in reachable(min(one, two), 0, GROUPS, 0, 0)]
            assert ways.count(max(one, two)) == 1


def test_words_of_one_vector_are_cut_by_hash(spark):
    # Anagrams share all counts, so no cut by counts separates them.
    rnd = random.Random(2)
    words = sorted({"".join(rnd.sample("abcdefm", 7)) for _ in range(800)} | {"abcdefm", "mbcdefm"})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [(r.word, r.other) for r in near_pairs(Scratch(spark, "t"), df, shard_words=50).collect()]
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert {tuple(sorted(p)) for p in got} == want and len(got) == len(want)


def test_long_texts_and_empty_tables(spark):
    text = "window " * (SLICE_CHARS // 3) + "w" * 50
    total = Counter()
    for part in run_counts(text):
        total += part
    assert total == Counter(re.findall("[a-z]+", text))
    long_run = "ab" * SLICE_CHARS
    assert sum(run_counts(long_run + " end"), Counter()) == Counter({long_run: 1, "end": 1})
    rows = [(1, text), (2, long_run)]
    assert found(spelling_variants(documents(spark, rows))) == brute(rows)
    assert found(spelling_variants(documents(spark, ODD[:2]))) == set()
    assert found(spelling_variants(documents(spark, [(1, None)]).limit(0))) == set()
