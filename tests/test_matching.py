"""Matching runs against the stdlib matcher, and their cost on texts with many changes."""

import random
import time
from difflib import SequenceMatcher

import pytest
from faultloom.operators.matching import SEARCHED, make_matcher, make_run_finder
from faultloom.operators.similarity import make_scorer


def stdlib_runs(a, b, heuristic):
    blocks = SequenceMatcher(None, a, b, autojunk=heuristic).get_matching_blocks()
    return [tuple(block) for block in blocks[:-1]]


def edited(rng, letters, size):
    a = [rng.choice(letters) for _ in range(rng.randint(0, size))]
    b = list(a) if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.randint(0, size))]
    for _ in range(rng.randint(0, 10)):
        at = rng.randint(0, len(b))
        if rng.random() < 0.4:
            b[at:at] = [rng.choice(letters) for _ in range(rng.randint(1, 5))]
        else:
            del b[at : at + rng.randint(1, 30)]
    return a, b


@pytest.mark.parametrize("searched", [SEARCHED, 200, 0])  # by substrings, by numbers of stretches, both
@pytest.mark.parametrize("heuristic", [True, False])
def test_runs_equal_the_stdlib(searched, heuristic):
    rng = random.Random(f"{searched}{heuristic}")
    find = make_run_finder(heuristic, searched)
    for case in range(400):
        letters = "abcdefghijklmnopqrstuvwxyzABC .,é日\x01\x02"[: rng.choice([1, 2, 3, 8, 36])]
        a, b = edited(rng, letters, rng.choice([3, 12, 60, 400, 900]))
        if case % 2:
            a, b = "".join(a), "".join(b)
        assert find(a, b) == stdlib_runs(a, b, heuristic)


def test_a_floor_ends_the_search_only_below_it():
    rng = random.Random(5)
    match = make_matcher(True)
    for _ in range(500):
        a, b = ("".join(x) for x in edited(rng, "abcdefgh", 300))
        floor = rng.random()
        common = sum(n for *_, n in stdlib_runs(a, b, True))
        found = match(a, b, floor)
        assert 2 * common <= floor * (len(a) + len(b)) if found is None else sum(n for *_, n in found) == common


def test_best_of_many_blocks_equals_the_stdlib():
    rng = random.Random(6)
    best = make_scorer()
    for _ in range(150):
        sides = ["".join(edited(rng, "abcdefgh ;", 250)[0]) for _ in range(rng.randint(0, 4))]
        blocks = ["".join(edited(rng, "abcdefgh ;", 250)[0]) for _ in range(rng.randint(0, 6))] + sides[:1] * rng.randint(0, 1)
        want = [max([0.0, *(SequenceMatcher(None, s, b).ratio() for b in blocks)]) for s in sides]
        assert best(sides, blocks) == want
    assert best(None, ["a"]) is None and best(["a", ""], []) == [0.0, 0.0] and best([""], ["", "x"]) == [1.0]


LINES = [f"line {i}" for i in range(20_000)]
MANY = {
    "one_change": (LINES, [x + "!" if i == 77 else x for i, x in enumerate(LINES)]),
    "every_other_changed": (LINES, [x if i % 2 else x + "!" for i, x in enumerate(LINES)]),
    "blank_between_changes": ([x if i % 2 else "" for i, x in enumerate(LINES)], [x + "!" if i % 2 else "" for i, x in enumerate(LINES)]),
    "turned_round": (LINES, LINES[::-1]),
    "one_line_repeated": (["x"] * 20_000, ["x"] * 19_990 + ["y"] * 10),
    "few_lines_shuffled": ([f"l{i * i % 97}" for i in range(20_000)], [f"l{i * i * i % 97}" for i in range(20_000)]),
    "characters": ("".join(LINES), "".join(x[:-1] + "_" + x[-1] for x in LINES)),
}


@pytest.mark.parametrize("name", MANY)
def test_many_changes_cost_no_more_than_one(name):
    start = time.time()
    make_run_finder(False)(*MANY[name])
    assert time.time() - start < 8
