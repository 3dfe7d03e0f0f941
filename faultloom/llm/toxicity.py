"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, a text the mean of its words, and a softmax
over two classes reads it. Vectors and softmax are trained together on a bounded sample of labelled rows.
Every step up to the softmax is linear, so a trained n-gram counts by one number: that table, of fixed
size, is what scoring tasks receive. A misspelt word shares most n-grams with the word it stands for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import mix
from .shared import free_name

#: Hash buckets of n-grams, vector length, and n-gram lengths.
BUCKETS = 1 << 17
WIDTH = 4
SHORTEST, LONGEST = 3, 5
#: Bounds of the training sample: rows of each class, and characters of a text that may be chosen.
TRAIN_ROWS = 6_000
TRAIN_CHARS = 50_000
STEPS = 250
BATCH = 192
RATE = 0.05
DECAY = 0.1
#: Empty words that every text is taken to have besides its own, so that a few words alone decide little.
CALM = 8
#: Words whose n-grams are held at a time.
PART_WORDS = 20_000

TOKEN = re.compile(r"[^\W_]+")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(word, bucket)`` of every character n-gram of the words, each between word marks."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = "<" + "><".join(words) + ">"
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters up to the word's end
    owners, buckets = [], []
    key = np.zeros(len(codes), np.uint64)
    for size in range(1, LONGEST + 1):
        key = key[: len(codes) - size + 1] * np.uint64(0x110001) + codes[size - 1 :]
        if size >= SHORTEST:
            inside = np.flatnonzero(left[: len(key)] >= size)
            owners.append(owner[inside])
            buckets.append((mix(key[inside] + np.uint64(size)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Bags:
    """Texts as word counts over a shared vocabulary whose words are runs of n-gram buckets."""

    def __init__(self, texts) -> None:
        vocabulary: dict[str, int] = {}
        rows, ids, weights = [], [], []
        for at, text in enumerate(texts):
            words = words_of(text)
            own = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64)
            seen, count = np.unique(own, return_counts=True)
            rows.append(np.full(len(seen), at, np.int32))
            ids.append(seen.astype(np.int32))
            weights.append((count / (len(words) + CALM)).astype(np.float32))
        self.rows, self.ids, self.weights = map(np.concatenate, (rows, ids, weights))
        words = list(vocabulary)
        sizes, own = [], []
        for at in range(0, max(1, len(words)), PART_WORDS):
            part = words[at : at + PART_WORDS]
            owner, buckets = grams(part)
            sizes.append(np.bincount(owner, minlength=len(part)))
            own.append(buckets[np.argsort(owner, kind="stable")].astype(np.int32))
        self.sizes, self.grams = np.concatenate(sizes), np.concatenate(own)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.texts = len(rows)

    def held(self) -> np.ndarray:
        """Which buckets occur: each of them is trained, however rare, and weight decay holds noise down."""
        return np.bincount(self.grams, minlength=BUCKETS) > 0

    def restrict(self, known: np.ndarray) -> None:
        """Keep the known buckets only, renumbered; a word's mean still counts all its n-grams."""
        self.shares = 1.0 / np.maximum(self.sizes, 1)
        held = known[self.grams]
        self.grams = (np.cumsum(known) - 1).astype(np.int32)[self.grams[held]]
        before = np.zeros(len(held) + 1, np.int32)
        np.cumsum(held, out=before[1:])
        self.sizes = np.diff(before[self.starts]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def select(self, chosen: np.ndarray):
        """``(row, word, weight)`` of the chosen texts, rows renumbered and words local, and their n-grams."""
        place = np.full(self.texts, -1)
        place[chosen] = np.arange(len(chosen))
        held = place[self.rows] >= 0
        words, local = np.unique(self.ids[held], return_inverse=True)
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[words] - (ends - sizes), sizes)
        return place[self.rows[held]], local, self.weights[held], self.grams[flat].astype(np.int64), sizes, self.shares[words]


def train(texts, labels, seed: int = 7) -> tuple[np.ndarray, float]:
    """One number per bucket and a bias: the log-odds of label 1 are their average plus the bias."""
    labels = np.asarray(labels, np.int64)
    weights, bias = np.zeros(BUCKETS, np.float32), 0.0
    if not len(labels) or labels.min() == labels.max():
        share = 0.5 if len(labels) == 0 else float(labels[0])
        return weights, {0.0: -4.0, 0.5: -1.0, 1.0: 4.0}[share]
    rng = np.random.default_rng(seed)
    bags = Bags(texts)
    known = bags.held()
    bags.restrict(known)
    size = int(known.sum())
    vectors = rng.normal(0, 0.1, (size, WIDTH))
    soft = rng.normal(0, 0.1, (WIDTH, 2))
    offset = np.log(np.bincount(labels, minlength=2) / len(labels))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, soft, offset)]
    step, epochs = 0, -(-STEPS // -(-len(labels) // BATCH))
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            rows, words, share, flat, sizes, each = bags.select(chosen)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            means = np.stack([np.bincount(owner, vectors[flat, d], len(sizes)) for d in range(WIDTH)], 1)
            means *= each[:, None]
            hidden = np.stack(
                [np.bincount(rows, means[words, d] * share, len(chosen)) for d in range(WIDTH)], 1
            )
            logits = hidden @ soft * SCALE + offset
            logits -= logits.max(1, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(chosen)), labels[chosen]] -= 1
            error = chance / len(chosen)
            back = error @ soft.T * SCALE
            to_words = np.stack([np.bincount(words, back[rows, d] * share, len(sizes)) for d in range(WIDTH)], 1)
            to_grams = to_words * each[:, None]
            grad = np.stack([np.bincount(flat, to_grams[owner, d], size) for d in range(WIDTH)], 1)
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for p, g, (m, v) in zip((vectors, soft, offset), (grad, hidden.T @ error * SCALE, error.sum(0)), state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + EASE)
            vectors *= 1 - rate * DECAY
    read = (soft[:, 1] - soft[:, 0]) * SCALE
    weights[known] = vectors @ read
    return weights, float(offset[1] - offset[0])


#: The floor of a step's divisor.
EASE = 2e-4
#: The softmax reads averages times this: a few words among hundreds must be able to decide.
SCALE = 20.0


class Scorer:
    """Chance of label 1 for a text: the mean over its words (and CALM empty ones) of their n-grams' mean."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def __call__(self, text: str | None) -> float:
        words = words_of(text)
        total = 0.0
        for at in range(0, len(words), PART_WORDS):
            owner, buckets = grams(words[at : at + PART_WORDS])
            sums, counts = np.bincount(owner, self.weights[buckets]), np.bincount(owner)
            total += float((sums / counts).sum())
        mean = total / (len(words) + CALM)
        return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """``(at, key, text, label)`` of the bounded training sample, one row per key.

    Labelled rows whose crc32 of the key as text modulo 5 is not 0, in the order of a hash of the key, until
    TRAIN_ROWS are held; texts over TRAIN_CHARS are not chosen, rows without text or label neither. Of a key
    labelled twice the larger label counts, of a key with two texts the lesser text.
    """
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0
    marked = labels.where(F.col(label).isin(0, 1) & fold).groupBy(F.col(key).alias("_k"))
    marked = marked.agg(F.max(label).cast("int").alias("label"))
    usable = docs.where(F.col(text).isNotNull() & (F.length(text) <= TRAIN_CHARS) & fold)
    held = usable.select(F.col(key).alias("_k")).join(marked, "_k").distinct()
    chosen = held.orderBy(F.xxhash64("_k"), "_k").limit(TRAIN_ROWS)
    rows = docs.where(F.length(text) <= TRAIN_CHARS).select(F.col(key).alias("_k"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(chosen), "_k").groupBy("_k", "label").agg(F.min("text").alias("text"))
    return rows.select(F.xxhash64("_k").alias("at"), F.col("_k").alias("key"), "text", "label")


def toxicity_model(docs, labels, key="doc_id", text="text", label="toxic") -> tuple[np.ndarray, float]:
    """Weights and bias, learnt by one task from the bounded sample; constant where a label is missing."""

    def run(batches):
        texts, truth = [], []
        for batch in batches:
            texts += batch.column(2).to_pylist()
            truth += batch.column(3).to_pylist()
        weights, bias = train(texts, truth)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [bias]})

    rows = training_rows(docs, labels, key, text, label).repartition(1).sortWithinPartitions("at", "key")
    found = rows.mapInArrow(run, "weights binary, bias double").collect()
    if not found:  # no task runs over an empty sample
        return train([], [])
    return np.frombuffer(found[0].weights, np.float32), found[0].bias


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the chance of label 1 from the whole text; null and empty texts get the model's bias."""
    share = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = Scorer(*share.value)
        for part in parts:
            yield pd.Series([score(t) for t in part], dtype="float64")

    return docs.withColumn(name, run(F.col(text)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, score, predicted)`` per row of ``docs``.

    ``held_out`` rows (crc32 of the key as text, modulo 5, is 0) teach no label. Rows that repeat or have a
    null key are scored as any other (a null key is not held out). Without labels all scores are those of an
    uninformed model below one half. Other columns are ignored.
    """
    out = scored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), toxicity_model(docs, labels, key, text))
    held = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(
        F.col("key").alias(key), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model finds toxic (score of at least one half)."""
    name = free_name(docs, "_score")
    return scored(docs, toxicity_model(docs, labels, key, text), text, name).where(F.col(name) < 0.5).select(*docs.columns)
