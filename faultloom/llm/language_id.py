"""Language ID: a blended-spectrum kernel, Nyström landmarks and one-versus-rest kernel ridge regression.

A text is the set of its hashed character n-grams of lengths 1 to 3 (presence, not counts). The kernel of
two texts is the cosine of their sets. A bounded number of landmark texts spans the feature space (the
kernel against the landmarks, whitened by the landmarks' own kernel); ridge regression against a one-
versus-rest target per language gives a matrix of fixed size, which scoring tasks receive. Whole texts are
scored in batches: a presence matrix times the landmark matrix times the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import mix

#: Hash buckets, n-gram lengths, landmarks and ridge.
BUCKETS = 1 << 14
LENGTHS = (1, 2, 3)
LANDMARKS = 160
RIDGE = 1e-3
#: Bounds of the training sample: rows per language and in all, languages, characters of a text looked at.
ROWS_PER_LANGUAGE = 400
SAMPLE_ROWS = 6_000
LANGUAGES = 1_000
TRAIN_CHARS = 5_000
BATCH = 64
PIECE = 1 << 20


def presence(texts: list[str]) -> np.ndarray:
    """A row per text with 1 where an n-gram of that bucket occurs, lower-cased; long texts in pieces."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PIECE):
            part = text[at : at + PIECE + max(LENGTHS) - 1].lower()
            codes = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.uint64)
            for size in LENGTHS:
                count = len(codes) - size + 1
                if count <= 0:
                    continue
                key = np.full(count, size, np.uint64)
                for j in range(size):
                    key = key * np.uint64(0x110001) + codes[j : j + count]
                out[row, (mix(key) >> np.uint64(50)).astype(np.int64)] = 1
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


class Model:
    """Languages and the matrix from a text's unit presence to a value per language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, offset: np.ndarray) -> None:
        self.languages, self.landmarks, self.weights, self.offset = languages, landmarks, weights, offset

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        kernel = unit(presence(texts)) @ self.landmarks.T
        values = kernel @ self.weights + self.offset
        best = values.argmax(1)
        chance = np.exp(4 * (values - values.max(1, keepdims=True)))
        chance /= chance.sum(1, keepdims=True)
        return [(self.languages[b], float(c[b])) for b, c in zip(best, chance)]


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """Nyström features and ridge regression; None without any training text."""
    languages = sorted(set(langs))
    if not languages:
        return None
    own = np.array([languages.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    turn = np.concatenate([rng.permutation(np.flatnonzero(own == k))[: max(2, LANDMARKS // len(languages))] for k in range(len(languages))])
    marks = unit(presence([texts[i] for i in turn]))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    white = vectors[:, keep] / np.sqrt(values[keep])
    # Batch by batch: the presence rows of the whole sample would be far larger than its features.
    kernel = [unit(presence(texts[i : i + BATCH])) @ marks.T for i in range(0, len(texts), BATCH)]
    features = np.concatenate(kernel) @ white
    target = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
    mean, level = features.mean(0), target.mean(0)
    centred = features - mean
    gram = centred.T @ centred + RIDGE * len(texts) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, centred.T @ (target - level))
    return Model(languages, marks, (white @ solved).astype(np.float32), (level - mean @ solved).astype(np.float32))


def training_rows(docs: DataFrame, key: str, text: str, lang: str) -> list:
    """The bounded sample: rows with a language whose crc32 of the key as text modulo 3 is not 1.

    Per language those of least hash of key and text, equal rows once: ROWS_PER_LANGUAGE, or fewer where there
    are so many languages that SAMPLE_ROWS would be exceeded, one at least. Of a chosen text the first
    TRAIN_CHARS characters are learnt from; texts without a letter are not chosen. Of more than LANGUAGES
    languages the most frequent are learnt. What is ranked are hashes, of which each task passes on only the
    least; the texts are fetched for the chosen ones.
    """
    fold = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1, F.lit(True))
    usable = docs.where(F.col(lang).isNotNull() & fold & F.col(text).rlike(r"\p{L}"))
    rows = usable.select(
        F.col(lang).alias("lang"), F.xxhash64(key, text).alias("at"), F.xxhash64(F.lit(1), key, text).alias("also"),
        F.substring(text, 1, TRAIN_CHARS).alias("text"),
    )
    hashes = rows.select("lang", "at", "also")
    counts = hashes.groupBy("lang").agg(F.count("*").alias("n"))
    known = [r.lang for r in counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    most = max(1, min(ROWS_PER_LANGUAGE, SAMPLE_ROWS // max(len(known), 1)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "also"))
    least = hashes.where(F.col("lang").isin(known)).distinct().withColumn("place", place).where(F.col("place") <= most)
    chosen = F.broadcast(least.drop("place"))  # at most SAMPLE_ROWS or LANGUAGES rows of hashes
    held = rows.join(chosen, ["lang", "at", "also"]).groupBy("lang", "at", "also").agg(F.min("text").alias("text"))
    return sorted(held.collect(), key=lambda r: (r.lang, r.at, r.also))


def language_model(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    rows = training_rows(docs, key, text, lang)
    return fit([r.text for r in rows], [r.lang for r in rows])


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(key, held_out, lang_pred, score)`` per row of ``docs``.

    ``held_out`` rows (crc32 of the key as text, modulo 3, is 1) teach nothing. Null texts and texts without
    a letter are ``und`` with score 0, as are all where nothing can be learnt. A null key is not held out.
    Repeated rows are rows of their own, an empty table gives none, other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(language_model(docs, key, text, lang))  # of fixed size
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            guess = [("und", 0.0)] * len(texts)
            if model.value is not None:
                some = [i for i, t in enumerate(texts) if t and letter.search(t)]
                for at in range(0, len(some), BATCH):
                    own = some[at : at + BATCH]
                    for i, found in zip(own, model.value.predict([texts[i] for i in own])):
                        guess[i] = found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in guess], pa.string()), pa.array([g[1] for g in guess], pa.float64())],
                ["key", "lang_pred", "score"],
            )

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = out.mapInArrow(run, f"key {kind}, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select(F.col("key").alias(key), held.alias("held_out"), "lang_pred", "score")
