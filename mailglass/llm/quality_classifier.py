"""Quality classifier: supervised subword embeddings.

Every word is a bag of hashed features: itself, its character n-grams and whether it repeats the word before. Each feature
has a learned vector; a text is the mean of its features' vectors; a softmax over two classes reads that mean. Training is
plain stochastic gradient descent in numpy on a bounded sample of labelled texts; scoring is one pass that looks a word's
summed vector up in a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mailglass.llm.common import WordTable, append_columns, mix64, slices, word_hashes


@dataclass(frozen=True)
class Settings:
    """sample, sample_chars: most labelled texts to learn from, and most characters of them, drawn by hash of their id. buckets: feature vectors; the last two are for
    the end of a text and for a word that repeats the one before."""

    sample: int = 6000
    sample_chars: int = 16_000_000
    buckets: int = 1 << 17
    dim: int = 8
    least_n: int = 3
    most_n: int = 4
    epochs: int = 8
    rate: float = 0.5
    seed: int = 7


def ngram_features(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words in one array, and where each word begins: the word, then the n-grams of <word>."""
    text = "".join(f"<{w.decode()}>" for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.fromiter((len(w.decode()) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lens)
    owners, feats = [np.arange(len(words))], [word_hashes(words)[0]]
    for n in range(s.least_n, s.most_n + 1):
        k = len(points) - n + 1
        if k <= 0:
            continue
        inside = word[:k] == word[n - 1 :]
        h = np.full(k, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + points[j : j + k]
        owners.append(word[:k][inside])
        feats.append(mix64(h[inside]))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    f = (np.concatenate(feats)[order] % np.uint64(s.buckets - 2)).astype(np.int32)
    return f, np.searchsorted(owner[order], np.arange(len(words) + 1))


def repeats(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text, the words that equal the word before."""
    same = np.zeros(len(ids) + 1, np.int64)
    if len(ids) > 1:
        eq = ids[1:] == ids[:-1]
        eq[(starts[1:-1] - 1)[(starts[1:-1] > 0) & (starts[1:-1] < len(ids))]] = False
        same[2:] = np.cumsum(eq)
    return same[starts[1:]] - same[starts[:-1]]


def split_words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    split = [t.encode().split() for t in texts]
    return [w for ws in split for w in ws], np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)


def bags(texts: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct features and how often it has them."""
    words, starts = split_words(texts)
    table = WordTable(word_hashes)
    ids = table.ids(words)
    names = list(table.words)
    feats, at = ngram_features(names, s) if names else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    twice = repeats(ids, starts)
    out = []
    for i in range(len(texts)):
        u, c = np.unique(ids[starts[i] : starts[i + 1]], return_counts=True)
        f = np.concatenate([feats[at[k] : at[k + 1]] for k in u] + [np.array([s.buckets - 2, s.buckets - 1], np.int32)])
        w = np.concatenate([np.repeat(c, at[u + 1] - at[u]), [1, twice[i]]])
        f, inverse = np.unique(f, return_inverse=True)
        out.append((f, np.bincount(inverse, w).astype(np.float32)))
    return out


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    settings: Settings


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> Model:
    """Stochastic gradient descent, a text at a time, with a linearly falling rate and classes weighted to be even."""
    rng = np.random.default_rng(s.seed)
    vectors = ((rng.random((s.buckets, s.dim)) - 0.5) / s.dim).astype(np.float32)
    weights = np.zeros((s.dim, 2), np.float32)
    share = np.bincount([y for *_, y in samples], minlength=2) / max(1, len(samples))
    total, done = s.epochs * len(samples), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(samples)):
            f, c, y = samples[i]
            rate = s.rate * (1 - done / total)
            done += 1
            c = c / c.sum()
            mean = c @ vectors[f]
            z = mean @ weights
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= rate * min(4.0, 0.5 / share[y])
            step = weights @ p
            weights -= np.outer(mean, p)
            vectors[f] -= np.outer(c, step)
    return Model(vectors, weights, s)


BAG = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("feats", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def learn(docs: DataFrame, labels: DataFrame, s: Settings) -> Model:
    """The model of labelled texts. labels: doc_id, y (0 or 1); rows with a null, or whose document is missing, teach
    nothing. The order of training follows the ids' hashes, so reruns agree."""
    ids = labels.filter("doc_id is not null and y in (0, 1)").select("doc_id", "y").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(s.sample)
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most s.sample ids
    # A text brings at most some 16 bytes a character to the driver, so texts are taken until their characters are enough.
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "y").rowsBetween(Window.unboundedPreceding, -1)
    lens = picked.groupBy("doc_id", "y").agg(F.sum(F.length("text")).alias("n"))  # as many rows at most as ids
    some = lens.withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("n") < s.sample_chars).select("doc_id", "y")
    picked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                got = bags([t or "" for t in b.column(1).to_pylist()], s)
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array([f.tobytes() for f, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], names=BAG.names)

    rows = picked.select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int")).mapInArrow(run, BAG).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["feats"], r["counts"], r["y"]))
    return train([(np.frombuffer(r["feats"], np.int32), np.frombuffer(r["counts"], np.float32), r["y"]) for r in rows], s)


def probabilities(texts: list[str], model: Model, table: WordTable) -> np.ndarray:
    s = model.settings
    words, starts = split_words(texts)
    ids = table.ids(words)
    sums, n = np.zeros((len(texts), s.dim)), np.ones(len(texts))
    if len(ids):
        vec, count = (x[ids] for x in table.rows)
        # A cumulative sum would lose digits over a slice; reduceat adds each text by itself. Empty texts are left out.
        full = np.flatnonzero(np.diff(starts))
        sums[full] = np.add.reduceat(vec, starts[full], axis=0)
        n[full] += np.add.reduceat(count, starts[full])
    twice = repeats(ids, starts)
    sums += model.vectors[s.buckets - 2] + np.outer(twice, model.vectors[s.buckets - 1])
    z = (sums / (n + twice)[:, None]) @ model.weights
    return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700)))


_TABLES: dict[int, tuple[Model, WordTable]] = {}


def table_of(model: Model) -> WordTable:
    """A word's summed vector and its number of features, remembered."""

    def look(words: list[bytes]) -> tuple[np.ndarray, ...]:
        f, at = ngram_features(words, model.settings)
        return np.add.reduceat(model.vectors[f].astype(np.float64), at[:-1], axis=0), np.diff(at)

    return WordTable(look)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of class 1 of each whole text (null: empty); one pass, no shuffle. The model, of fixed
    size, is broadcast. Repeated rows get equal scores; a column called `name` gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> list[pa.Array]:
        m = shared.value
        if id(m) not in _TABLES:
            _TABLES.clear()
            _TABLES[id(m)] = (m, table_of(m))
        return [pa.array(probabilities(texts, *_TABLES[id(m)]))]

    return append_columns(docs, text_col, work, [T.StructField(name, T.DoubleType())])


def quality_scores(docs: DataFrame, labels: DataFrame, learns: Column, settings: Settings = Settings()) -> DataFrame:
    """docs with the score of a model that learned from the labels for which `learns` holds (over doc_id).

    Without usable labels every score is 0.5. Columns other than doc_id and text are never read for a score.
    """
    return score(docs, learn(docs, labels.filter(learns), settings))
