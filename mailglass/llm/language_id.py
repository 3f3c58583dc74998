"""Language ID: language-bitmask n-gram filters.

A Bloom filter whose slots hold a bit per language: an n-gram sets its language's bit in PROBES slots, and the bits common
to its slots say in which languages it may occur, all in one look-up. A text's n-grams vote; each language's count is
corrected for the false positives that its bits' density makes; the largest decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mailglass.llm.common import WordTable, append_columns, bounded, cut, mix64, slices, word_hashes

LEAST_N, MOST_N = 1, 4
PROBES = 3
#: Slots for each n-gram; the density of a language's bits follows.
SLOTS = 8
#: An n-gram belongs to a language whose texts have it at least so often, against the language that has it most.
RATIO = 0.2
#: Most pairs of n-gram and language in a filter (SLOTS * 8 bytes each). More make several filters, a pass for each.
MOST_GRAMS = 1 << 21
UNKNOWN = "und"


def letters(word: str) -> str:
    """The letters of a word in lower case, a blank for each run of others."""
    return " ".join("".join(c if c.isalpha() else " " for c in word.lower()).split())


class Letters(dict):
    """For str.translate: letters and line breaks stay, all else is a blank; each character is looked at once."""

    def __missing__(self, point: int) -> int:
        self[point] = kept = point if point == 10 or chr(point).isalpha() else 32
        return kept


_LETTERS = Letters()


def letters_of(words: list[bytes]) -> list[str]:
    """letters() of words without white space, all in one go: a line break between keeps them apart, also where lower case
    depends on a letter's neighbours."""
    lines = b"\n".join(words).decode().lower().translate(_LETTERS).split("\n") if words else []
    return [x if x.isalpha() else " ".join(x.split()) for x in lines]


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of the words' letters between blanks, as 64-bit keys, and the word of each, shorter n-grams first. Words without
    a letter have none."""
    shapes = letters_of(words)
    padded = [f" {x} " if x else "" for x in shapes]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(p) for p in padded])
    owners, keys = [], []
    for n in range(LEAST_N, MOST_N + 1):
        k = len(points) - n + 1
        if k <= 0:
            continue
        inside = word[:k] == word[n - 1 :]
        if n == 1:
            inside &= points != 32
        h = np.full(k, n, np.uint64)
        for j in range(n):
            h = (h << np.uint64(21)) ^ (h >> np.uint64(43)) ^ points[j : j + k]
        owners.append(word[:k][inside])
        keys.append(mix64(h[inside]))
    if not owners:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """grams_of(words) word by word, and where each word's begin."""
    keys, owner = grams_of(words)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """languages by code; slots: an array of masks, 64 languages a column; rates: chance that a strange n-gram has a
    language's bits; part, parts: the n-grams it answers for."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray
    part: int = 0
    parts: int = 1

    def mine(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(33)) % np.uint64(self.parts) == self.part

    def votes(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram and language, whether the filter has it."""
        mask = np.full((len(keys), self.slots.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(PROBES):
            mask &= self.slots[place(keys, i, len(self.slots))]
        lang = np.arange(len(self.languages))
        return (mask[:, lang // 64] >> (lang % 64).astype(np.uint64)) & np.uint64(1) == 1


def place(keys: np.ndarray, probe: int, n: int) -> np.ndarray:
    return (mix64(keys, probe + 20) % np.uint64(n)).astype(np.int64)


def build(languages: list[str], keys: np.ndarray, langs: np.ndarray, part: int = 0, parts: int = 1) -> Model:
    """keys[i] occurs in language langs[i]."""
    n = max(64, SLOTS * len(np.unique(keys)))
    slots = np.zeros((n, max(1, math.ceil(len(languages) / 64))), np.uint64)
    for i in range(PROBES):
        np.bitwise_or.at(slots, (place(keys, i, n), langs // 64), np.uint64(1) << (langs % 64).astype(np.uint64))
    lang = np.arange(len(languages))
    fill = [float(((slots[:, x // 64] >> np.uint64(x % 64)) & np.uint64(1)).mean()) for x in lang]
    return Model(languages, slots, np.array(fill) ** PROBES, part, parts)


COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: partial counts of every slice of texts, over all of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                by_lang: dict[str, list[bytes]] = {}
                for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).extend((t or "").encode().split())
                for lang, words in sorted(by_lang.items()):
                    table = WordTable(word_hashes, len(words) + 1)
                    ids = table.ids(words)
                    names = list(table.words)
                    if not names:
                        continue
                    keys, owner = grams_of(names)
                    times = np.bincount(ids, minlength=len(names))[owner]
                    each = pa.table({"gram": keys.view(np.int64), "n": times}).group_by("gram", use_threads=False).aggregate([("n", "sum")])
                    for part in each.to_batches():
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part.column("gram"), part.column("n_sum")], names=COUNTS.names)

    return bounded(docs).select("text", "lang").mapInArrow(run, COUNTS)


@dataclass(frozen=True)
class Learned:
    """grams: lang and gram of all n-grams that belong to a language, written; parts: how many filters hold them."""

    languages: list[str]
    grams: DataFrame
    parts: int

    def model(self, part: int) -> Model:
        """The filter of one part; its n-grams pass through the driver."""
        got = self.grams.filter(F.shiftrightunsigned("gram", 33) % self.parts == part).toArrow()
        number = {x: i for i, x in enumerate(self.languages)}
        langs = np.array([number[x] for x in got["lang"].to_pylist()], np.int64)
        return build(self.languages, got["gram"].to_numpy().astype(np.int64).view(np.uint64), langs, part, self.parts)


def learn(docs: DataFrame) -> Learned:
    """The n-grams of all texts of docs with a language; null languages teach nothing."""
    counts = cut(gram_counts(docs.filter("lang is not null")).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r["lang"] for r in totals.select("lang").collect())
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))  # a row per language
    rated = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram")))
    grams = cut(rated.filter(F.col("rate") >= RATIO * F.col("top")).select("lang", "gram"))
    return Learned(languages, grams, max(1, -(-grams.count() // MOST_GRAMS)))


_TABLES: dict[int, tuple[Model, WordTable]] = {}


def table_of(m: Model) -> WordTable:
    """The votes of each word's n-grams and how many they are, of those that m answers for."""

    def look(words: list[bytes]) -> tuple[np.ndarray, ...]:
        keys, at = word_grams(words)
        if m.parts > 1:
            mine = m.mine(keys)
            keys, at = keys[mine], np.concatenate([[0], np.cumsum(mine)])[at]
        total = np.concatenate([np.zeros((1, len(m.languages)), np.int32), np.cumsum(m.votes(keys), axis=0, dtype=np.int32)])
        return total[at[1:]] - total[at[:-1]], np.diff(at).astype(np.int32)

    return WordTable(look)


def tally(texts: list[str], model: Model, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Corrected votes of each text for each language, and its n-grams."""
    split = [t.encode().split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
    ids = table.ids([w for ws in split for w in ws])
    hits, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        votes, grams = (x[ids] for x in table.rows)
        hits[full] = np.add.reduceat(votes, starts[full], axis=0)
        n[full] = np.add.reduceat(grams, starts[full])
    return (hits - n[:, None] * model.rates) / (1 - np.minimum(model.rates, 0.999)), n


def predict(texts: list[str], model: Model, table: WordTable) -> tuple[list[str], list[float]]:
    right, n = tally(texts, model, table)
    right = np.maximum(0.0, right)
    langs, scores = [], []
    for i, t in enumerate(texts):
        if not n[i] or not model.languages:
            known = any(map(str.isalpha, t)) and model.languages
            langs.append(model.languages[0] if known else UNKNOWN)
            scores.append(0.0)
            continue
        best = int(np.argmax(right[i]))
        total = right[i].sum()
        langs.append(model.languages[best])
        scores.append(float(right[i][best] / total) if total else 0.0)
    return langs, scores


def used(m: Model) -> WordTable:
    """The table of m in this Python worker, which keeps one."""
    if id(m) not in _TABLES:
        _TABLES.clear()
        _TABLES[id(m)] = (m, table_of(m))
    return _TABLES[id(m)][1]


VERDICT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
TALLY = T.StructType([T.StructField("row", T.LongType()), T.StructField("part", T.LongType()), T.StructField("n", T.DoubleType()), T.StructField("votes", T.ArrayType(T.DoubleType()))])


def identify(docs: DataFrame, learned: Learned, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score for each whole text; one pass and no shuffle where one filter holds the n-grams.

    Null texts and texts without a letter are `und` with score 0. score: the language's share of all corrected votes, 0 to
    1. Ties go to the smaller code. Repeated rows get equal results; columns with these names give way.
    """
    if learned.parts > 1:
        return identify_by_parts(docs, learned, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(learned.model(0))

    def work(texts: list[str]) -> list[pa.Array]:
        langs, scores = predict(texts, shared.value, used(shared.value))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(docs, text_col, work, VERDICT)


def identify_by_parts(docs: DataFrame, learned: Learned, text_col: str) -> DataFrame:
    """identify() with a pass for each filter; a text's votes of all passes are added up in their order."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    # Rows are told apart by a written number, so that passes meet again.
    rows = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    done = None
    for part in range(learned.parts):
        shared = docs.sparkSession.sparkContext.broadcast(learned.model(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, part: int = part) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for whole in batches:
                for b in slices(whole, 1):
                    right, n = tally([t or "" for t in b.column(1).to_pylist()], m, used(m))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(n), pa.int64()), pa.array(n), pa.array(list(right), pa.list_(pa.float64()))], names=TALLY.names)

        x = cut(rows.select("row", F.col("doc")[text_col].alias("text")).mapInArrow(run, TALLY))
        shared.unpersist()
        done = x if done is None else done.unionByName(x)
    each = done.groupBy("row").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "votes"))).alias("all"))
    zero = F.array_repeat(F.lit(0.0), len(learned.languages))
    added = F.aggregate("all", zero, lambda a, x: F.zip_with(a, x["votes"], lambda p, q: p + q))
    each = each.select("row", "n", F.transform(added, lambda v: F.greatest(v, F.lit(0.0))).alias("votes"))
    total, best = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v), F.array_max("votes")
    named = F.element_at(F.array(*map(F.lit, learned.languages)), F.array_position("votes", best).cast("int"))
    verdict = each.select("row", F.when(F.col("n") > 0, named).otherwise(UNKNOWN).alias("lang_pred"), F.when((F.col("n") > 0) & (total > 0), best / total).otherwise(0.0).alias("score"))
    return rows.join(verdict, "row").select("doc.*", "lang_pred", "score")


def identify_held_out(docs: DataFrame, learns: Column) -> DataFrame:
    """docs with the predictions of a model that learned from the rows where `learns` holds (text and lang)."""
    return identify(docs, learn(docs.filter(learns)))
