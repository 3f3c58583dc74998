"""Target-distribution importance resampling: documents whose hashed n-grams look like a target corpus are drawn more often.

A feature's bucket is its CRC-32 modulo the number of buckets. CRC-32 is linear: what a byte contributes depends on itself and
on how many bytes follow it in the feature, and the contributions are joined by XOR; the length adds a constant. So the CRCs
of all features of a batch are one look-up per byte in a table by (distance from the end, byte) and one
`bitwise_xor.reduceat` over the features' spans. Spans longer than the table are cut into blocks of its size, counted from
their end, whose values are folded in pairs.

Documents get a weight from the two corpora's bucket counts and a Gumbel deviate from a hash of their id; the highest sums are
a draw without replacement by weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mailglass.llm.common import bounded, cut, slices
from mailglass.llm.fill_in_middle import arrow_bytes

#: Bytes from a feature's end that the table covers.
BLOCK = 256
#: Bytes of words: digits, small letters, all beyond ASCII.
IS_WORD = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Settings:
    """buckets; longest: words of a feature; least_words: of a document that may be drawn; percent: of those, how many are
    drawn; seed: of the draw."""

    buckets: int = 10_000
    longest: int = 1
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


# --- CRC-32 by position


@cache
def byte_table() -> np.ndarray:
    """The CRC register after one byte from an empty register."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


@cache
def position_table() -> np.ndarray:
    """[distance from the end, byte]: what a byte contributes."""
    one = byte_table()
    out = np.empty((BLOCK, 256), np.uint32)
    out[0] = one
    for d in range(1, BLOCK):
        out[d] = (out[d - 1] >> 8) ^ one[out[d - 1] & 0xFF]
    return out


@cache
def shift_table(level: int) -> np.ndarray:
    """[byte of the register, its value]: the register after BLOCK * 2^level zero bytes more."""
    values = np.arange(256, dtype=np.uint32)
    if level == 0:
        out = np.stack([values << np.uint32(8 * j) for j in range(4)])
        for _ in range(BLOCK):
            out = (out >> 8) ^ byte_table()[out & 0xFF]
        return out
    return shifted(shift_table(level - 1), level - 1)


def shifted(register: np.ndarray, level: int) -> np.ndarray:
    t = shift_table(level)
    return t[0][register & 0xFF] ^ t[1][register >> 8 & 0xFF] ^ t[2][register >> 16 & 0xFF] ^ t[3][register >> 24]


@cache
def length_constant(n: int) -> int:
    """The CRC of n zero bytes: what the length alone contributes."""
    return zlib.crc32(bytes(n))


def span_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of disjoint, ascending, non-empty spans of data (uint8)."""
    if not len(start):
        return np.zeros(0, np.uint32)
    # Pieces of at most BLOCK bytes; the first of a span takes what its length leaves over.
    n = -(-length // BLOCK)
    first = np.cumsum(n) - n
    size = np.full(int(n.sum()), BLOCK)
    size[first] = length - (n - 1) * BLOCK
    begin = np.repeat(start, n) + np.where(np.arange(len(size)) == np.repeat(first, n), 0, size[np.repeat(first, n)] + (np.arange(len(size)) - np.repeat(first, n) - 1) * BLOCK)
    at = np.cumsum(size) - size
    total = int(size.sum())
    place = np.arange(total) - np.repeat(at, size)
    crc = np.bitwise_xor.reduceat(position_table()[np.repeat(size, size) - 1 - place, data[np.repeat(begin, size) + place]], at)
    out = crc[first]
    for i in np.flatnonzero(n > 1):
        values, level = crc[first[i] : first[i] + n[i]], 0
        while len(values) > 1:
            if len(values) % 2:  # an empty register in front changes nothing
                values = np.concatenate([np.zeros(1, np.uint32), values])
            values = shifted(values[::2], level) ^ values[1::2]
            level += 1
        out[i] = values[0]
    sizes, which = np.unique(length, return_inverse=True)
    return out ^ np.array([length_constant(int(k)) for k in sizes], np.uint32)[which]


# --- features of texts


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in one buffer, lower-cased, a space behind each; their starts and lengths; words of each text."""
    raw, offsets = arrow_bytes(column)
    low, high = int(offsets[0]), int(offsets[-1])
    text = LOWER[np.frombuffer(raw, np.uint8)[low:high]]
    word = IS_WORD[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets - low] = True
    begins = word & (edge[:-1] | ~np.concatenate([[False], word[:-1]]))
    ends = word & (edge[1:] | ~np.concatenate([word[1:], [False]]))
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    length = stop - start
    words = np.diff(np.searchsorted(start, offsets - low))
    # Kept: the words' bytes, and for each word a place for the space behind it.
    to = np.cumsum(length + 1) - length - 1
    buffer = np.full(int((length + 1).sum()), 0x20, np.uint8)
    buffer[np.repeat(to, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)] = text[word]
    return buffer, to, length, words


def buckets_of(column: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features of the texts, the text of each, and the words of each text."""
    buffer, start, length, words = word_spans(column)
    owner = np.repeat(np.arange(len(words)), words)
    found, whose = [], []
    for n in range(1, s.longest + 1):
        for r in range(n):  # runs that begin at every n-th word do not overlap
            i = np.arange(r, len(start) - n + 1, n)
            i = i[owner[i] == owner[i + n - 1]]
            found.append(span_crcs(buffer, start[i], start[i + n - 1] + length[i + n - 1] - start[i]) % np.uint32(s.buckets))
            whose.append(owner[i])
    return np.concatenate(found).astype(np.int64), np.concatenate(whose), words


def bucket_counts(docs: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """bucket, n: features of all whole texts. A task adds up its own, so at most `buckets` rows leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for whole in batches:
            for b in slices(whole, 0):
                total += np.bincount(buckets_of(b.column(0), s)[0], minlength=s.buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    return bounded(docs.select(text_col)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_col: str, s: Settings) -> np.ndarray:
    """What a feature in each bucket gains: a number for each of the fixed number of buckets, so it may go to the driver."""
    a, b = bucket_counts(docs, text_col, s), bucket_counts(target, target_col, s).withColumnRenamed("n", "t")
    x = docs.sparkSession.range(s.buckets).withColumnRenamed("id", "bucket").join(a, "bucket", "left").join(b, "bucket", "left").fillna(0, ["n", "t"])
    d = lambda c: F.col(c).cast("double")
    every = Window.partitionBy()
    x = x.withColumns({"all_n": F.sum("n").over(every), "all_t": F.sum("t").over(every)})
    gain = F.floor(1000 * F.log((d("t") + 1) * (d("all_n") + s.buckets) / ((d("n") + 1) * (d("all_t") + s.buckets))))
    out = np.zeros(s.buckets, np.int64)
    for r in x.select("bucket", gain.alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def weights(docs: DataFrame, gain: np.ndarray, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """the id, n_words, n_features, weight: the floored mean gain of each document's features, 0 without any."""
    base = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                bucket, owner, words = buckets_of(b.column(1), s)
                n = np.bincount(owner, minlength=b.num_rows)
                total = np.zeros(b.num_rows, np.int64)
                np.add.at(total, owner, gain[bucket])
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (words, n, total // np.maximum(n, 1)))], names=[id_col, "n_words", "n_features", "weight"])

    return bounded(base).mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in (id_col, "n_words", "n_features", "weight")]))


# --- the draw


def deviate(seed: str, doc_id: Column) -> Column:
    """A Gumbel deviate in thousandths from a hash of the id; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, s: Settings, id_col: str = "doc_id") -> DataFrame:
    """scored (id, n_words, score) with rank: 1, 2, 3 ... over the drawn documents, else null.

    Scores are whole numbers, and the deviate spreads them: no score holds more than about 0.04 % of the rows, whatever the
    weights, and they lie within some 60,000 of each other, which the counts and the deviate's range fix. So ranks follow
    from the number of rows at each score, and only rows of one score are ordered by id in a task.
    """
    fit = scored.filter(F.col("n_words") >= s.least_words)
    levels = fit.groupBy("score").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.col("score").desc())
    levels = levels.withColumn("before", F.sum("n").over(down) - F.col("n")).withColumn("draw", F.expr(f"{s.percent} * sum(n) OVER () div 100"))
    levels = cut(levels.filter("before < draw").select("score", "before", "draw"), 1)
    x = scored.join(F.broadcast(levels), "score", "left").withColumn("_in", (F.col("n_words") >= s.least_words) & F.col("before").isNotNull())
    order = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "n_features", "n_words")
    place = F.row_number().over(order) + F.col("before")
    drawn = x.filter("_in").withColumn("rank", F.when(place <= F.col("draw"), place))
    rest = x.filter(~F.col("_in")).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("_in", "before", "draw")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """The id, n_words, n_features, weight, score and rank (null: not drawn) of every document.

    docs: an integer id and a text; other columns are not read. Null and empty texts have no features and weight 0. Ties go to
    the smaller id, null ids last; rows that share an id are ranked each by its own text. Words of any length are hashed
    whole. Empty tables count nothing: without documents the result is empty, without a target every gain is by rarity alone.
    Texts are read twice, once to count and once to weigh; only numbers are shuffled.
    """
    gain = gains(docs, target, text_col, target_col, settings)
    x = weights(docs, gain, settings, id_col, text_col)
    return ranked(cut(x.withColumn("score", F.col("weight") + deviate(settings.seed, F.col(id_col)))), settings, id_col)


def drawn(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """The rows of docs that are drawn, all their columns. Rows that share a drawn id are all kept."""
    ids = resample(docs, target, settings, id_col, text_col, target_col).filter("rank is not null").select(F.col(id_col).alias("_drawn")).distinct()
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("_drawn")), "left_semi")
