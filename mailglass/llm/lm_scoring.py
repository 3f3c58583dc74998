"""LM scoring: a log-frequency Bloom filter of n-gram counts.

Counts of the corpus's words and word pairs are quantised: level q stands for counts from BASE^(q-1) up to BASE^q. A Bloom
filter holds each n-gram once for every level up to its own, so a count is read by probing level after level until a probe
fails. The filter goes to the workers; a pair's probability comes from its probed counts, smoothed towards the word's.

The filter is a segment per cell of the key space, each built by the task that merges the cell's counts. No more than
FILTER_BYTES of words' and of pairs' segments are broadcast at once. When the words' are more, passes over the texts note the
level of each token's word, a byte a token; when the pairs' are more, texts are scored in several passes, a token in the pass
that has its pair. So workers need bounded memory, and the passes grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailglass.llm.common import WordTable, bounded, cut, mix64, slices, word_hashes

BASE = 1.5
PROBES = 5
#: Weight of the words' probabilities in a pair's.
MU = 8.0
#: Most bytes of segments of a kind that are broadcast at once.
FILTER_BYTES = 160 << 20
#: Most distinct words whose exact counts are broadcast (12 bytes each); beyond, they are joined.
EXACT_WORDS = 8_000_000

#: Characters of training text for each cell.
CELL_CHARS = 4 << 20

#: Bytes of text, and words remembered, that a worker handles at once beside the broadcast filters.
SLICE_BYTES, TABLE_WORDS = 2 << 20, 120_000

_LOW48 = np.uint64((1 << 48) - 1)
#: Fingerprints that no word has: the end of a text (no word is empty), and what stands before its first word.
END, START = int(word_hashes([b""])[0][0]), int(word_hashes([b" "])[0][0])

LEVELS = np.ceil(BASE ** np.arange(0, 80))
LEVELS[0] = 1
LEVELS = np.unique(LEVELS)  # least count of each level; level 1 holds count 1
MEANS = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


def spots(keys: np.ndarray, level: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """PROBES bit positions of each key (its low 48 bits) at a level, in segments of `bits` bits."""
    a = mix64(keys & _LOW48, level)
    b = (a >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (mix64(a + b * np.uint64(i), 5) % bits).astype(np.int64)


def build_segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of one cell as bytes."""
    levels = level_of(counts)
    n = int(levels.sum())
    size = max(8, math.ceil(n * PROBES * 1.4427 / 8))
    bits = np.zeros(size * 8, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        k = keys[levels >= q]
        for at in spots(k, q, np.uint64(size * 8)):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


@dataclass
class Filter:
    """Segments one after the other; segment c begins at byte starts[c]. Cells are the keys' first `cell_bits` bits."""

    data: np.ndarray
    starts: np.ndarray
    cell_bits: int

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Probed counts."""
        return MEANS[self.levels(keys)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Probed levels, 0 for strange keys: level after level, with the keys that still answer."""
        out = np.zeros(len(keys), np.uint8)
        cells = (keys >> np.uint64(64 - self.cell_bits)).astype(np.int64)
        begin, size = self.starts[cells], ((self.starts[cells + 1] - self.starts[cells]) * 8).astype(np.uint64)
        live = np.flatnonzero(size > 0)
        for q in range(1, len(MEANS)):
            k, base, n = keys[live], begin[live], size[live]
            yes = np.ones(len(live), bool)
            for at in spots(k, q, n):
                yes &= (self.data[base + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
            live = live[yes]
            if not len(live):
                break
            out[live] = q
        return out


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + mix64(w, 1), 2)


_WORDS: WordTable | None = None


def tokens(texts: list[str], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into table of all texts' tokens, the end with -1 after each; and where each text begins."""
    split = [t.encode().lower().split() for t in texts]
    lens = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.concatenate([[0], np.cumsum(lens + 1)])
    out = np.full(int(starts[-1]), -1, np.int64)
    words = np.ones(len(out), bool)
    words[starts[1:] - 1] = False
    out[words] = table.ids([w for ws in split for w in ws])
    return out, starts


def fingerprints(ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token and of the token before it."""
    w = np.full(len(ids), END, np.uint64)
    w[ids >= 0] = hashes[ids[ids >= 0]]
    h = np.roll(w, 1)
    h[starts[:-1]] = START
    return w, h


COUNTS = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("kind", T.ByteType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
WORD, PAIR = 0, 1


def count_rows(docs: DataFrame, cell_bits: int) -> DataFrame:
    """Per slice of texts: counts by cell, packed. Words keep 8 bytes of key, pairs 6; counts take 4 bytes."""

    def pack(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype("<u4")
        cells = (keys >> np.uint64(64 - cell_bits)).astype(np.int64)
        at = np.searchsorted(cells, np.arange((1 << cell_bits) + 1))
        for c in np.flatnonzero(np.diff(at)).tolist():
            k = keys[at[c] : at[c + 1]].astype("<u8")
            raw = k.tobytes() if kind == WORD else k.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()
            # Most counts are 1, so the upper bytes, put first, all but vanish in compression.
            yield c, kind, raw, counts[at[c] : at[c + 1]].view(np.uint8).reshape(-1, 4).T[::-1].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _WORDS
        _WORDS = _WORDS or WordTable(word_hashes, TABLE_WORDS)
        for whole in batches:
            for b in slices(whole, 0, SLICE_BYTES):
                ids, starts = tokens([t or "" for t in b.column(0).to_pylist()], _WORDS)
                w, h = fingerprints(ids, starts, _WORDS.rows[0] if _WORDS.rows else np.zeros(0, np.uint64))
                rows = [*pack(WORD, *np.unique(w, return_counts=True)), *pack(PAIR, *np.unique(pair_keys(h, w), return_counts=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int8(), pa.binary(), pa.binary()), strict=True)], names=COUNTS.names)

    return bounded(docs).select("text").mapInArrow(run, COUNTS)


MERGED = T.StructType(
    [
        T.StructField("cell", T.IntegerType()),
        T.StructField("kind", T.ByteType()),
        T.StructField("items", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("keys", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("bits", T.BinaryType()),
    ]
)


def merge_cells(rows: DataFrame) -> DataFrame:
    """A row per cell and kind: its filter segment, and for words the exact counts too."""

    def unpack(kind: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(counts) // 4
        c = np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, n)[::-1].T).view("<u4").ravel()
        if kind == WORD:
            return np.frombuffer(keys, "<u8"), c
        k = np.zeros((n, 8), np.uint8)
        k[:, :6] = np.frombuffer(keys, np.uint8).reshape(6, n).T
        return k.view("<u8").ravel(), c

    def done(cell: int, kind: int, parts: list) -> pa.RecordBatch:
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        bits = build_segment(keys, counts)
        exact = (keys.tobytes(), counts.tobytes()) if kind == WORD else (None, None)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((cell, kind, len(keys), int(counts.sum()), *exact, bits.tobytes()), (pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=MERGED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for cell, kind, keys, counts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (cell, kind) != now:
                    if parts:
                        yield done(*now, parts)
                    now, parts = (cell, kind), []
                parts.append(unpack(kind, keys, counts))
        if parts:
            yield done(*now, parts)

    return rows.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(run, MERGED)


def read_filter(merged: DataFrame, kind: int, cells: range, cell_bits: int) -> Filter:
    """The segments of some cells, on the driver; the caller has checked their size."""
    rows = merged.filter((F.col("kind") == kind) & (F.col("cell") >= cells.start) & (F.col("cell") < cells.stop)).select("cell", "bits").toArrow()
    at = rows["cell"].to_numpy()
    sizes = np.zeros((1 << cell_bits) + 1, np.int64)
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows["bits"]]
    sizes[at + 1] = [len(p) for p in parts]
    starts = np.cumsum(sizes)
    data = np.zeros(int(starts[-1]), np.uint8)
    for c, p in zip(at.tolist(), parts, strict=True):
        data[starts[c] : starts[c + 1]] = p
    return Filter(data, starts, cell_bits)


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("row", T.LongType())])


LEVELLED = T.StructType([T.StructField("row", T.LongType()), T.StructField("levels", T.BinaryType())])


def word_levels(rows: DataFrame, words) -> DataFrame:
    """row, levels: of each token the level of its word in a broadcast part of the words' filter, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = words.value
        table = WordTable(lambda fresh: (by_word.levels(word_hashes(fresh)[0]),), TABLE_WORDS)
        end = by_word.levels(np.array([END], np.uint64))
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                ids, starts = tokens([t or "" for t in b.column(1).to_pylist()], table)
                levels = np.full(len(ids), end, np.uint8)
                levels[ids >= 0] = table.rows[0][ids[ids >= 0]] if table.rows else 0
                raw = levels.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array([raw[x:y] for x, y in zip(starts, starts[1:], strict=False)], pa.binary())], names=LEVELLED.names)

    return rows.select("doc_id", "text", "row").mapInArrow(run, LEVELLED)


def score_pass(docs: DataFrame, words, pairs, exact, cells: range, n: int, v: int) -> DataFrame:
    """Scores of the tokens whose pair lies in `cells`. words, pairs, exact: broadcasts (exact: None without exact counts;
    words: None where docs has `levels`, the words' levels of every pass)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_pair, known = words.value if words else None, pairs.value, exact.value if exact else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def count(h: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known[0], h), max(0, len(known[0]) - 1))
            return np.where(known[0][at] == h, known[1][at], 0) if len(known[0]) else np.zeros(len(h), np.int64)

        def look(fresh: list[bytes]) -> tuple[np.ndarray, ...]:
            h = word_hashes(fresh)[0]
            return h, count(h), by_word.counts(h) if by_word else np.zeros(len(h))

        table = WordTable(look, TABLE_WORDS)
        ends = np.array([END], np.uint64)
        end_count, end_probed = int(count(ends)[0]), float(by_word.counts(ends)[0]) if by_word else 0.0
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                ids, starts = tokens([t or "" for t in b.column(1).to_pylist()], table)
                rows = table.rows or (np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1))
                word, first = ids >= 0, starts[:-1]
                w, h = fingerprints(ids, starts, rows[0])
                c = np.full(len(ids), end_count)
                c[word] = rows[1][ids[word]]
                if by_word:
                    probed = np.full(len(ids), end_probed)
                    probed[word] = rows[2][ids[word]]
                else:
                    parts = b.column(3).to_pylist()  # of each text, its tokens' levels by pass
                    best = [np.max([np.frombuffer(x, np.uint8) for x in each], axis=0) for each in parts]
                    probed = MEANS[np.concatenate(best)]
                before = np.roll(probed, 1)
                before[first] = probed[starts[1:] - 1]  # texts begin as often as they end
                key = pair_keys(h, w)
                cell = (key >> np.uint64(64 - by_pair.cell_bits)).astype(np.int64)
                mine = (cell >= cells.start) & (cell < cells.stop)
                pair = np.zeros(len(ids))
                pair[mine] = np.minimum(by_pair.counts(key[mine]), before[mine])
                p = (pair + MU * (probed + 1) / (n + v + 1)) / (before + MU)
                score = np.where(mine, np.log10(np.minimum(p, 1.0)), 0.0)
                base = np.log10((c + 1) / (n + v + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.diff(starts)), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(score, first)), b.column(2)], names=SCORES.names
                )

    return docs.mapInArrow(run, SCORES)


#: A word with more than this share of all tokens is counted by broadcast: there are at most 1 / FREQUENT of them.
FREQUENT = 1e-4


def exact_base(docs: DataFrame, merged: DataFrame, n: int, v: int) -> DataFrame:
    """row, n_known, base_score by a join of token counts, for vocabularies too large to broadcast.

    Frequent words, the end of a text among them, are added up where the text is read; only the others are shuffled, so no
    word has more than a FREQUENT part of the rows.
    """
    part = T.StructType([T.StructField("row", T.LongType()), T.StructField("word", T.LongType()), T.StructField("times", T.LongType()), T.StructField("base", T.DoubleType())])

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, "<u8").astype(np.int64)), pa.array(np.frombuffer(c, "<i8"))], names=["word", "c"])

    counts = merged.filter(F.col("kind") == WORD).select("keys", "counts").mapInArrow(counts_of, "word long, c long")
    least = max(1, math.ceil(n * FREQUENT))
    top = counts.filter(F.col("c") >= least).toArrow()  # at most 1 / FREQUENT rows
    keys = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], top["c"].to_numpy()[order]))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        table = WordTable(word_hashes, TABLE_WORDS)
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                ids, starts = tokens([t or "" for t in b.column(1).to_pylist()], table)
                w, _ = fingerprints(ids, starts, table.rows[0] if table.rows else np.zeros(1, np.uint64))
                doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                at = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
                hit = known[at] == w if len(known) else np.zeros(len(w), bool)
                base = np.where(hit, np.log10((often[at] + 1) / (n + v + 1)), 0.0) if len(known) else np.zeros(len(w))
                own = b.column(2)
                sums = (np.add.reduceat(hit.astype(np.int64), starts[:-1]), np.add.reduceat(base, starts[:-1]))
                yield pa.RecordBatch.from_arrays([own, pa.nulls(len(own), pa.int64()), *map(pa.array, sums)], names=part.names)
                w, doc = w[~hit], doc[~hit]
                order = np.lexsort((w, doc))
                w, doc = w[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])])[: len(w)])
                times = np.diff(np.append(first, len(w)))
                yield pa.RecordBatch.from_arrays([own.take(pa.array(doc[first])), pa.array(w[first].astype(np.int64)), pa.array(times), pa.nulls(len(first), pa.float64())], names=part.names)

    x = cut(docs.select("doc_id", "text", "row").mapInArrow(words_of, part))
    c = F.coalesce("c", F.lit(0))
    rare = x.filter("word is not null").join(counts.filter(F.col("c") < least), "word", "left").select("row", F.when(c > 0, F.col("times")).otherwise(0).alias("times"), (F.col("times") * F.log10((c + 1) / F.lit(float(n + v + 1)))).alias("base"))
    both = x.filter("word is null").select("row", "times", "base").unionByName(rare)
    return both.groupBy("row").agg(F.sum("times").alias("n_known"), F.sum("base").alias("base_score"))


def lm_scores(docs: DataFrame, trains: Column, filter_bytes: int = FILTER_BYTES, exact_words: int = EXACT_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text; learned where `trains` holds.

    docs: doc_id, text (null: empty, which is one token, the end). base_score: log10 of add-one word probabilities from
    exact counts of 64-bit word fingerprints. score: log10 probability by the filter's model. An empty training part gives
    probability 1 to every token. Repeated rows get equal results.
    """
    spark = docs.sparkSession
    # Cells follow the training texts' length alone, so scores do not depend on how rows are dealt out.
    size = docs.filter(trains).agg(F.sum(F.length("text"))).first()[0] or 0
    cell_bits = min(20, max(8, (size // CELL_CHARS).bit_length()))
    merged = cut(merge_cells(count_rows(docs.filter(trains), cell_bits)))
    sizes = {r["kind"]: r for r in merged.groupBy("kind").agg(F.sum("items").alias("items"), F.sum("total").alias("total"), F.sum(F.length("bits")).alias("bytes")).collect()}
    n, v = (sizes[WORD]["total"], sizes[WORD]["items"]) if sizes else (0, 0)
    every = range(1 << cell_bits)

    def shares(kind: int) -> list[range]:
        k = max(1, -(-(sizes[kind]["bytes"] if sizes else 0) // filter_bytes))
        edges = [(1 << cell_bits) * i // k for i in range(k + 1)]
        return [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    of_words, of_pairs = shares(WORD), shares(PAIR)
    share = lambda kind, cells: spark.sparkContext.broadcast(read_filter(merged, kind, cells, cell_bits))
    exact = None
    if v <= exact_words:
        got = merged.filter(F.col("kind") == WORD).orderBy("cell").select("keys", "counts").toArrow()
        keys = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in got["keys"]] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<i8").astype(np.int32 if n < 2**31 else np.int64) for x in got["counts"]] or [np.zeros(0, np.int64)])
        exact = spark.sparkContext.broadcast((keys, counts))
        del got, keys, counts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("row"))
    words = share(WORD, every) if len(of_words) == 1 else None
    if words is not None and len(of_pairs) == 1 and exact is not None:
        pairs = share(PAIR, every)
        # Written at once, so that the executors need not keep the filters any longer.
        out = cut(score_pass(rows, words, pairs, exact, every, n, v))
        pairs.unpersist()
    else:
        # Rows are told apart by a written number, so that passes meet again.
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        x = rows
        if words is None:
            levels = []
            for cells in of_words:
                some = share(WORD, cells)
                levels.append(cut(word_levels(rows, some)))
                some.unpersist()
            x = cut(rows.join(reduce(DataFrame.unionByName, levels).groupBy("row").agg(F.collect_list("levels").alias("levels")), "row").select("doc_id", "text", "row", "levels"))
        done = []
        for cells in of_pairs:
            pairs = share(PAIR, cells)
            done.append(cut(score_pass(x, words, pairs, exact, cells, n, v)))
            pairs.unpersist()
        out = reduce(DataFrame.unionByName, done)
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("n_known").alias("n_known"), F.first("base_score").alias("base_score"), F.sum("score").alias("score"))
        if exact is None:
            out = out.drop("n_known", "base_score").join(exact_base(rows, merged, n, v), "row")
    for shared in (words, exact):
        if shared is not None:
            shared.unpersist()
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
