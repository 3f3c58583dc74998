"""Document fingerprints: threshold-scaled sketches.

A document's sketch holds every 64-bit shingle hash below a fixed fraction of the hash space, however long the document is. So
the sketch of two documents together is the union of their sketches, and the share of one sketch that lies in another estimates
how much of the one document the other contains, also where one is a hundred times as long.

Shingles are five words, lower-cased in ASCII; a text of fewer words is one shingle. Before the retained hashes a fingerprint
carries one hash of the whole text: equal texts are told from texts too short to retain anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailglass.llm.common import bounded, slices
from mailglass.llm.jaccard_join import WORDS, shingle_sets

#: One in so many shingle hashes is retained.
SCALE = 8
#: Runs of ids per shuffle partition, so that partitions hold about equally many rows wherever their hashes fall.
RUNS = 8
LONGS = T.ArrayType(T.LongType())


def retained(texts: list[str], scale: int = SCALE, words: int = WORDS) -> list[np.ndarray]:
    """Each text's shingle hashes below 2^64 / scale, ascending."""
    below = np.uint64((1 << 64) // scale - 1)
    return [s[: np.searchsorted(s, below, side="right")] for s in shingle_sets(texts, words)]


def arrow_longs(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))


def sketch(docs: DataFrame, text_col: str = "text", name: str = "sketch", scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """docs with an array of the retained shingle hashes of each whole text, ascending, each once. No shuffle.

    Null and empty texts retain nothing. A column called `name` gives way.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    at, schema = base.columns.index(text_col), T.StructType([*base.schema.fields, T.StructField(name, LONGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                sets = retained([t or "" for t in b.column(at).to_pylist()], scale, words)
                yield pa.RecordBatch.from_arrays([*b.columns, arrow_longs(sets)], names=schema.names)

    return bounded(base).mapInArrow(run, schema)


def merged(sketches: DataFrame, keys: list[str], name: str = "sketch") -> DataFrame:
    """keys, hash: a row for each distinct hash that the rows of a key retain, which is the sketch of all their texts as one
    corpus. Hashes are shuffled, not gathered: a key's sketch may be larger than a task."""
    return sketches.select(*keys, F.explode(name).alias("hash")).distinct()


def containment(of: DataFrame, in_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, retained, shared, containment: how much of each sketch of `of` (keys, hash) lies in the single merged sketch
    `in_` (hash)."""
    met = of.join(in_.select("hash", F.lit(1).alias("_in")), "hash", "left")
    return met.groupBy(*keys).agg(F.count("*").alias("retained"), F.count("_in").alias("shared")).withColumn("containment", F.col("shared") / F.col("retained"))


def fingerprint(whole: Column, sketch_: Column) -> Column:
    """16 hexadecimal digits for the whole text, then 16 for each retained hash."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(digits(whole), F.array_join(F.transform(sketch_, digits), ""))


def overlap_share(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """How much of the smaller sketch lies in the larger, 0 to 1: 1 for equal texts, 0 if either of others retains nothing."""
    least = F.least(F.size(a), F.size(b))
    return F.when(whole_a == whole_b, F.lit(1.0)).when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def resemblance(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """The share of all hashes of two sketches that both hold; equal and empty ones as in overlap_share."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(whole_a == whole_b, F.lit(1.0)).when(either > 0, both / either).otherwise(F.lit(0.0))


# --- each document and the next one


def largest_of_runs(docs: DataFrame, id_col: str) -> np.ndarray:
    """The largest id of each of the runs that hold about equally many rows, ascending. Only ids are read; what comes to the
    driver is as long as the number of runs, which the shuffle partitions fix."""
    n = RUNS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null")
    parts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    bounds = np.unique(np.array(parts or [], np.int64))

    @F.pandas_udf("int")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(np.int64)), dtype="int32")

    return np.sort(np.array([r.m for r in ids.groupBy(run("id")).agg(F.max("id").alias("m")).collect()], np.int64))


def in_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """run, guest, id, h, text: the documents by runs of ids, the largest first; null ids are the last run. Each run ends with
    a guest, the first document of the run that follows (of the first run, after the last). Every text is shuffled once, a
    run's first one twice."""
    largest = largest_of_runs(docs, id_col)
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    null_first = x.filter("id is null").agg(F.min("h")).first()[0]
    n = len(largest) + (null_first is not None)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = np.searchsorted(largest, ids[known].to_numpy(np.int64))
        run = np.full(len(ids), n - 1)
        run[known] = len(largest) - 1 - at
        head = hashes.to_numpy() == (0 if null_first is None else null_first)
        head[known] = largest[at] == ids[known].to_numpy(np.int64)
        return pd.Series([[r, (r - 1) % n] if h else [r] for r, h in zip(run.tolist(), head.tolist(), strict=True)], dtype=object)

    return x.select(F.posexplode(places("id", "h")).alias("guest", "run"), "id", "h", "text")


def edited(text: str, other: str) -> str:
    """text, its last half (rounded down) replaced by the first as many code points of the other, or all it has."""
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


PAIR = "id long, n_chars long, edited_sha256 string, whole long, edited_whole long, next_whole long, sketch array<long>, edited_sketch array<long>, next_sketch array<long>"


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """PAIR: the sketch and whole-text hash of every document, of its edited text and of the next document by descending id
    (after the last: the first). A task holds a slice of texts, and the sketch of the text before it."""
    import xxhash

    rows = in_runs(docs, id_col, text_col)
    rows = rows.repartition("run").sortWithinPartitions("run", "guest", F.col("id").desc_nulls_last(), "h", "text").select("guest", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[tuple] = []  # the row whose next one has not come yet
        for whole in batches:
            for b in slices(whole, 2):
                texts = b.column(2).to_pylist()
                now = [*before, *zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, retained(texts, scale, words), strict=True)]
                pairs = [(x, y) for x, y in zip(now, now[1:], strict=False) if x[0] == 0]
                new = [edited(x[2], y[2]) for x, y in pairs]
                digest = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 63) ^ -(1 << 63)
                own, nxt = ([digest(p[i][2]) for p in pairs] for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[1] for x, _ in pairs], pa.int64()), pa.array([len(x[2]) for x, _ in pairs], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                        pa.array(own, pa.int64()), pa.array(list(map(digest, new)), pa.int64()), pa.array(nxt, pa.int64()),
                        arrow_longs([x[3] for x, _ in pairs]), arrow_longs(retained(new, scale, words)), arrow_longs([y[3] for _, y in pairs]),
                    ],
                    names=["id", "n_chars", "edited_sha256", "whole", "edited_whole", "next_whole", "sketch", "edited_sketch", "next_sketch"],
                )
                before = now[-1:]
        if before and before[0][0] == 0:
            raise RuntimeError("a run ended without its guest")

    return bounded(rows).mapInArrow(run, PAIR)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """A row per document: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, and how alike the document is to
    its edited text and to the next document: near_* is overlap_share, resembles_* the share of all hashes.

    docs: an integer id and a text; other columns are not read. Null and empty texts retain nothing and are alike only to
    one another. Rows with one id follow each other in the order of their text's hash; equal rows get results of equal
    documents that follow each other. Null ids come last. A single document follows itself. An empty table gives none.
    """
    x = with_next(docs, id_col, text_col, scale, words)
    to = {"edited": ("edited_sketch", "edited_whole"), "next": ("next_sketch", "next_whole")}
    alike = [f(F.col("sketch"), F.col(s), F.col("whole"), F.col(w)).alias(f"{name}_{k}") for name, f in (("near", overlap_share), ("resembles", resemblance)) for k, (s, w) in to.items()]
    marks = [fingerprint(F.col("whole"), F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_whole"), F.col("edited_sketch")).alias("edited_fingerprint")]
    return x.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", *marks, *alike)
