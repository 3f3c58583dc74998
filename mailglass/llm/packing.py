"""Packing: harmonic bins.

Texts become token ids and are cut into sequences of CAPACITY tokens. A length l belongs to the reciprocal-capacity class
k = CAPACITY // l: exactly k such pieces fill a bin, so each class fills its bins by counting alone, and every worker can
do so for its share of the class once it knows how many pieces of the class the shares before it hold. A length that would
leave more than WASTE of the bin is cut once, at CAPACITY // (k + 1), and the rest is classed again. What is left over in a
class (fewer than k pieces, so a number that depends on CAPACITY and not on the data) goes, the longest first,
into the first bin with room.
"""

from __future__ import annotations

import math
import os
import re
import string
import zlib
from collections.abc import Iterator
from itertools import batched, chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mailglass.llm.common import bounded, cut, held, mix64, slices, tidy

CAPACITY = 2048
WASTE = 0.02
END_ID = 1
#: Bytes of text that a worker handles at once, words that it remembers, and the longest of these: below so many bytes, at most so many ids.
SLICE_BYTES, TABLE_WORDS, KEY_BYTES, KEY_IDS = 1 << 18, 100_000, 24, 12
#: Factors of a key's eight-byte parts in its hash.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Words that the merge model gets at once.
RUN_WORDS = 200
#: Letters below U+0180 in UTF-8, but for a few that normalisation changes.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\x88\x8a-\xbf])+")
#: Kinds of bytes. A MARK behind a LETTER begins a word of its own: letters and other marks never share a token, so a space
#: between them changes no id. A bar is no MARK, as special tokens have one behind a letter.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KIND = np.array([_SPACE if c in b" \t\n\v\f\r" else _LETTER if bytes([c]).isalpha() else _MARK if chr(c) in string.punctuation.replace("|", "") else _OTHER for c in range(256)], np.uint8)


def cut_length(n: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces of a text of n tokens: whole bins first, then pieces of falling size."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k * rest >= (1 - waste) * capacity or capacity // (k + 1) == 0 or rest <= math.isqrt(capacity):
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= capacity // (k + 1)
    return out


class WordIds:
    """Token ids of white-space separated words; a text's ids are those of its words in turn.

    That holds for tokenizers whose pre-tokenizer drops white space. Plain words (letters below U+0180) go straight to
    the merge model, after lower-casing, when the tokenizer is byte-level and lower-casing; all others through the whole
    tokenizer. Of the words seen, TABLE_WORDS are remembered in arrays, where a slice's words are met all at once: each has
    one place, by its hash, and leaves it only to a word that comes when it was not met since the last one that came.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side as it is
        self.tok = Tokenizer.from_file(path)
        names = "".join(map(str, (self.tok.normalizer, self.tok.pre_tokenizer)))
        # The bare merge model tells its words' ends by the last id.
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[n for t, n in vocab.items() if t.endswith("</w>")]] = True
        self.direct = "Lowercase" in names and "ByteLevel" in names and getattr(self.tok.model, "end_of_word_suffix", None) == "</w>"
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        # The model's character for each byte, but for the space.
        self.chars = np.arange(256, dtype="<u2")
        self.chars[[b for b in range(256) if b not in shown]] = 256 + np.arange(256 - len(shown))
        self.chars[32] = 32
        # For each place its word's bytes and their number, its ids and theirs, and whether it was met since the last newcomer.
        self.keys = np.zeros((TABLE_WORDS, KEY_BYTES // 8), np.uint64)
        self.ids, self.counts = np.zeros((TABLE_WORDS, KEY_IDS), np.uint16), np.zeros(TABLE_WORDS, np.int8)
        self.met = np.zeros(TABLE_WORDS, bool)

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in one array, where each begins in it and how many it has."""
        plain = np.fromiter((self.direct and (w.isalpha() or _LATIN.fullmatch(w) is not None) for w in words), bool, len(words))
        runs = [b" ".join(x).decode().lower().encode() for x in batched(compress(words, plain), RUN_WORDS)]
        runs = [self.chars[np.frombuffer(r, np.uint8)].tobytes().decode("utf-16-le") for r in runs]
        others = [w.decode() for w in compress(words, ~plain)]
        of_runs, of_others = self.bare.encode_batch_fast(runs, add_special_tokens=False), self.tok.encode_batch_fast(others, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in chain(of_runs, of_others)), np.uint16)
        lens = np.empty(len(words), np.int64)
        lens[~plain] = [len(e) for e in of_others]
        lens[plain] = np.diff(np.flatnonzero(self.last[ids[: len(ids) - lens[~plain].sum()]]), prepend=-1)
        order = np.argsort(~plain, kind="stable")
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(lens[order]) - lens[order]
        return ids, begin, lens

    def words(self, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a text that begins and ends with a space start and stop."""
        kind = _KIND[np.frombuffer(blob, np.uint8)]
        inside = kind != _SPACE
        first = ~inside[:-1]
        if self.direct:
            first |= (kind[:-1] == _LETTER) & (kind[1:] == _MARK)
        first &= inside[1:]
        return np.flatnonzero(first) + 1, np.flatnonzero(inside[:-1] & (first | ~inside[1:])) + 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins in it."""
        raw = [t.encode() for t in texts]
        if self.direct:
            raw = [b if b"<|" in b else b.lower() for b in raw]
        blob = b" ".join([b"", *raw, b" " * KEY_BYTES])
        start, stop = self.words(blob)
        size = stop - start
        chars = sliding_window_view(np.frombuffer(blob, np.uint8), KEY_BYTES)[start]
        chars *= np.arange(KEY_BYTES) < size[:, None]
        chars[:, -1] = np.minimum(size, KEY_BYTES)
        keys = chars.view(np.uint64)
        place = (mix64(keys @ _ODD) % np.uint64(TABLE_WORDS)).astype(np.int64)
        known = (self.keys[place] == keys).all(axis=1)
        self.met[place[known]] = True

        # Words that are not remembered, each once.
        new = np.flatnonzero(~known)
        numbers: dict[bytes, int] = {}
        nth = np.fromiter((numbers.setdefault(blob[i:j], len(numbers)) for i, j in zip(start[new].tolist(), stop[new].tolist(), strict=True)), np.int64, len(new))
        ids, begin, lens = self.look(list(numbers))

        count, at = self.counts[place].astype(np.int64), place * KEY_IDS
        count[new], at[new] = lens[nth], self.ids.size + begin[nth]
        ends = np.cumsum(count)
        flat = np.concatenate([self.ids.ravel(), ids])[np.repeat(at - (ends - count), count) + np.arange(count.sum())]
        bounds = np.searchsorted(start, np.cumsum([1, *(len(b) + 1 for b in raw)]))

        one = np.empty(len(numbers), np.int64)
        one[nth] = new
        self.remember(*(x[(size[one] < KEY_BYTES) & (lens <= KEY_IDS)] for x in (place[one], keys[one], begin, lens)), ids)
        return flat, np.append(0, ends)[bounds]

    def remember(self, place: np.ndarray, keys: np.ndarray, begin: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        """Words take their places, but where another was met since the last newcomer."""
        free = ~self.met[place]
        self.met[place] = False
        _, one = np.unique(place[free], return_index=True)
        at, begin = place[free][one], begin[free][one]
        self.keys[at], self.counts[at] = keys[free][one], lens[free][one]
        self.ids[at] = ids[np.minimum(begin[:, None] + np.arange(KEY_IDS), len(ids) - 1)]


PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("share", T.LongType()),
        T.StructField("piece", T.LongType()),
    ]
)
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, waste: float = WASTE, keep_ids: bool = False) -> DataFrame:
    """The pieces of each text (ids, then END_ID), one pass; `share` says which worker's share of a class a piece is in,
    `piece` is its own number, from the task's and a count."""
    schema = T.StructType([*PIECE.fields, *([IDS] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(("ids", tokenizer), lambda: WordIds(tokenizer))
        number = TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                texts = [t or "" for t in b.column(1).to_pylist()]
                flat, at = words.encode(texts)
                # One run of ids with an end after each text, then the pieces' places in it.
                lens = np.diff(at) + 1
                ends = np.cumsum(lens)
                ids = np.full(int(ends[-1]), END_ID, "<u4")
                own = np.ones(len(ids), bool)
                own[ends - 1] = False
                ids[own] = flat
                cuts = [cut_length(n, capacity, waste) for n in lens.tolist()]
                doc = np.repeat(np.arange(len(lens)), list(map(len, cuts)))
                n = np.fromiter(chain.from_iterable(cuts), np.int64, len(doc))
                stop = np.cumsum(n)
                raw = memoryview(ids.view(np.uint8))
                crc = np.array([zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(stop.tolist(), n.tolist(), strict=True)], np.int64)
                start = stop - n - (ends - lens)[doc]
                cols = [b.column(0).cast(pa.int64()).take(pa.array(doc)), *map(pa.array, (start, n, crc, lens[doc], crc ^ (start * 2654435761 % 4294967296), number + np.arange(len(doc))))]
                number += len(doc)
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, stop), pa.int32()), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return bounded(docs).select("doc_id", "text").mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, waste: float = WASTE, keep_ids: bool = False) -> DataFrame:
    """A row per piece with its sequence and its offset there.

    docs: doc_id, text (null: empty, which still has its END_ID); other columns are not read. Repeated rows are packed as
    often as they come. Sequence ids are unique but not dense. With keep_ids, the piece's token ids come along.

    Only narrow rows are shuffled: to rank a class's pieces inside shares, and to gather bins of at most `capacity` rows.
    Token ids are written once and shuffled once, to meet their places.
    """
    found = cut(pieces(docs, tokenizer, capacity, waste, keep_ids))
    if not keep_ids:
        return placed(found, capacity).drop("piece")
    return found.select("piece", "ids").join(placed(found.drop("ids"), capacity), "piece").select(*PIECE.names[:-2], "ids", "sequence_id", "offset")


def placed(found: DataFrame, capacity: int) -> DataFrame:
    """Written pieces with sequence_id and offset, without ids."""
    spark = found.sparkSession
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = found.withColumn("k", (F.lit(capacity) / F.col("length")).cast("long")).withColumn("share", F.pmod(F.xxhash64("share", "doc_id"), F.lit(shares)))
    held = p.groupBy("k", "share").count()
    before = Window.partitionBy("k").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("k")
    held = held.select("k", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"), F.sum("count").over(all_of).alias("of_class"))
    # of_class and base: a row for each class and share, at most 2 * sqrt(capacity) * shares
    ranked = p.withColumn("nth", F.row_number().over(Window.partitionBy("k", "share").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(held), ["k", "share"]).withColumn("nth", F.col("nth") + F.col("base"))
    full = F.floor(F.col("of_class") / F.col("k")) * F.col("k")
    ranked = ranked.withColumn("whole", F.col("nth") < full).withColumn("bin", F.floor(F.col("nth") / F.col("k")))
    keep = [c for c in PIECE.names if c != "share"]
    fit = Window.partitionBy("k", "bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranked.filter("whole").select(
        *keep, ((F.col("k") + 1) * F.lit(1 << 44) + F.col("bin")).alias("sequence_id"), F.coalesce(F.sum("length").over(fit), F.lit(0)).alias("offset")
    )
    # The tail: fewer than k pieces of each class k, at most most_left(capacity) rows for any input, in one small group.
    tail = ranked.filter("not whole").select(*keep)
    schema = T.StructType([*tail.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return whole.unionByName(tail.withColumn("_all", F.col("length") * 0).groupBy("_all").applyInPandas(lambda rows: first_fit(rows, capacity)[schema.names], schema))


def most_left(capacity: int) -> int:
    """Pieces that all classes leave over at most: k - 1 of each class k that a length can have."""
    return sum(k - 1 for k in {capacity // n for n in range(1, capacity + 1)})


def first_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins for the tail pieces: the longest first, each into the first bin with room."""
    rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    used = np.zeros(len(rows) + 1, np.int64)
    bins, offsets = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for i, n in enumerate(rows["length"]):
        b = int(np.argmax(used + n <= capacity))
        bins[i], offsets[i] = b, used[b]
        used[b] += n
    return rows.assign(sequence_id=bins, offset=offsets)
