"""What the operators of this subpackage share: cutting lineage, passing Arrow batches, word tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailglass.functions.batches import bounded

#: The characters that separate words in every contract here; bytes.split() uses exactly these.
SPACE = r"\x20\x09-\x0D"
#: Most bytes of text that a numpy step handles at once.
CHUNK_BYTES = 4 << 20
_OWN_DIR: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master without one (tests) gets a temporary folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _OWN_DIR.setdefault(sc.applicationId, None) or tempfile.mkdtemp(prefix="spark-")
        _OWN_DIR[sc.applicationId] = at
    return at.rstrip("/")


#: Paths that cut() has written inside each open scratch().
_SCRATCH: list[list[str]] = []


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that were written in the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What cut() writes inside goes at the end, but for what it was told to keep."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        remove(spark, _SCRATCH.pop())


def cut(df: DataFrame, partitions: int | None = None, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there, and lost executors lose nothing.

    keep: the rows outlive an open scratch(), as results that are read later must.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_rest(c: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def give_back() -> None:
    """Hands memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with give_back() at the end of each task: Python workers live on beside the JVM while later stages need its memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def slices(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each; a longer text stands alone, whole."""
    col = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def append_columns(df: DataFrame, text_col: str, work: Callable[[list[str]], list[pa.Array]], fields: list[T.StructField], most: int = CHUNK_BYTES) -> DataFrame:
    """df with columns that `work` makes from its texts (null: empty), in one pass of Arrow batches.

    `work` gets a list of texts, of about `most` bytes or a single one, and returns an array for each field. A column of df that has the name of a new one
    gives way to it.
    """
    names = {f.name.lower() for f in fields}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    at = base.columns.index(text_col)
    schema = T.StructType([*base.schema.fields, *fields])
    new = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at, most):
                texts = [t or "" for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, *work(texts)], names=[*b.schema.names, *new])

    return bounded(base).mapInArrow(tidy(run), schema)


class Words(dict):
    """Numbers words in order of first sight; `fresh` holds those that no one has looked at yet."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


class WordTable:
    """What `look` says of each word (a row of numpy arrays), remembered for words seen before.

    `look` maps a list of words to a tuple of arrays with a row per word. At `most` words the memory is emptied, and so it is
    when another table is used in the same Python worker, so a worker holds one full table at most.
    """

    used: WordTable | None = None

    def __init__(self, look: Callable[[list[bytes]], tuple[np.ndarray, ...]], most: int = 250_000) -> None:
        self.look, self.most = look, most
        self.clear()

    def clear(self) -> None:
        self.words, self.known, self.rows = Words(), 0, None

    def ids(self, words: list[bytes]) -> np.ndarray:
        if WordTable.used is not None and WordTable.used is not self:
            WordTable.used.clear()
        WordTable.used = self
        if len(self.words) > self.most:
            self.clear()
        out = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if fresh := self.words.fresh:
            self.add(self.look(fresh), len(fresh))
            self.words.fresh = []
        return out

    def add(self, new: tuple[np.ndarray, ...], n: int) -> None:
        if self.rows is None:
            self.rows = tuple(np.empty((1024, *x.shape[1:]), x.dtype) for x in new)
        if self.known + n > len(self.rows[0]):
            size = max(2 * len(self.rows[0]), self.known + n)
            self.rows = tuple(np.concatenate([x[: self.known], np.empty((size - self.known, *x.shape[1:]), x.dtype)]) for x in self.rows)
        for x, y in zip(self.rows, new, strict=True):
            x[self.known : self.known + n] = y
        self.known += n


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """The model of this name in a Python worker. Workers live on from stage to stage, so one holds a single model: another
    name drops the model before, its word table with it, and hands the freed memory back to the system."""
    if key not in _HELD:
        _HELD.clear()
        WordTable.used = None
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> tuple[np.ndarray]:
    import xxhash

    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)),)
