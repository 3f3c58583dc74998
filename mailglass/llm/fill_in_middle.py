"""Fill-in-middle transformation by a piece table.

A batch of documents is never cut as text. It is a table of descriptors (buffer, start, length) over two buffers that do not
change: the documents' own bytes, as Arrow holds them, and the sentinels. Cutting splits a document's last descriptor in two,
an arrangement permutes its row of descriptors, and the inverse permutation restores it. Texts are joined, and hashes fed,
descriptor by descriptor.

A document's cuts and form follow from a hash of its id, so reruns and other partitionings agree. No shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailglass.llm.common import bounded, slices

FORMS = ("plain", "psm", "spm")
#: Of the descriptors prefix, middle, suffix and the three sentinels (0 to 5), the order in each form; a plain text has no
#: sentinels.
ORDERS = np.array([(0, 1, 2, 3, 4, 5), (3, 0, 4, 2, 5, 1), (4, 2, 3, 0, 5, 1)])
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class Settings:
    """seed: of the draws; rate: per cent of texts that are rearranged; spm: per cent of those that begin with the suffix;
    marks: the sentinels before prefix, suffix and middle, each neither empty nor the beginning or end of what a cut could
    complete to one (texts that hold one stay plain)."""

    seed: str = "42"
    rate: int = 50
    spm: int = 80
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")


@dataclass
class Pieces:
    """A row of descriptors for each document: which buffer, where in it, how many bytes."""

    buffers: tuple[memoryview, ...]
    which: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, data: memoryview, offsets: np.ndarray) -> Pieces:
        """One descriptor for each text."""
        start = offsets[:-1, None].astype(np.int64)
        return cls((data,), np.zeros(start.shape, np.int8), start, np.diff(offsets)[:, None].astype(np.int64))

    def split(self, at: np.ndarray) -> Pieces:
        """The last descriptor of each row becomes two, the first of them `at` bytes long."""
        left, rest = at[:, None], self.length[:, -1:] - at[:, None]
        return Pieces(self.buffers, np.hstack([self.which, self.which[:, -1:]]), np.hstack([self.start, self.start[:, -1:] + left]), np.hstack([self.length[:, :-1], left, rest]))

    def with_marks(self, marks: tuple[bytes, ...], used: np.ndarray) -> Pieces:
        """A descriptor more for each sentinel, empty in rows that do not use them."""
        n, sizes = len(used), np.array([len(m) for m in marks])
        start = np.broadcast_to(np.cumsum(sizes) - sizes, (n, len(marks)))
        which = np.full((n, len(marks)), len(self.buffers), np.int8)
        return Pieces((*self.buffers, memoryview(b"".join(marks))), np.hstack([self.which, which]), np.hstack([self.start, start]), np.hstack([self.length, np.where(used[:, None], sizes, 0)]))

    def arranged(self, order: np.ndarray) -> Pieces:
        return Pieces(self.buffers, *(np.take_along_axis(x, order, 1) for x in (self.which, self.start, self.length)))

    def first(self, n: int) -> Pieces:
        return Pieces(self.buffers, self.which[:, :n], self.start[:, :n], self.length[:, :n])

    def stream(self) -> Iterator[list[memoryview]]:
        """The bytes of each document as views of the buffers."""
        for w, s, k in zip(self.which.tolist(), self.start.tolist(), self.length.tolist(), strict=True):
            yield [self.buffers[b][i : i + n] for b, i, n in zip(w, s, k, strict=True) if n]

    def hashes(self) -> list[str]:
        out = []
        for views in self.stream():
            h = hashlib.sha256()
            for v in views:
                h.update(v)
            out.append(h.hexdigest())
        return out

    def joined(self) -> list[bytes]:
        return [b"".join(views) for views in self.stream()]


def arrow_bytes(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a column of texts (null: empty) where they lie, and each text's bounds in them."""
    c = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = c.buffers()
    if not len(c) or data is None:
        return memoryview(b""), np.zeros(len(c) + 1, np.int64)
    return memoryview(data), np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units end (a word with the white space before it, or white space at a text's end), for all texts one after the
    other, and where each text's begin among them."""
    low, high = int(offsets[0]), int(offsets[-1])
    space = IS_SPACE[data[low:high]]
    end = np.zeros(high - low, bool)
    end[:-1] = ~space[:-1] & space[1:]
    filled = offsets[1:] > offsets[:-1]
    end[offsets[1:][filled] - low - 1] = True
    ends = np.flatnonzero(end) + low + 1
    return ends, np.searchsorted(ends, offsets, side="right")


def holding(data: memoryview, offsets: np.ndarray, marks: tuple[bytes, ...]) -> np.ndarray:
    """Which texts hold a sentinel."""
    out = np.zeros(len(offsets) - 1, bool)
    whole = bytes(data[int(offsets[0]) : int(offsets[-1])])
    for m in marks:
        at = whole.find(m)
        while at >= 0:
            where = at + int(offsets[0])
            doc = int(np.searchsorted(offsets, where, side="right")) - 1
            if where + len(m) <= offsets[doc + 1]:
                out[doc] = True
            at = whole.find(m, at + 1)
    return out


def code_points(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[int]:
    return [int(np.count_nonzero((data[s : s + n] & 0xC0) != 0x80)) for s, n in zip(start.tolist(), length.tolist(), strict=True)]


def rearrange(column: pa.Array, draws: np.ndarray, s: Settings) -> tuple[Pieces, dict[str, list]]:
    """The texts as arranged descriptors, and n, form, prefix_chars and middle_chars of each."""
    data, offsets = arrow_bytes(column)
    raw, marks = np.frombuffer(data, np.uint8), tuple(m.encode() for m in s.marks)
    ends, first = unit_ends(raw, offsets)
    n = np.diff(first)
    form = np.where((n == 0) | (draws[:, 2] % 100 >= s.rate) | holding(data, offsets, marks), 0, np.where(draws[:, 3] % 100 < s.spm, 2, 1))
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    edges = np.concatenate([[0], ends])
    at = np.where(cuts == 0, offsets[:-1, None], edges[np.where(cuts == 0, 0, first[:-1, None] + cuts)]) - offsets[:-1, None]
    pieces = Pieces.of(data, offsets).split(at[:, 0]).split(at[:, 1] - at[:, 0]).with_marks(marks, form > 0)
    chars = {k: [None if f == 0 else c for f, c in zip(form.tolist(), code_points(raw, pieces.start[:, i], np.where(form > 0, pieces.length[:, i], 0)), strict=True)] for i, k in enumerate(("prefix_chars", "middle_chars"))}
    return pieces.arranged(ORDERS[form]), {"n": n.tolist(), "form": [FORMS[f] for f in form.tolist()], **chars}


def restored(outputs: list[bytes], forms: list[str], s: Settings) -> Pieces:
    """The texts that arranged ones were made from, as descriptors over these: cut at the sentinels, permuted back."""
    marks = [m.encode() for m in s.marks]
    form = np.array([FORMS.index(f) for f in forms], np.int64)
    offsets = np.cumsum([0, *map(len, outputs)])
    ats = np.zeros((len(outputs), 5), np.int64)
    for i, (out, f) in enumerate(zip(outputs, form.tolist(), strict=True)):
        if f == 0:
            ats[i] = len(out), 0, 0, 0, 0
            continue
        at = 0
        for j, m in enumerate(marks[k - 3] for k in ORDERS[f] if k >= 3):
            found = out.index(m, at)
            if j == 0 and found:
                raise ValueError("an arranged text begins with a sentinel")
            ats[i, 2 * j] = len(m)
            if j:
                ats[i, 2 * j - 1] = found - at
            at = found + len(m)
    pieces = Pieces.of(memoryview(b"".join(outputs)), offsets)
    for j in range(5):
        pieces = pieces.split(ats[:, j])
    return pieces.arranged(np.argsort(ORDERS, axis=1)[form]).first(3)


def draws(seed: str, doc_id: Column) -> Column:
    """The first four 8-digit groups of the id's SHA-256 behind the seed, as numbers; a null id counts as the empty text."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


CUT = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]


def _each_text(docs: DataFrame, s: Settings, id_col: str, text_col: str, keep_text: bool, fields: list[T.StructField], results: Callable) -> DataFrame:
    """docs with what `results` makes of each batch's arrangement; columns of the new names give way."""
    new = {f.name.lower() for f in [*CUT, *fields]}
    kept = [c for c in docs.columns if c.lower() not in new and (keep_text or c != text_col)]
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("_fim_text"), draws(s.seed, F.col(id_col)).alias("_fim_draws"))
    schema = T.StructType([*base.select(*[f"`{c}`" for c in kept]).schema.fields, *CUT, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, len(kept)):
                d = b.column(len(kept) + 1).flatten().to_numpy().reshape(-1, 4)
                pieces, said = rearrange(b.column(len(kept)), d, s)
                cut = [pa.array(said["n"], pa.int64()), pa.array(said["form"], pa.string()), pa.array(said["prefix_chars"], pa.int64()), pa.array(said["middle_chars"], pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *cut, *results(pieces, said["form"])], names=schema.names)

    return bounded(base).mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (null if plain) and output, the arranged text.

    Null and empty texts are plain and have the output "". Rows that share an id share their draws; equal rows get equal
    results. A text of any length is cut whole. Columns called as new ones give way. An empty table gives an empty result.
    """
    out = T.StructField("output", T.StringType())
    return _each_text(docs, settings, id_col, text_col, text_col != "output", [out], lambda pieces, _: [pa.array(pieces.joined(), pa.binary()).cast(pa.string())])


def restore(rows: DataFrame, settings: Settings = Settings(), output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """rows with the exact text that each output was made from; null outputs or forms give null."""
    marks = settings

    @F.pandas_udf("string")
    def back(outputs, forms):
        import pandas as pd

        known = outputs.notna() & forms.notna()
        got = restored([o.encode() for o in outputs[known]], list(forms[known]), marks).joined()
        return pd.Series([t.decode() for t in got], index=outputs.index[known], dtype=object).reindex(outputs.index, fill_value=None)

    return bounded(rows).withColumn(name, back(F.col(output_col), F.col(form_col)))


def digests(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the text, as fill_in_middle, but the SHA-256 of each output, and of the text rebuilt from the output and
    the form, in the place of texts: what a run without stored outputs is checked by."""
    fields = [T.StructField(k, T.StringType()) for k in ("output_sha256", "restored_sha256")]

    def hashes(pieces: Pieces, forms: list[str]) -> list[pa.Array]:
        return [pa.array(pieces.hashes(), pa.string()), pa.array(restored(pieces.joined(), forms, settings).hashes(), pa.string())]

    return _each_text(docs, settings, id_col, text_col, False, fields, hashes)
