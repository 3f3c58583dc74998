"""Quality rules: tokeniser fertility.

A public vocabulary measures each text: characters per token, share of byte-fallback tokens, entropy of its tokens. Each
script has bands of these; a text outside its script's bands goes. So does one below the floors of its language, which its
letters tell. Beside that, plain counts of words, symbols, repeated lines and repeated word windows decide the base rule.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mailglass.llm.common import WordTable, append_columns, held

WINDOW = 8
#: Most bytes of text that are measured at once: tokens, their counts and windows take many times its size.
STEP_BYTES = 1 << 20
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """What a script's texts may show: characters per token, share of byte-fallback tokens, entropy in bits.

    The entropy of n tokens cannot pass log2(n), so the floor is the lesser of `min_entropy` and `min_fill * log2(n)`.
    """

    min_chars: float
    max_chars: float
    max_fallback: float
    min_entropy: float
    min_fill: float


#: By script; "Other" holds for the rest. Texts without a letter have script "None".
BANDS = {
    "LATIN": Band(1.55, 8.0, 0.05, 4.5, 0.5),
    "CYRILLIC": Band(1.2, 8.0, 0.1, 4.5, 0.5),
    "GREEK": Band(0.6, 8.0, 0.5, 4.0, 0.4),
    "ARABIC": Band(0.6, 8.0, 0.5, 4.0, 0.4),
    "HEBREW": Band(0.6, 8.0, 0.5, 4.0, 0.4),
    "CJK": Band(0.3, 4.0, 0.9, 4.0, 0.4),
    "HIRAGANA": Band(0.3, 4.0, 0.9, 4.0, 0.4),
    "HANGUL": Band(0.3, 4.0, 0.9, 4.0, 0.4),
    "NONE": Band(0.0, 4.0, 1.0, 0.0, 0.0),
    "OTHER": Band(0.2, 10.0, 1.0, 3.0, 0.3),
}


@dataclass(frozen=True)
class Floor:
    """What a language's text of n tokens shows at least: `chars - slack / sqrt(n)` characters per token, and the entropy
    in bits at ENTROPY_AT, straight lines between."""

    chars: float
    slack: float
    entropy: tuple[float, ...]


#: log2 of the tokens at which floors state an entropy. Beyond the last it stays; below the first it falls to 0.
ENTROPY_AT = tuple(range(6, 14))
#: By language. From the unlabelled texts of sf0.1, split by their letters: the median of characters per token and five
#: robust spreads; the usual entropy less four. How many spreads was settled with a look at the labels of sf0.1. There is no
#: upper bound, so richer texts stay.
FLOORS = {
    "en": Floor(2.213, 4.8, (4.97, 5.51, 5.92, 6.21, 6.39, 6.50, 6.55, 6.55)),
    "de": Floor(2.243, 4.8, (4.92, 5.45, 5.83, 6.08, 6.22, 6.30, 6.33, 6.34)),
    "fr": Floor(1.979, 4.9, (4.97, 5.44, 5.79, 6.03, 6.19, 6.27, 6.31, 6.31)),
    "es": Floor(1.937, 5.3, (4.97, 5.43, 5.79, 6.06, 6.26, 6.37, 6.42, 6.40)),
}
#: Published letter frequencies in percent; any other letter counts as RARE.
LETTERS = {
    "en": ("abcdefghijklmnopqrstuvwxyz", (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)),
    "de": ("abcdefghijklmnopqrstuvwxyzäöüß", (6.5, 1.9, 2.7, 5.1, 16.4, 1.7, 3.0, 4.6, 6.6, 0.27, 1.4, 3.4, 2.5, 9.8, 2.6, 0.67, 0.018, 7.0, 7.3, 6.2, 4.2, 0.85, 1.9, 0.034, 0.039, 1.1, 0.58, 0.44, 1.0, 0.31)),
    "fr": ("abcdefghijklmnopqrstuvwxyzàâçéèêîôùûœ", (7.6, 0.9, 3.3, 3.7, 14.7, 1.1, 0.87, 0.74, 7.5, 0.61, 0.074, 5.5, 3.0, 7.1, 5.8, 2.5, 1.4, 6.7, 7.9, 7.2, 6.3, 1.8, 0.049, 0.43, 0.13, 0.33, 0.49, 0.05, 0.085, 1.5, 0.27, 0.22, 0.045, 0.023, 0.058, 0.06, 0.018)),
    "es": ("abcdefghijklmnopqrstuvwxyzáéíñóúü", (11.5, 2.2, 4.0, 5.0, 12.2, 0.69, 1.8, 0.7, 6.2, 0.49, 0.011, 5.0, 3.2, 6.7, 8.7, 2.5, 0.88, 6.9, 8.0, 4.6, 2.9, 1.1, 0.017, 0.22, 1.0, 0.47, 0.5, 0.43, 0.73, 0.31, 0.83, 0.17, 0.012)),
}
RARE = 0.005
#: Least mean of a letter's log probability. Texts that fit no language so well (Finnish: -3.2, Polish: -3.75) are held to
#: their script's bands alone.
FIT = -3.15


def letter_weights() -> np.ndarray:
    """A thousand times the log probability of each character up to U+017F in each language; 0 for what is no letter, the
    last row for letters beyond."""
    odds = np.zeros((0x181, len(FLOORS)), np.int64)
    for x, lang in enumerate(FLOORS):
        known = dict(zip(*LETTERS[lang], strict=True))
        for c in range(len(odds)):
            if c == 0x180 or chr(c).isalpha():
                odds[c, x] = round(1000 * np.log(known.get(chr(c), RARE) / 100))
    return odds


def letter_votes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of letter_weights for each word and language, and the letters of each word."""
    lower = [w.lower() for w in words]
    points = np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32)
    far = np.unique(points[points >= 0x180])
    odd = far[[not chr(c).isalpha() for c in far]]
    points = np.where(np.isin(points, odd), 0, np.minimum(points, 0x180))
    weights = letter_weights()
    letters = np.any(weights != 0, axis=1)
    ends = np.cumsum([len(w) for w in lower])
    sums = lambda x: np.diff(np.concatenate([np.zeros((1, *x.shape[1:]), np.int64), np.cumsum(x, axis=0, dtype=np.int64)])[np.concatenate([[0], ends])], axis=0)
    return sums(weights[points]).astype(np.int32), sums(letters[points]).astype(np.int32)


def above_floor(lang: str, n: int, per: float, entropy: float) -> bool:
    f = FLOORS[lang]
    return per >= f.chars - f.slack / np.sqrt(n) and entropy >= np.interp(np.log2(n), (0, *ENTROPY_AT), (0, *f.entropy))


FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("script", T.StringType()),
    T.StructField("n_tokens", T.LongType()),
    *(T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "fallback_share", "token_entropy")),
    T.StructField("kept", T.BooleanType()),
]


def script_of(text: str) -> str:
    """The script of most letters: the first word of the letters' Unicode names. Ties go to the alphabetically first."""
    if 2 * sum(map(text.count, "etaoinsrh")) > len(text):
        return "LATIN"
    counts: dict[str, int] = {}
    for ch in set(text):
        if ch.isalpha():
            s = unicodedata.name(ch, "OTHER").split()[0]
            counts[s] = counts.get(s, 0) + text.count(ch)
    return min(counts, key=lambda s: (-counts[s], s)) if counts else "NONE"


def repeated_words(ids: np.ndarray) -> int:
    """Words of `ids` that lie in a window of WINDOW words found at two places or more."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, WINDOW))
    _, inverse, counts = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * WINDOW))).ravel(), return_inverse=True, return_counts=True)
    step = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def maybe_repeated(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text (the words from one start to the next), whether two windows have one hash; then they may be equal."""
    n_docs = len(starts) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(starts))
    n = len(ids) - WINDOW + 1
    found = np.zeros(n_docs, bool)
    if n <= 1:
        return found
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + doc[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    whole = doc[:n] == doc[WINDOW - 1 :]
    h, doc = h[whole], doc[:n][whole]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    found[doc[order[1:][same]]] = True
    return found


class Fertility:
    """Word pieces of a sentencepiece vocabulary; a text's tokens are those of its words in turn."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.table = WordTable(self.look)
        self.flat: list[np.ndarray] = []

    def look(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        if not self.table.known:
            self.pieces, self.used = np.empty(1 << 16, np.int32), 0
        got = self.sp.encode([w.decode() for w in words], num_threads=1)
        lens = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((x for g in got for x in g), np.int32, int(lens.sum()))
        if self.used + len(flat) > len(self.pieces):
            self.pieces = np.concatenate([self.pieces[: self.used], np.empty(max(len(self.pieces), len(flat)), np.int32)])
        self.pieces[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        return starts, lens, *letter_votes([w.decode() for w in words])

    def languages(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The language of FLOORS that each text's letters fit best; empty where none fits."""
        votes, letters = np.zeros((len(starts) - 1, len(FLOORS)), np.int64), np.zeros(len(starts) - 1, np.int64)
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            votes[full] = np.add.reduceat(self.table.rows[2][ids], starts[full], axis=0, dtype=np.int64)
            letters[full] = np.add.reduceat(self.table.rows[3][ids], starts[full], dtype=np.int64)
        best = votes.argmax(axis=1)
        fits = (letters > 0) & (votes.max(axis=1) >= 1000 * FIT * letters)
        return [list(FLOORS)[b] if ok else "" for b, ok in zip(best, fits, strict=True)]

    def measure(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, byte-fallback tokens and entropy of each text."""
        n = len(starts) - 1
        if not len(ids):
            return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        at, lens = (x[ids] for x in self.table.rows[:2])
        ends = np.cumsum(lens)
        toks = self.pieces[np.repeat(at - (ends - lens), lens) + np.arange(ends[-1])]
        per_doc = np.concatenate([[0], ends])[starts]
        counts = np.diff(per_doc)
        doc = np.repeat(np.arange(n), counts)
        fallback = np.bincount(doc, self.is_byte[toks], n).astype(np.int64)
        key, times = np.unique(doc * len(self.is_byte) + toks, return_counts=True)
        share = times / counts[key // len(self.is_byte)]
        return counts, fallback, np.bincount(key // len(self.is_byte), -share * np.log2(share), n)


def measure_texts(texts: list[str], path: str, bands: dict[str, Band]) -> list[pa.Array]:
    fertility = held(("fertility", path), lambda: Fertility(path))
    words = [t.encode().split() for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lens)])
    ids = fertility.table.ids([w for ws in words for w in ws])
    tokens, fallback, entropy = fertility.measure(ids, starts)
    languages = fertility.languages(ids, starts)
    maybe = maybe_repeated(ids, starts)
    cols: list[list] = [[] for _ in FIELDS]
    for i, t in enumerate(texts):
        n = int(lens[i])
        chars = len(t) - sum(map(t.count, " \t\n\r\x0b\x0c"))
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        repeat = repeated_words(ids[starts[i] : starts[i + 1]]) if maybe[i] else 0
        failed = n < 20 or 100 * repeat > 30 * n
        script, k = script_of(t), int(tokens[i])
        per = chars / k if k else None
        share = int(fallback[i]) / k if k else None
        h = max(0.0, float(entropy[i])) if k else None
        band = bands.get(script, bands["OTHER"])
        good = not failed and band.min_chars <= per <= band.max_chars and share <= band.max_fallback and h >= min(band.min_entropy, band.min_fill * np.log2(k))
        good = good and (script != "LATIN" or not languages[i] or above_floor(languages[i], k, per, h))
        for c, v in zip(cols, (n, chars, sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, script, k, per, share, h, bool(good)), strict=True):
            c.append(v)
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    return [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(cols, FIELDS, strict=True)]


def quality_rules(docs: DataFrame, vocabulary: str, text_col: str = "text", bands: dict[str, Band] | None = None) -> DataFrame:
    """docs with the counts, measures and verdict of every whole text; one pass, no shuffle.

    vocabulary: path of a sentencepiece model on every worker. Null and empty texts have 0 words, null measures,
    base_failed true and kept false. Repeated rows get equal results. A column with the name of a result gives way.
    """
    bands = bands or BANDS
    return append_columns(docs, text_col, lambda texts: measure_texts(texts, vocabulary, bands), FIELDS, STEP_BYTES)
