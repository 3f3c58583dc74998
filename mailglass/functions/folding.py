"""Folding of disguised text: invisible characters, styled letters, marks, look-alikes."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailglass.functions import values as V
from mailglass.functions.batches import by_arrow
from mailglass.functions.text import ZERO_WIDTH

_INVISIBLE = re.compile(ZERO_WIDTH)
_LOOKS = str.maketrans(*V.HOMOGLYPHS)
_BEYOND_ASCII = re.compile(r"[^\x00-\x7F]+")
#: Runs up to this length, single accented letters most of all, are remembered.
_SHORT = 8


def _bare(run: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", run) if unicodedata.category(c) != "Mn")


def _folded(run: str) -> str:
    return _bare(_INVISIBLE.sub("", run)).translate(_LOOKS)


_short_bare, _short_folded = lru_cache(1 << 14)(_bare), lru_cache(1 << 14)(_folded)


def bare_one(text: str) -> str:
    """The text without compatibility forms and marks. Marks belong to what stands before them, and ASCII characters are bases,
    so runs beyond ASCII are made plain by themselves."""
    return text if text.isascii() else _BEYOND_ASCII.sub(lambda m: _short_bare(m[0]) if len(m[0]) <= _SHORT else _bare(m[0]), text)


def fold_one(text: str) -> str:
    """The text without invisible characters, compatibility forms and marks; look-alikes of Latin letters made Latin."""
    return text if text.isascii() else _BEYOND_ASCII.sub(lambda m: _short_folded(m[0]) if len(m[0]) <= _SHORT else _folded(m[0]), text)


def refang_one(text: str) -> str:
    """Invisible characters out, references decoded, compatibility forms, marks and slashes made plain; hxxp stays."""
    text = text if text.isascii() else _INVISIBLE.sub("", text)
    return re.sub(r"\\+/", "/", bare_one(html.unescape(text) if "&" in text else text))


#: What ASCII text never needs: only texts with other characters go through Python.
NOT_ASCII = r"[^\x00-\x7F]"


def by_batch(one: Callable, kind: str = "string") -> Callable[[Column], Column]:
    """`one` over bounded Arrow batches, value by value; null stays null."""

    @by_arrow(kind)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return apply


def each(one: Callable[[str], str]) -> Callable:
    return lambda values: [None if v is None else one(v) for v in values]


def fold_text(text: Column) -> Column:
    """The text without disguise. Spark has no normalisation of its own, so texts beyond ASCII pass through Python."""
    return F.coalesce(by_batch(fold_one)(F.when(text.rlike(NOT_ASCII), text)), text)


def fold_lower(text: Column) -> Column:
    return F.lower(fold_text(text))


def refang(text: Column) -> Column:
    """refang_one for texts that have anything to restore: other than ASCII, a reference or an escaped slash."""
    return F.coalesce(by_batch(refang_one)(F.when(text.rlike(NOT_ASCII + r"|&|\\\\+/"), text)), text)


def unescape(text: Column) -> Column:
    """Character references decoded."""
    return F.coalesce(by_batch(html.unescape)(F.when(F.contains(text, F.lit("&")), text)), text)


def fold_each(texts: Column) -> Column:
    """fold_text of every element of an array of strings."""
    some = F.exists(texts, lambda t: t.rlike(NOT_ASCII))
    return F.coalesce(by_batch(each(fold_one), "array<string>")(F.when(some, texts)), texts)


def unescape_each(texts: Column) -> Column:
    some = F.exists(texts, lambda t: F.contains(t, F.lit("&")))
    return F.coalesce(by_batch(each(html.unescape), "array<string>")(F.when(some, texts)), texts)
