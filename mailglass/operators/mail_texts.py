"""One pass over a mail's texts: folding, and every dictionary term of every rule found by one automaton.

The automaton (Aho-Corasick) holds all terms that any rule, the brands, the code words and the marks of a way to unsubscribe
ask for; a Python worker compiles it once for a rulebook and reads each folded part of a mail once, whatever the number of
rules. What leaves the pass is small: the folded parts, for each list of terms the first one met, brands, and the code word.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.functions.batches import by_arrow
from mailglass.functions.folding import fold_one
from mailglass.functions.rules import term_lists
from mailglass.rulebook import Rulebook

#: Brands that mails often only refer to, the words of such references, and how far around they are sought.
PLATFORMS = ("微信", "微信支付", "微博", "支付宝", "知乎", "抖音", "小红书", "朋友圈", "wechat", "weixin", "weibo", "alipay", "zhihu", "instagram", "facebook", "twitter", "linkedin", "youtube", "tiktok", "whatsapp")
CUES = ("关注我们", "公众号", "微信号", "扫码", "二维码", "扫描", "订阅号", "服务号", "官方微博", "微博:", "微信:", "follow us", "find us on", "official account", "支付方式", "付款方式", "支付渠道", "payment method", "paid with")
AROUND_BRAND, AROUND_CODE = 60, 80
#: A code of 4 to 10 letters and digits; marks of a way to unsubscribe.
CODE = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]{4,10}(?![A-Za-z0-9]))[A-Za-z0-9]*\d[A-Za-z0-9]*")
UNSUBSCRIBE = ("unsubscribe", "退订", "取消订阅", "取消訂閱")

#: The folded parts of a mail (plain: the HTML with its references decoded), and of which parts a field of rules consists.
#: Terms hold no line break, so no term lies across two parts.
PARTS = ("text", "html", "plain", "visible", "hidden", "subject", "name")
#: What the pass is given; of the last two it only folds the text, the first of them in lower case.
GIVEN = ("text", "html", "visible", "hidden", "subject", "name", "senders", "domain")
FIELDS = {"body": ("text", "html", "plain"), "text": ("subject", "text", "html", "plain"), "visible_text": ("text", "visible"), "subject": ("subject",), "from.display_name": ("name",), "raw_html": ("html",)}
#: Where the brands of each text are looked for.
BRAND_TEXTS = {"seen": ("text", "visible"), "hidden": ("hidden",), "name": ("name",)}


@dataclass(frozen=True)
class Seek:
    """Everything that is looked for in a book's mails. lists: (parts, terms sought and shown)."""

    lists: tuple[tuple[tuple[str, ...], tuple[tuple[str, str], ...]], ...]
    brands: tuple[str, ...]
    shadows: tuple[tuple[str, tuple[str, ...]], ...]
    codes: tuple[str, ...]
    clauses: tuple[str, ...]

    def slot(self, field: str, terms: tuple[tuple[str, str], ...]) -> int | None:
        key = (FIELDS.get(field), tuple(terms))
        return self.lists.index(key) if key in self.lists else None


def seek_of(book: Rulebook) -> Seek:
    lists = {(FIELDS["body"], tuple((u, u) for u in UNSUBSCRIBE)): None}
    for rule in book.rules:
        for s in rule.specs if rule.enabled and rule.scope == "mail" else ():
            while s is not None:
                if s.field in FIELDS:
                    lists |= {(FIELDS[s.field], terms): None for terms in term_lists(s, book.terms)}
                s = s.exclude
    brands = tuple(b for b in dict.fromkeys(book.terms["brands"]) if "." not in b)
    return Seek(tuple(lists), brands, tuple(book.shadows.items()), tuple(book.terms["otp_keywords"]), tuple(book.terms["otp_notice_clauses"]))


def hits_of(book: Rulebook) -> str:
    """The name under which a book's hits go, so that those of another book are not taken for them."""
    return f"hits_{book.version}"


def brand_pattern(brand: str) -> str:
    return rf"(?<![a-z0-9]){re.escape(brand)}(?![a-z0-9])" if brand.isascii() else re.escape(brand)


def brand_stands(text: str, brand: str, shadows: tuple[str, ...]) -> bool:
    """Whether a brand that occurs is meant: some place is no part of another word, and a platform is not only referred to."""
    at = [m.span() for m in re.finditer(brand_pattern(brand), text, re.I)]
    dark = [m.span() for s in shadows for m in re.finditer(re.escape(s), text)]
    if shadows and all(any(a < end and start < b for a, b in dark) for start, end in at):
        return False
    near = lambda start, end: any(c in text[max(0, start - AROUND_BRAND) : end + AROUND_BRAND] for c in CUES)
    return not (brand in PLATFORMS and all(near(*span) for span in at))


def code_notice(text: str, words: tuple[str, ...], clauses: tuple[str, ...]) -> str:
    """The first word near which stand a code and a clause on its use; empty without one."""
    for w in words:
        for m in re.finditer(re.escape(w), text):
            near = text[max(0, m.start() - AROUND_CODE) : m.end() + AROUND_CODE]
            if any(c in near for c in clauses) and CODE.search(near):
                return w
    return ""


_READY: dict[Seek, Finder] = {}


def alone(text: str, begin: int, end: int) -> bool:
    """No letter or digit of ASCII stands before or behind."""
    other = lambda c: not ("a" <= c <= "z" or "0" <= c <= "9")
    return (begin == 0 or other(text[begin - 1])) and (end == len(text) or other(text[end]))


class Finder:
    """The automaton of a Seek. Its terms are numbered; a worker keeps the one it used last."""

    def __init__(self, seek: Seek) -> None:
        import ahocorasick

        self.seek, self.shadows = seek, dict(seek.shadows)
        number: dict[str, int] = {}
        at = lambda t: number.setdefault(t, len(number))
        self.lists = [(parts, [(at(k), v) for k, v in terms]) for parts, terms in seek.lists]
        self.brands = {at(b): (i, b) for i, b in enumerate(seek.brands)}
        self.codes, self.clauses = {at(c) for c in seek.codes}, {at(c) for c in seek.clauses}
        self.always = {number[""]} if "" in number else set()
        self.automaton = ahocorasick.Automaton()
        for t, n in number.items():
            if t:
                self.automaton.add_word(t, n)
        self.automaton.make_automaton()

    @classmethod
    def of(cls, seek: Seek) -> Finder:
        if seek not in _READY:
            _READY.clear()
            _READY[seek] = cls(seek)
        return _READY[seek]

    def read(self, text: str) -> tuple[set[int], set[int]]:
        """The terms in a folded text, and those of the brands that stand there as a word of their own."""
        met, words = set(self.always), set()
        if text and len(self.automaton):
            for end, n in self.automaton.iter(text):
                met.add(n)
                if n in self.brands and n not in words:
                    b = self.brands[n][1]
                    if not b.isascii() or alone(text, end + 1 - len(b), end + 1):
                        words.add(n)
        return met, words

    def meant(self, words: set[int], texts: list[str]) -> list[str]:
        """The brands among words that are meant, in the dictionary's order."""
        found = [b for _, b in sorted(self.brands[n] for n in words)]
        asked = [b for b in found if b in PLATFORMS or b in self.shadows]
        whole = "\n".join(texts) if asked else ""
        return [b for b in found if b not in asked or brand_stands(whole, b, self.shadows.get(b, ()))]

    def notice(self, met: set[int], texts: list[str]) -> str:
        return code_notice("\n".join(texts), self.seek.codes, self.seek.clauses) if met & self.codes and met & self.clauses else ""

    def mail(self, parts: dict[str, str]) -> dict:
        """hits (the first term of each list, as shown), brands (of BRAND_TEXTS) and code of a mail's folded parts."""
        once: dict[str, tuple[set[int], set[int]]] = {}
        for t in parts.values():
            if t not in once:
                once[t] = self.read(t)
        together = {of: set().union(*(once[parts[p]][0] for p in of)) for of in dict.fromkeys(of for of, _ in self.lists)}
        hits = [next((v for n, v in terms if n in met), None) if (met := together[of]) else None for of, terms in self.lists]
        texts = {k: [parts[p] for p in of] for k, of in BRAND_TEXTS.items()}
        brands = {k: self.meant(set().union(*(once[t][1] for t in ts)), ts) for k, ts in texts.items()}
        return {"hits": hits, "brands": brands, "code": self.notice(set().union(*(once[t][0] for t in texts["seen"])), texts["seen"])}


FOUND = "struct<" + ", ".join(f"{p}:string" for p in (*PARTS, "senders", "domain")) + ", hits:array<string>, brands:struct<seen:array<string>, hidden:array<string>, name:array<string>>, code:string>"


def read_texts(given: dict[str, Column], book: Rulebook) -> Column:
    """FOUND for a mail's raw texts (of GIVEN; null: empty): its parts folded, in lower case, and what stands in them."""
    seek = seek_of(book)

    @by_arrow(FOUND)
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder.of(seek)
        fold = lambda t: fold_one(t).lower()
        for batch in batches:
            parts = {p: [fold(t) for t in batch[p]] for p in PARTS if p != "plain"}
            parts["plain"] = [fold(html.unescape(t)) if "&" in t else same for t, same in zip(batch["html"], parts["html"], strict=True)]
            rows = [finder.mail(dict(zip(parts, texts, strict=True))) for texts in zip(*parts.values(), strict=True)]
            found = {k: [r[k] for r in rows] for k in ("hits", "brands", "code")}
            folded = {p: parts[p] for p in PARTS} | {"senders": [fold(t) for t in batch["senders"]], "domain": [fold_one(t) for t in batch["domain"]]}
            yield pd.DataFrame(folded | found)

    return read(F.struct(*[F.coalesce(given[p], F.lit("")).alias(p) for p in GIVEN]))


def with_brand_hits(df: DataFrame, texts: dict[str, str], book: Rulebook) -> DataFrame:
    """df with arrays of brands: for each new column, those that a folded text in lower case mentions, in the dictionary's
    order; names of hosts among them are left out."""
    seek = seek_of(book)

    @by_arrow("array<string>")
    def brands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder.of(seek)
        for batch in batches:
            yield pd.Series([None if t is None else finder.meant(finder.read(t)[1], [t]) for t in batch], dtype=object)

    return df.withColumns({name: brands(F.col(text)) for name, text in texts.items()})


def otp_notice(text: Column, book: Rulebook) -> Column:
    """The word of a notice that delivers a code: near the word stand a code and a clause on its use. Empty without one."""
    seek = seek_of(book)

    @by_arrow("string")
    def notice(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder.of(seek)
        for batch in batches:
            yield pd.Series([finder.notice(finder.read(t)[0], [t]) for t in batch], dtype=object)

    return notice(F.lower(F.coalesce(text, F.lit(""))))
