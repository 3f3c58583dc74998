"""Column functions over text, hosts and file names; all JVM-side."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.functions import values as V

ZERO_WIDTH = r"[­​-‏⁠-⁤﻿]"
STYLED = r"[\x{1D400}-\x{1D7FF}]|[０-９Ａ-Ｚａ-ｚ]|[\p{Mn}&&[^\u0000-ͯ]]"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MD5, SHA256 = r"\b[0-9a-fA-F]{32}\b", r"\b[0-9a-fA-F]{64}\b"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a column that a lambda reads would be put in its place and computed for every
    element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a struct that is computed once a row, however many of its fields are read and wherever: what a generator gives is
    not put in the place of its uses, as the expression of a plain column is."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def private_ip(ip: Column) -> Column:
    """Loopback, link-local, shared and private IPv4 ranges."""
    return ip.rlike(r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)")


def url_host(url: Column) -> Column:
    """What stands in lower case between the scheme and the next : / ? or #; a user in front of the host stays, so that
    disguised links are not taken for what they show."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1))


def labels(host: Column) -> Column:
    return F.filter(F.split(F.lower(host), r"\."), lambda x: x != "")


def registrable_domain(host: Column) -> Column:
    """The last two labels, three behind a two-level suffix; an empty host stays empty."""
    parts = labels(host)
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    return F.when(F.size(parts) < 2, F.array_join(parts, ".")).when(last(2).isin(*V.TWO_LEVEL), last(3)).otherwise(last(2))


def site(host: Column) -> Column:
    """The registrable domain: the last two labels, three behind a two-level suffix; empty for a single label."""
    suffixes = "|".join(x.replace(".", r"\.") for x in V.TWO_LEVEL)
    return F.regexp_extract(F.regexp_replace(F.lower(host), r"\.{2,}", "."), rf"(?<![^.])([^.]++\.(?:{suffixes})|[^.]++\.[^.]++)\.?$", 1)


def terms(names: Iterable[str]) -> Column:
    """A literal array of strings, made of few expressions."""
    names = list(names)
    return F.split(F.lit("\x1f".join(names)), "\x1f") if names else F.array().cast("array<string>")


def under_any(host: Column, names: Iterable[str]) -> Column:
    """The host is one of names or lies under it."""
    names = [re.escape(n) for n in names]
    return host.rlike(rf"(?:^|\.)(?:{'|'.join(names)})\z") if names else F.lit(False)


def lookalike(a: Column, b: Column) -> Column:
    """One host ends with the other and a letter or digit stands before it, so that it only looks like a subdomain."""

    def ends(x: Column, y: Column) -> Column:
        return (F.length(x) > F.length(y)) & x.endswith(y) & F.substr(x, F.length(x) - F.length(y), F.lit(1)).rlike("[a-z0-9]")

    return (a != "") & (b != "") & (a != b) & (ends(a, b) | ends(b, a))


def same_owner(a: Column, b: Column) -> Column:
    return F.split(a, r"\.")[0] == F.split(b, r"\.")[0]


def suffix_any(host: Column, names: tuple[str, ...]) -> Column:
    """The host is one of names or lies under it."""
    return under_any(host, names)


def upper_ratio(text: Column) -> Column:
    n = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / n).otherwise(0.0)


def invisible_obfuscation(text: Column) -> Column:
    return text.rlike(ZERO_WIDTH) | text.rlike(STYLED)


def leet(text: Column) -> Column:
    return F.translate(text, "01345", "olesa")


def double_extension(name: Column) -> Column:
    parts = F.split(F.lower(name), r"\.")
    return (F.size(parts) >= 3) & F.element_at(parts, -1).isin(*V.EXT_HIGH, *V.EXT_MEDIUM)


def extension(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.element_at(F.split(F.lower(name), r"\."), -1)).otherwise("")


def longest_run(text: Column, pattern: str) -> Column:
    """Length of the longest match of pattern, 0 if there is none."""
    runs = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def random_filename(stem: Column) -> Column:
    """An ASCII stem of 10 or more with both cases and a digit whose letters cannot be spoken."""
    letters = F.regexp_replace(stem, "[^A-Za-z]", "")
    vowels = F.length(F.regexp_replace(letters, "(?i)[^aeiou]", ""))
    shape = (F.length(stem) >= 10) & stem.rlike("[0-9]") & stem.rlike("[a-z]") & stem.rlike("[A-Z]") & ~stem.rlike(r"[^\x00-\x7F]")
    odd = ((vowels / F.length(letters)) < 0.30) & ~letters.rlike("(?i)[aeiou][aeiou]")
    return shape & (odd | (longest_run(stem, "(?i)[bcdfghjklmnpqrstvwxyz]+") >= 4))


def tags_removed(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(?:style|script)[^>]*>.*?</(?:style|script)>", ""), r"(?s)<[^>]+>", "")


def mechanism(header: Column, name: str) -> Column:
    """The result of an authentication mechanism in a header: pass if any is, else the first; null if there is none."""
    found = F.regexp_extract_all(F.lower(header), F.lit(rf"(?:^|[^a-z0-9-]){name}\s*=\s*([a-z]+)"), F.lit(1))
    return F.when(F.array_contains(found, "pass"), "pass").otherwise(F.get(found, F.lit(0)))


def auth_points(spf: Column, dkim: Column, dmarc: Column) -> Column:
    """4 points each for a failure, 2.4 for softfail, 1.2 for none or neutral; a missing one costs nothing; at most 12."""
    one = lambda c: F.when(c == "fail", 4.0).when(c == "softfail", 4 * 0.6).when(c.isin("none", "neutral"), 4 * 0.3).otherwise(0.0)
    return F.least(F.lit(12.0), one(spf) + one(dkim) + one(dmarc))


def verdict(score: Column) -> Column:
    return F.when(score >= V.MALICIOUS_AT, "MALICIOUS").when(score >= V.SUSPICIOUS_AT, "SUSPICIOUS").otherwise("BENIGN")


def tiers(n: Column, steps: tuple[tuple[int, int], ...]) -> Column:
    """The value of the first step that n reaches, else 0."""
    out = F.lit(0)
    for least, value in reversed(steps):
        out = F.when(n >= least, value).otherwise(out)
    return out
