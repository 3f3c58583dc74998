"""Names as columns: folders in modified UTF-7, files that any system takes, entries of domain lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailglass.functions.text import let, site

#: The shape of a host in a list; what Windows keeps for itself.
LISTED = r"^(?:\*\.)?([a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+)$"
FORBIDDEN = r'[\\/:*?"<>|\x00-\x1F\x7F]'
FILE_NAME_LENGTH, BROKEN_SHARE = 80, 0.3


def folder_encoded(name: Column) -> Column:
    """A folder's name in modified UTF-7: printable ASCII as it is, & as &-, runs of others as base64 of UTF-16 between & and -."""
    runs = F.regexp_extract_all(name, F.lit(r"[\x20-\x7E]+|[^\x20-\x7E]+"), F.lit(0))
    packed = lambda r: F.translate(F.regexp_replace(F.base64(F.encode(r, "UTF-16BE")), r"[=\r\n]", ""), "/", ",")
    one = lambda r: F.when(r.rlike(r"^[\x20-\x7E]"), F.replace(r, F.lit("&"), F.lit("&-"))).otherwise(F.concat(F.lit("&"), packed(r), F.lit("-")))
    return F.array_join(F.transform(runs, one), "")


def folder_decoded(name: Column) -> Column:
    """The name that a modified UTF-7 text stands for; a text with a part that is none stays as it is, an & that nothing closes
    stands for itself."""
    runs = F.regexp_extract_all(name, F.lit(r"&[^-]*-|[^&]+|&[^-]*$"), F.lit(0))

    def one(r: Column) -> Column:
        body = F.translate(F.substring(r, F.lit(2), F.length(r) - 2), ",", "/")
        raw = F.try_to_binary(F.rpad(body, F.greatest(F.ceil(F.length(body) / 4) * 4, F.lit(0)).cast("int"), "="), F.lit("base64"))
        whole = F.hex(raw).rlike("^(?:(?!D[89A-F])[0-9A-F]{4}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})+$")
        return F.when(~(r.startswith("&") & r.endswith("-")), r).when(r == "&-", F.lit("&")).when(whole, F.decode(F.when(whole, raw), "UTF-16BE"))

    parts = F.transform(runs, one)
    return F.coalesce(let(parts, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.array_join(p, ""))), name)


def safe_file_name(name: Column, fallback: Column) -> Column:
    """The name without what paths or systems forbid, runs of white space as one space, at most 80 characters and no dot or
    space at its ends; the fallback if nothing is left or more than three in ten characters are lost ones (U+FFFD)."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), FORBIDDEN, "_"), r"(?U)\s+", " ")
    cut = F.regexp_replace(F.substring(F.regexp_replace(clean, r"^[. ]+|[. ]+$", ""), 1, FILE_NAME_LENGTH), r"[. ]+$", "")
    lost = F.length(F.regexp_replace(cut, "[^�]", ""))
    return F.when((cut == "") | (lost > BROKEN_SHARE * F.length(cut)), fallback).otherwise(cut)


def listed_host(entry: Column) -> Column:
    """The host that an entry of a list names, in lower case, without dots at its ends and a wildcard; empty if it names none."""
    bare = F.regexp_replace(F.lower(F.trim(entry)), r"^\.+|\.+$", "")
    return F.coalesce(F.regexp_extract(bare, LISTED, 1), F.lit(""))


def listed_domain(entry: Column) -> Column:
    """The registrable domain of an entry, which lists are compared by; empty if it names none."""
    return F.when(listed_host(entry) == "", F.lit("")).otherwise(site(listed_host(entry)))
