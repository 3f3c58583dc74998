"""Dates of mail headers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months, and zones that have a name, in minutes from UTC. Other names say nothing and stand for UTC.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "ast": -240, "adt": -180}
#: day, month, year, hour, minute, second, zone; a weekday before and comments anywhere are passed over.
DATE = r"(?i)^\s*(?:[a-z]{3,9}\.?\s*,?\s+)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*\.?[\s,-]+(\d{2,4})[\s,]+(\d{1,2})[:.](\d{2})(?:[:.](\d{2}))?(?:\s*([+-]\d{4}|[a-z]{1,5})\b)?"


def mail_date(header: Column) -> Column:
    """The moment that a Date header names, as a timestamp (of UTC, whatever the session's zone); null if it names none.

    Years of two digits lie between 1969 and 2068, of three digits count from 1900. A missing or unknown zone is UTC.
    """
    text = F.regexp_replace(F.coalesce(header, F.lit("")), r"\([^()]*\)", " ")
    part = lambda i: F.regexp_extract(text, DATE, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(2))).cast("int")
    year, digits = part(3).try_cast("int"), F.length(part(3))
    year = F.when(digits == 2, F.when(year < 69, year + 2000).otherwise(year + 1900)).when(digits == 3, year + 1900).otherwise(year)
    zone = F.lower(part(7))
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 4, 2).try_cast("int")
    named = F.coalesce(*[F.when(zone == k, F.lit(v)) for k, v in ZONES.items()], F.lit(0))
    offset = F.when(zone.rlike("^[+-]"), F.when(zone.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes)).otherwise(named)
    second = F.least(F.coalesce(part(6).try_cast("int"), F.lit(0)), F.lit(59))
    day, hour, minute = (part(i).try_cast("int") for i in (1, 4, 5))
    valid = (part(1) != "") & (month > 0) & (hour < 24) & (minute < 60) & (F.coalesce(minutes, F.lit(0)) < 60)
    days = F.unix_date(F.when(valid, F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")))
    return F.timestamp_seconds(days.cast("long") * 86400 + hour * 3600 + (minute - offset) * 60 + second)


def seen_at(header: Column, now: Column) -> Column:
    """mail_date, or `now` where the header names no moment."""
    return F.coalesce(mail_date(header), now)
