"""State tables as DataFrames: every change gives the new table, to be written in the place of the old one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows take the place of those with the same keys (nulls equal nulls); of several new ones for a key, the one that is last
    in the order of all its other columns as JSON."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.to_json(F.struct(*others))).alias("_row")).select(*keys, "_row.*") if others else rows.distinct()
    return _without(table, rows, keys).unionByName(last, allowMissingColumns=True)


def delete(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows that have the keys of one of rows."""
    return _without(table, rows, keys)


def _without(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    gone = rows.select([F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return table.join(gone, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti")


def purge(table: DataFrame, now: Column, column: str = "expires_at") -> DataFrame:
    """table without what has expired at `now`; no expiry never does."""
    return table.filter(F.col(column).isNull() | (F.col(column) > now))


def label_senders(mails: DataFrame, verdict: str, now: Column, days: int | None = None, scope: str = "addr", note: str = "") -> DataFrame:
    """Human verdicts for every sender of mails, each once: rows for upsert(..., ["scope", "key"])."""
    key = F.col("mail.from.addr" if scope == "addr" else "mail.from.domain_reg")
    until = now + F.expr(f"INTERVAL {days} DAY") if days is not None else F.lit(None).cast("timestamp")
    x = mails.select(key.alias("key")).filter("key != ''").distinct()
    return x.select(F.lit(scope).alias("scope"), "key", F.lit(verdict).alias("verdict"), now.alias("created_at"), until.alias("expires_at"), F.lit("batch").alias("source"), F.lit(note).alias("note"))


def history_of(mails: DataFrame, at: Column) -> DataFrame:
    """addr, domain, count, first_seen, last_seen, replied, link_domains of the senders of mails."""
    x = mails.select(F.col("mail.from.addr").alias("addr"), F.col("mail.from.domain_reg").alias("domain"), F.col("mail.link_domains").alias("_links"), at.alias("_at")).filter("addr != ''")
    seen = x.groupBy("addr").agg(F.max("domain").alias("domain"), F.count("*").alias("count"), F.min("_at").alias("first_seen"), F.max("_at").alias("last_seen"), F.lit(False).alias("replied"))
    links = x.select("addr", F.explode("_links").alias("d")).distinct().groupBy("addr").agg(F.sort_array(F.collect_list("d")).alias("link_domains"))
    return seen.join(links, "addr", "left").withColumn("link_domains", F.coalesce("link_domains", F.array().cast("array<string>")))


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two histories as one; who is known by an own letter only has no domain until a mail of theirs gives it. Link domains become pairs and meet distinct, so a busy sender is no single row of lists."""
    both = old.unionByName(new)
    one = both.groupBy("addr").agg(F.max("domain").alias("domain"), F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.bool_or("replied").alias("replied"))
    links = both.select("addr", F.explode("link_domains").alias("d")).distinct().groupBy("addr").agg(F.sort_array(F.collect_list("d")).alias("link_domains"))
    return one.join(links, "addr", "left").withColumn("link_domains", F.coalesce("link_domains", F.array().cast("array<string>")))


def mark_replied(history: DataFrame, sent: DataFrame) -> DataFrame:
    """history in which the addressees of own mails count as answered; strangers get a row with no domain, no dates and no mail
    of theirs, so that a letter to them widens nobody's trust."""
    to = F.concat(*[F.coalesce(F.regexp_extract_all(F.lower(F.array_join(F.element_at("headers", F.lit(h)), " ")), F.lit(r"[\w.+-]+@[a-z0-9.-]+\.[a-z]{2,}"), F.lit(0)), F.array().cast("array<string>")) for h in ("to", "cc")])
    who = sent.select(F.explode(to).alias("addr")).distinct()
    when = F.lit(None).cast("timestamp")
    fresh = who.select("addr", F.lit("").alias("domain"), F.lit(0).cast("long").alias("count"), when.alias("first_seen"), when.alias("last_seen"), F.lit(True).alias("replied"), F.array().cast("array<string>").alias("link_domains"))
    return merge_history(history, fresh)


def not_counted(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (path) that the ledger (path, counted_at) does not have yet."""
    return files.join(ledger.select("path"), "path", "left_anti")


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: count, newest change, bytes and a digest of all paths, which together tell whether a rebuild is due.

    The digest adds up per-path hashes, so no task sorts or joins the paths.
    """
    h = F.conv(F.substring(F.sha1(F.concat_ws("|", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string"))), 1, 12), 16, 10).cast("decimal(20,0)")
    digest = F.lower(F.lpad(F.hex((F.sum(h) % F.lit(1 << 48)).cast("long")), 12, "0"))
    x = files.agg(F.count("*").alias("n"), F.max(F.unix_timestamp("modificationTime")).alias("newest"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(digest, F.lit("0" * 12)).alias("digest"))
    return x.select(F.concat_ws(":", "n", F.coalesce("newest", F.lit(0)), "bytes", "digest").alias("fingerprint"))


def self_sent(mails: DataFrame, own: tuple[str, ...], sent_folders: tuple[str, ...] = ()) -> Column:
    """Whether a mail is one's own: it lies in a folder of sent mail, or From, Sender or Return-Path is an own address."""
    from mailglass.operators.mail_indicators import every

    own = tuple(o.lower() for o in own)
    text = F.lower(F.concat_ws(" ", every("from"), every("sender"), every("return-path")))
    addresses = F.regexp_extract_all(text, F.lit(r"[\w.+-]+@[a-z0-9.-]+"), F.lit(0))
    mine = F.exists(addresses, lambda a: a.isin(*own)) if own else F.lit(False)
    return F.coalesce(mine, F.lit(False)) | (F.element_at(F.split("path", "/"), -2).isin(*sent_folders) if sent_folders else F.lit(False))


def newest_by_uid(mails: DataFrame) -> DataFrame:
    """Mails (folder, uid, ...) each once: of several rows of one uid, that of the greatest uidvalidity, and of equal ones the
    last in the order of all columns as JSON."""
    w = Window.partitionBy("folder", "uid").orderBy(F.desc("uidvalidity"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in mails.columns])).desc())
    return mails.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def alert_key() -> Column:
    """Whom or what a report's alert is about: the sender's address, else the file."""
    addr = F.lower(F.regexp_extract(F.coalesce("from", F.lit("")), r"[\w.+-]+@[\w.-]+", 0))
    return F.when(addr != "", F.concat(F.lit("addr:"), addr)).otherwise(F.concat(F.lit("file:"), F.coalesce("filename", "report_id", F.lit("?"))))


def alert_round(reports: DataFrame, state: DataFrame, now: Column, hours: int = 12, most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a round of reports pushes: (alerts, summary, new state).

    Only MALICIOUS and SUSPICIOUS mails, none of a sender alerted in the last `hours`. The first `most` in order of reports
    are pushed, a summary counts the others; all of them are marked. state: key, last_at.
    """
    x = reports.filter(F.col("verdict").isin("MALICIOUS", "SUSPICIOUS")).withColumn("key", alert_key())
    recent = state.filter(F.col("last_at") > now - F.expr(f"INTERVAL {hours} HOUR")).select("key")
    x = x.join(recent, "key", "left_anti")
    first = x.orderBy("created_at", "report_id").limit(most)
    alerts = first.select("key", "verdict", "score", "subject", "from", "report_id")
    summary = x.agg((F.count("*") - most).alias("others")).filter("others > 0")
    marks = x.select("key", now.alias("last_at")).distinct()
    return alerts, summary, upsert(state, marks, ["key"])
