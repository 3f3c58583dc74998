"""Rebuilding sender history and analysing landed mail, without doing again what has not changed.

Ledger, fingerprint, history and statistics change in one commit of the state tables, so a run that dies leaves the version
before, and the next run counts the same files again, each once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.functions.dates import seen_at
from mailglass.functions.text import site
from mailglass.operators.mail_indicators import every, header, link_host, with_indicators
from mailglass.operators.mail_scoring import analysed
from mailglass.operators.state import fingerprint, merge_history, not_counted, self_sent
from mailglass.rulebook import Rulebook
from mailglass.sources.mail import parse_mails
from mailglass.sources.state_tables import StateTables

ADDRESS = r"[\w.+-]+@[a-z0-9.-]+"
MailsOf = Callable[[DataFrame], DataFrame]


def traces(mails: DataFrame, own: tuple[str, ...], sent_folders: tuple[str, ...], now: Column) -> DataFrame:
    """What each mail (with iocs) leaves in the history: path, addr, domain, at, links of a mail received; to of one sent."""
    mine = self_sent(mails, own, sent_folders)
    addr = F.regexp_extract(F.lower(every("from")), ADDRESS, 0)
    links = F.array_distinct(F.filter(F.transform("iocs.urls", lambda u: site(link_host(u))), lambda d: d != ""))
    to = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.concat_ws(" ", every("to"), every("cc"))), F.lit(ADDRESS), F.lit(0)), lambda a: ~a.isin(*own) if own else F.lit(True)))
    none = F.array().cast("array<string>")
    return mails.select("path", F.when(~mine & (addr != ""), addr).alias("addr"), site(F.substring_index(addr, "@", -1)).alias("domain"), seen_at(header("date"), now).alias("at"), links.alias("links"), F.when(mine, to).otherwise(none).alias("to"))


def history_of_traces(left: DataFrame) -> DataFrame:
    """The history that traces alone make: senders of received mails, and addressees of sent ones as answered, who have no
    domain and no dates until they write."""
    got = left.filter("addr is not null")
    seen = got.groupBy("addr").agg(F.max("domain").alias("domain"), F.count("*").alias("count"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    pairs = got.select("addr", F.explode("links").alias("d")).distinct().groupBy("addr").agg(F.sort_array(F.collect_list("d")).alias("link_domains"))
    none = F.array().cast("array<string>")
    received = seen.join(pairs, "addr", "left").select("addr", "domain", "count", "first_seen", "last_seen", F.lit(False).alias("replied"), F.coalesce("link_domains", none).alias("link_domains"))
    when = F.lit(None).cast("timestamp")
    answered = left.select(F.explode("to").alias("addr")).distinct().select("addr", F.lit("").alias("domain"), F.lit(0).cast("long").alias("count"), when.alias("first_seen"), when.alias("last_seen"), F.lit(True).alias("replied"), none.alias("link_domains"))
    return merge_history(received, answered)


def rebuild_history(tables: StateTables, key: str, files: DataFrame, own: tuple[str, ...] = (), sent_folders: tuple[str, ...] = (), incremental: bool = False, force: bool = False, now: Column | None = None, mails_of: MailsOf = parse_mails) -> dict:
    """Bring `sender_history` up to date with files (path, modificationTime, length and what mails_of needs) and say what was
    done: files, processed, inbound, replied_marks, skipped.

    Files whose fingerprint is that of the last run under `key` are not opened. Otherwise all of them are counted anew, or,
    incremental, those that the ledger does not have are added to the history (a file that has gone keeps its part). force:
    neither fingerprint nor ledger is heeded. own and sent_folders tell mails that were sent, whose addressees count as answered.
    """
    now = F.current_timestamp() if now is None else now
    base = tables.manifest()["version"]
    mark = fingerprint(files).first()[0]
    last = tables.read("trust_state", base).filter(F.col("root") == key).first()
    if last is not None and last.fingerprint == mark and not force:
        return {"files": last.files, "inbound": last.inbound, "replied_marks": last.replied_marks, "processed": 0, "skipped": True}
    more = incremental and not force
    ledger = tables.read("trust_files", base)
    todo = not_counted(files, ledger) if more else files
    work = f"{tables.root}/work-{uuid.uuid4().hex}"
    # Mails are parsed once; what they leave is narrow and read three times.
    kept = traces(with_indicators(mails_of(todo)), own, sent_folders, now)
    kept.write.parquet(work)
    left = tables.spark.read.schema(kept.schema).parquet(work)
    counts = left.agg(F.count("*").alias("processed"), F.count("addr").alias("inbound"), F.coalesce(F.sum(F.size("to")), F.lit(0)).alias("replied_marks")).first().asDict()
    history = history_of_traces(left)
    n = files.count()
    state = tables.spark.range(1).select(F.lit(key).alias("root"), F.lit(mark).alias("fingerprint"), F.lit(n).cast("long").alias("files"), F.lit(counts["inbound"]).cast("long").alias("inbound"), F.lit(counts["replied_marks"]).cast("long").alias("replied_marks"), now.alias("updated_at"))
    others = tables.read("trust_state", base).filter(F.col("root") != key)
    counted = todo.select("path", now.alias("counted_at"))
    if more:
        history, counted = merge_history(tables.read("sender_history", base), history), ledger.unionByName(counted)
    tables.commit({"sender_history": history, "trust_files": counted, "trust_state": others.unionByName(state)}, base)
    tables.remove(work)
    return {"files": n, **counts, "skipped": False}


def analyse_landed(tables: StateTables, files: DataFrame, book: Rulebook, full: bool = False, own: tuple[str, ...] = (), sent_folders: tuple[str, ...] = (), now: Column | None = None, mails_of: MailsOf = parse_mails, **options) -> dict:
    """Score landed mails (all, or those without a report yet) and commit their reports: files, analysed.

    Mails that were sent are left out: they get no report, and are parsed again by the next run. options: of analysed().
    """
    now = F.current_timestamp() if now is None else now
    base = tables.manifest()["version"]
    old = tables.read("reports", base)
    todo = files if full else files.join(old.select("path"), "path", "left_anti")
    mails = mails_of(todo)
    x = analysed(mails.filter(~self_sent(mails, own, sent_folders)), book, **options)
    rows = x.select(F.sha2(F.concat_ws("|", "path", "mail_id"), 256).substr(1, 16).alias("report_id"), "path", "score", "verdict", "category", F.transform("signals", lambda s: s["id"]).alias("signals"), F.col("ioc_count").cast("int").alias("ioc_count"), now.alias("created_at"))
    version = tables.commit({"reports": rows if full else old.unionByName(rows)}, base)
    after = tables.read("reports", version).count()
    return {"files": files.count(), "analysed": after - (0 if full else old.count())}
