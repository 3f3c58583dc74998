"""Alerts of a watched folder with state from round to round: who was alerted in the last hours is known across restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from mailglass.operators.state import alert_key
from mailglass.sources.state_tables import StateTables

#: Columns that an alert is made from, and the key and round it belongs to.
REPORT = "report_id string, filename string, `from` string, subject string, verdict string, score int, created_at timestamp"
#: How far the rounds' clock may seem to go back between tasks.
SLACK = "1 hour"
CANDIDATE = f"{REPORT}, key string, now timestamp"


def alert_candidates(reports: DataFrame, hours: int = 12, clock: Column | None = None) -> DataFrame:
    """Of a stream of reports (REPORT) those to alert on: MALICIOUS and SUSPICIOUS, of no key (sender, else file) that had one
    in the last `hours` before this round; mails of one key in one round do not hide each other. 0 hours: all.

    A key's state is the time of its last alert; a timer forgets it when it can no longer hide one. clock: the time of a row's
    round, which must not go back, by default that of the micro-batch; timers follow it.
    """
    bad = reports.filter(F.col("verdict").isin("MALICIOUS", "SUSPICIOUS")).withColumns({"key": alert_key(), "now": F.current_timestamp() if clock is None else clock}).withWatermark("now", SLACK)

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        newest = None
        for p in parts:
            now = p["now"].max()
            if last is None or hours <= 0 or last <= (now - pd.Timedelta(hours=hours)).timestamp():
                newest = now if newest is None else max(now, newest)
                yield p
        if newest is not None:
            state.update((newest.timestamp(),))
            state.setTimeoutTimestamp(int((newest.timestamp() + hours * 3600) * 1000) + 1)
        elif last is not None:
            state.setTimeoutTimestamp(int((last + hours * 3600) * 1000) + 1)

    rows = bad.selectExpr("report_id", "filename", "`from`", "subject", "verdict", "score", "created_at", "key", "now")
    return rows.groupBy("key").applyInPandasWithState(decide, CANDIDATE, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def pushed(candidates: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(alerts, summary) of a round's candidates: the first `most` in order of reports, and how many others there are."""
    alerts = candidates.orderBy("created_at", "report_id").limit(most).select("key", "verdict", "score", "subject", "from", "report_id")
    return alerts, candidates.agg((F.count("*") - most).alias("others")).filter("others > 0")


def run_alerts(reports: DataFrame, push: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, hours: int = 12, most: int = 3, clock: Column | None = None, interval: str | None = None) -> StreamingQuery:
    """Hands each round's alerts and summary to `push` with the number of the round. A round that fails comes again with the
    same number, so what pushes must take a number twice without harm. interval: as in watch.run_watch."""

    def on_round(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():  # batches without rows only move the timers
                push(*pushed(batch, most), number)
        finally:
            batch.unpersist()

    w = alert_candidates(reports, hours, clock).writeStream.outputMode("append").foreachBatch(on_round).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


# --- the last events of each folder

EVENT = "folder string, at timestamp, kind string, text string, round long"


def newest_events(old: DataFrame, new: DataFrame, keep: int = 300) -> DataFrame:
    """EVENT: of old and new events the newest `keep` of each folder. Tasks keep their own newest before events are shuffled, so
    a busy folder is no single task of all its events."""
    by = Window.partitionBy("folder").orderBy(F.desc("at"), F.desc("round"), "kind", "text")
    return old.unionByName(new).withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= keep).drop("_n")


def keep_events(tables: StateTables, batch: DataFrame, number: int, keep: int = 300) -> None:
    """Put a round's events (folder, at, kind, text) into the table `events`; a round that comes again changes nothing."""
    base = tables.manifest()["version"]
    old = tables.read("events", base)
    if (old.agg(F.max("round")).first()[0] if base else None) is None or old.filter(F.col("round") >= number).isEmpty():
        tables.commit({"events": newest_events(old, batch.withColumn("round", F.lit(number).cast("long")), keep)}, base)
