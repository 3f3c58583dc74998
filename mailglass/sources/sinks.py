"""Sinks: reports, batch tables, indicator feeds, alert payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.operators.state import upsert  # noqa: F401


def write_reports(reports: DataFrame, path: str) -> None:
    """A JSON document a row, by verdict; the index is the same table."""
    reports.write.mode("append").partitionBy("verdict").json(path)


def write_batch_csv(rows: DataFrame, path: str) -> None:
    rows.select("filename", "verdict", "score", "iocs", "report_id").write.mode("overwrite").option("header", True).csv(path)


def indicator_feed(iocs: DataFrame) -> DataFrame:
    """Lines of a feed: kind, indicator, count; the most frequent first inside a kind."""
    n = iocs.groupBy("kind", "ioc").agg(F.count("*").alias("n"))
    return n.orderBy("kind", F.desc("n"), "ioc").select(F.concat_ws("\t", F.upper("kind"), "ioc", "n").alias("value"))


def alert_payload(verdict: Column, title: Column, observables: Column) -> Column:
    """The JSON of an alert; severity 4, 3, 2, 1 for malicious, suspicious, benign, spam."""
    severity = F.when(verdict == "MALICIOUS", 4).when(verdict == "SUSPICIOUS", 3).when(verdict == "SPAM", 1).otherwise(2)
    return F.to_json(F.struct(F.lit("mail-triage").alias("type"), title.alias("title"), severity.alias("severity"), observables.alias("observables")))
