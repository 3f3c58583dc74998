"""Watching a folder for mail: a file stream, scored in micro-batches whose progress the checkpoint keeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailglass.operators.mail_scoring import analysed
from mailglass.rulebook import Rulebook
from mailglass.sources.mail import MAX_BYTES, parse_mails

MESSAGES = "path string, modificationTime timestamp, length long, content binary"


def mail_stream(spark: SparkSession, folder: str, per_round: int = 200, max_bytes: int = MAX_BYTES) -> DataFrame:
    """New .eml files as mails, at most per_round of them in a micro-batch. Of larger ones than max_bytes path and size stay."""
    files = spark.readStream.format("binaryFile").schema(MESSAGES).option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_round).load(folder)
    large = files.filter(F.col("length") > max_bytes).select("path", F.col("length").alias("raw_size"))
    return parse_mails(files.filter(F.col("length") <= max_bytes)).unionByName(large, allowMissingColumns=True)


def run_watch(mails: DataFrame, on_round: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Hands each micro-batch to on_round; progress moves on only after it has returned, so a failed round comes again.

    interval: of processing time; without one, what is there is worked off and the query ends.
    """
    w = mails.writeStream.foreachBatch(on_round).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def verdict_stream(spark: SparkSession, folder: str, book: Rulebook, per_round: int = 200, max_bytes: int = MAX_BYTES, profile: str = "gateway") -> DataFrame:
    """New .eml files as scored mails: score, verdict, category, signals and reasons, each once; a mail that lies in the
    folder under several names is scored under each."""
    x = analysed(mail_stream(spark, folder, per_round, max_bytes), book, profile=profile)
    return x.select("path", "mail_id", "mail.from.addr", "score", "verdict", "category", "signals", "reasons", "ioc_count")


def alerts(events: DataFrame, window: str = "12 hours", late: str = "1 day") -> DataFrame:
    """One row a sender and window of event time from a stream of (addr, ts, verdict): its worst verdict, when the first such
    mail came, and how many bad mails there are."""
    bad = events.filter(F.col("verdict").isin("MALICIOUS", "SUSPICIOUS")).withWatermark("ts", late)
    return bad.groupBy(F.window("ts", window).alias("slot"), "addr").agg(F.min(F.struct("verdict", "ts")).alias("_w"), F.count("*").alias("mails")).select("slot", "addr", F.col("_w.verdict").alias("verdict"), F.col("_w.ts").alias("first"), "mails")


def sender_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Mails by sender and day of event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "addr").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
