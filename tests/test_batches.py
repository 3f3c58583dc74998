"""Whole texts reach Python in batches that are bounded by bytes, whatever the number of rows."""

import pandas as pd
from pyspark.sql import functions as F

from mailglass.functions import folding
from mailglass.functions.batches import BATCH_BYTES, BATCH_SETTING
from mailglass.operators import attachments, mail_texts
from mailglass.plans.mails import book
from mailglass.sources.mail import parse_mails


def largest_batch(spark):
    """Characters of the largest batch of 40 texts of half a megabyte in one partition, under the session's settings."""

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    rows = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 19).alias("text"))
    return rows.select(size("text").alias("n")).agg(F.max("n")).first()[0]


def test_folding_bounds_batches(spark):
    spark.conf.unset(BATCH_SETTING)
    folding.fold_text(F.col("text"))
    assert largest_batch(spark) <= BATCH_BYTES + (1 << 19)


def test_restoring_bounds_batches(spark):
    spark.conf.unset(BATCH_SETTING)
    folding.refang(F.col("text"))
    assert largest_batch(spark) <= BATCH_BYTES + (1 << 19)


def test_reading_mails_bounds_batches(spark):
    passes = (
        lambda: mail_texts.read_texts({p: F.col("text") for p in mail_texts.GIVEN}, book()),
        lambda: mail_texts.otp_notice(F.col("text"), book()),
        lambda: attachments.inspect_all(F.col("files"), F.col("words")),
        lambda: parse_mails(spark.createDataFrame([], "path string, content binary")),
    )
    for make in passes:
        spark.conf.unset(BATCH_SETTING)
        make()
        assert largest_batch(spark) <= BATCH_BYTES + (1 << 19)


def test_pandas_functions_get_a_megabyte(spark):
    for make in (lambda: folding.refang(F.col("text")), lambda: mail_texts.otp_notice(F.col("text"), book())):
        spark.conf.unset(BATCH_SETTING)
        make()
        assert largest_batch(spark) <= (1 << 20) + (1 << 19)
