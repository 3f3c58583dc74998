"""Arrow batches between Spark and Python are bounded by bytes: a row holds whole texts, so a count of rows bounds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of an Arrow batch, and the setting that says so. A larger row is a batch of its own, whole.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: The same for pandas functions, which hold a batch as Arrow, as Python's strings, and as results at once.
UDF_BYTES = 1 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded by BATCH_BYTES."""
    df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def by_arrow(kind: str | T.DataType) -> Callable:
    """F.pandas_udf, with the active session's Arrow batches bounded by UDF_BYTES."""
    SparkSession.active().conf.set(BATCH_SETTING, str(UDF_BYTES))
    return F.pandas_udf(kind)
