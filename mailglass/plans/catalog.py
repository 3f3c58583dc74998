"""All registered queries of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailglass.plans import content, features, indicators, mails, rebuild, reports, scoring, state
from mailglass.plans.registry import QUERIES, Query

_MODULES = (scoring, indicators, state, content, reports, features, mails, rebuild)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_signals(spark, folder)


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s}
