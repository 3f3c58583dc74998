"""Why scored mails were missed, demoted or wrongly flagged: shares over the rows of mail_scoring.analysed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.functions import values as V
from mailglass.functions.text import verdict

#: Signals of mails that ask for credentials, which must not be demoted.
CREDENTIAL = ("body_credential_solicitation", "body_credentials", "body_credentials_no_link", "html_password_field")


def share(c: Column) -> Column:
    return F.round(F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)), 6)


def miss_causes(scored: DataFrame, bad: str) -> DataFrame:
    """One row: how many mails of the boolean column `bad` were judged BENIGN, and which share of those had no URL, attachment,
    signal or authentication header, or scored within ten of a verdict."""
    missed = scored.filter(F.col(bad) & (F.col("verdict") == "BENIGN"))
    return missed.agg(
        F.count("*").alias("missed"), share(F.size("iocs.urls") == 0).alias("no_url"), share(F.size("attachments") == 0).alias("no_attachment"), share(F.size("signals") == 0).alias("no_signal"),
        share(~F.col("auth.has_auth_header")).alias("no_auth"), share(F.col("score") >= V.SUSPICIOUS_AT - 10).alias("close"),
    )


def demotions(scored: DataFrame, credential: tuple[str, ...] = CREDENTIAL) -> DataFrame:
    """A row for each method: mails demoted to SPAM, and the share of them that pass it; `any` counts all methods. with_credential:
    demoted mails that ask for credentials, which should be none."""
    down = scored.filter("verdict = 'SPAM'").select("auth", F.exists("signals", lambda s: s["id"].isin(*credential)).alias("asks"))
    methods = ("spf", "dkim", "dmarc")
    passed = F.array(*[F.struct(F.lit(m).alias("method"), (F.col(f"auth.{m}") == "pass").alias("passed")) for m in methods], F.struct(F.lit("any").alias("method"), F.exists(F.array(*[F.coalesce(F.col(f"auth.{m}"), F.lit("")) for m in methods]), lambda r: r == "pass").alias("passed")))
    x = down.select("asks", F.explode(passed).alias("p"))
    return x.groupBy(F.col("p.method").alias("method")).agg(F.count("*").alias("demoted"), share(F.col("p.passed")).alias("passed"), F.count_if("asks").alias("with_credential"))


def leave_one_out(scored: DataFrame, bad: str) -> DataFrame:
    """A row for each signal among wrongly flagged mails (not `bad`, MALICIOUS or SUSPICIOUS): how many have it, and how many
    would not be flagged without it. A mail's parts are in `breakdown` and `signals`; nothing is scored again."""
    flagged = scored.filter(~F.col(bad) & F.col("verdict").isin("MALICIOUS", "SUSPICIOUS"))
    x = flagged.select(F.col("breakdown").alias("b"), F.explode("signals").alias("s"))
    left = F.greatest(F.col("b.raw_signals_points") - F.col("s.points"), F.lit(0.0))
    total = F.col("b.intel") + F.col("b.auth") + F.least(left, F.lit(float(V.HEURISTIC_CAP)))
    score = F.when(F.col("b.normalized"), F.bround(total / V.OFFLINE_MAX * 100)).otherwise(F.bround(total))
    return x.groupBy(F.col("s.id").alias("id")).agg(F.count("*").alias("flagged"), F.count_if(verdict(score) == "BENIGN").alias("cleared"), F.round(F.avg("s.points"), 6).alias("points"))
