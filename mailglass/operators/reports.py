"""Reports of analysed mails: the document, its page, its row in the index; look-ups of indicators and what they said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.functions import values as V
from mailglass.functions.text import terms, tiers
from mailglass.operators.mail_indicators import ioc_count

#: How a report names categories and verdicts.
CATEGORIES = {"phishing": "钓鱼/恶意", "marketing": "营销/垃圾"}
VERDICTS = {"MALICIOUS": ("#EF4444", "恶意"), "SUSPICIOUS": ("#F97316", "可疑"), "SPAM": ("#A3A3A3", "垃圾"), "BENIGN": ("#22C55E", "正常")}
#: Most URLs that a report's page lists.
PAGE_URLS = 15


def documents(mails: DataFrame, now: Column, offline: bool = True, source: str = "", trusted: tuple[str, ...] = ()) -> DataFrame:
    """A report per analysed mail. report_id follows the mail and the time, so a rerun writes the same reports."""
    label = F.concat(*[F.when(F.col("category") == k, F.lit(f"类别判定: {v}（{k}）")).otherwise("") for k, v in CATEGORIES.items()])
    reasons = F.when(label == "", F.col("reasons")).when(F.size("reasons") == 0, F.array(label)).otherwise(F.array_insert("reasons", 2, label))
    seen = F.array_distinct(F.concat("iocs.domains", "iocs.sender_domains"))
    head = lambda name: F.coalesce(F.array_join(F.element_at("headers", F.lit(name)), " "), F.lit(""))
    return mails.select(
        F.substring(F.sha2(F.concat_ws(":", "mail_id", now.cast("string")), 256), 1, 16).alias("report_id"), now.alias("created_at"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(source).alias("source"), F.lit(offline).alias("offline"),
        "score", "verdict", "category", reasons.alias("reasons"), F.col("breakdown").alias("score_breakdown"), "signals", "auth", "iocs", F.array_intersect(seen, terms(trusted)).alias("trusted_domains"), "intel", "headers",
        F.transform("attachment", lambda a: a.dropFields("filename_lower", "stem")).alias("attachments"), head("subject").alias("subject"), head("from").alias("from"), ioc_count().alias("ioc_count"),
    )


def index_rows(reports: DataFrame, folder: str) -> DataFrame:
    return reports.select("report_id", "filename", "verdict", "score", "created_at", "ioc_count", F.concat(F.lit(folder.rstrip("/") + "/"), "report_id", F.lit(".json")).alias("report_path"))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page(report: str = "") -> Column:
    """A report as a page of HTML; everything that came with the mail is escaped."""
    c = lambda name: F.col(f"{report}.{name}" if report else name)
    named = lambda i: F.coalesce(*[F.when(c("verdict") == k, F.lit(v[i])) for k, v in VERDICTS.items()], F.lit(("#94A3B8", "未知")[i]))
    items = lambda a: F.array_join(F.transform(a, lambda t: F.concat(F.lit("<li>"), escaped(t), F.lit("</li>"))), "")
    lists = [F.concat(F.lit(f"<h2>{k}</h2><ul>"), items(F.slice(c(f"iocs.{k}"), 1, PAGE_URLS) if k == "urls" else c(f"iocs.{k}")), F.lit("</ul>")) for k in ("urls", "domains", "ips", "hashes", "header_domains")]
    return F.concat(
        F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escaped(c("subject")), F.lit('</title></head><body><h1 style="color:'), named(0), F.lit('">'), named(1), F.lit(" "), c("score").cast("string"), F.lit("</h1><p>"),
        escaped(c("from")), F.lit(" — "), escaped(c("filename")), F.lit("</p><ul>"), items(c("reasons")), F.lit("</ul>"), *lists, F.lit("</body></html>"),
    )


# --- look-ups


def lookups(mails: DataFrame, trusted: tuple[str, ...] = (), caps: dict[str, int] | None = None) -> DataFrame:
    """mail_id, ioc, ioc_type, source: what is asked of which service, nothing twice a mail. Domains on the trusted list are
    not asked for. caps bounds the indicators of a kind, the first ones of a mail."""
    caps = caps or {"url": 10, "ip": 10, "hash": 10, "domain": 8}
    kinds = {"url": ("urls", ("virustotal", "urlscan")), "ip": ("ips", ("virustotal", "abuseipdb")), "hash": ("hashes", ("virustotal",)), "domain": ("domains", ("virustotal",))}
    parts = []
    for kind, (name, sources) in kinds.items():
        values = F.array_except(F.concat("iocs.domains", "iocs.sender_domains"), terms(trusted)) if kind == "domain" else F.array_distinct(f"iocs.{name}")
        parts.append(F.transform(F.slice(values, 1, caps[kind]), lambda v: F.struct(v.alias("ioc"), F.lit(kind).alias("ioc_type"), F.array(*map(F.lit, sources)).alias("sources"))))
    x = mails.select("mail_id", F.explode(F.concat(*parts)).alias("q"))
    return x.select("mail_id", "q.ioc", "q.ioc_type", F.explode("q.sources").alias("source"))


def cache_key(source: str = "source", ioc: str = "ioc") -> Column:
    return F.concat(F.lit("v2:"), F.col(source), F.lit(":"), F.col(ioc))


def from_cache(asked: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """asked with the cached result (a column `value`), null where none is left at `now`. cache: key, value, expires_at."""
    live = cache.filter(F.col("expires_at") > now).select(F.col("key").alias("_key"), "value")
    return asked.withColumn("_key", cache_key()).join(live, "_key", "left").drop("_key")


STATS = "struct<malicious:int,suspicious:int,harmless:int,undetected:int,timeout:int>"


def engine_result(response: Column, kind: Column) -> Column:
    """status, malicious_score and summary from an engine service's stored JSON answer; null: no key, `not_found`: unknown.

    Reputation (domain, ip, url) counts by the engines that find something, files by twice their share.
    """
    stats = F.from_json(F.get_json_object(response, "$.data.attributes.last_analysis_stats"), STATS[7:-1].replace(":", " ").replace(",", ", "))
    n = lambda k: F.coalesce(stats[k], F.lit(0))
    bad, total = n("malicious") + n("suspicious"), n("malicious") + n("suspicious") + n("harmless") + n("undetected") + n("timeout")
    share = F.when(total > 0, F.least(F.lit(100), F.floor(bad / total * 200))).otherwise(0).cast("int")
    score = F.when((bad <= 0) | (total == 0), 0).when(kind.isin("domain", "ip", "url"), tiers(bad, V.REPUTATION_TIERS)).otherwise(share).cast("int")
    missing = F.coalesce(F.get_json_object(response, "$.not_found") == "true", F.lit(False))
    status = F.when(response.isNull(), "no_key").when(missing, "unknown").when(bad > 0, "hit").otherwise("clean")
    told = F.when(total > 0, F.concat(bad.cast("string"), F.lit("/"), total.cast("string"), F.lit(" 引擎标记恶意"))).otherwise("无统计信息")
    return F.struct(status.alias("status"), F.when(status == "hit", score).otherwise(0).alias("malicious_score"), F.when(status.isin("hit", "clean"), told).otherwise("").alias("summary"))


def scan_score(found: Column) -> Column:
    """Of a page scanner: 60 for each scan that calls the page malicious, at most 100."""
    return F.least(F.lit(100), 60 * found)


def abuse_hit(confidence: Column) -> Column:
    """An address counts as a hit from a confidence of 50."""
    return F.coalesce(confidence >= 50, F.lit(False))
