"""Queries over whole mails, from headers and bodies to verdicts. The mails come from pages and documents: a page is a mail's
HTML, the document of the same number its text, headers and attachments follow from both."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass import rulebook
from mailglass.functions.text import site
from mailglass.operators import attribution, mail_scoring, reports, state, trust
from mailglass.operators.mail_features import with_features
from mailglass.operators.mail_indicators import every, ioc_count, link_host, with_authentication, with_indicators
from mailglass.plans.registry import query, spread, table
from mailglass.rulebook import Rulebook

#: Headers by the page's number, the same in both engines.
FROM = "CASE page_id % 5 WHEN 0 THEN concat('Shop <news@', host, '>') WHEN 1 THEN concat('\"PayPal Support\" <a', page_id, '@gmail.com>') WHEN 2 THEN concat('no-reply@mail.', host) WHEN 3 THEN concat('IT DESK TEAM <u', page_id, '20268@', coalesce(source, 'none'), '.example.top>') ELSE '' END"
REPLY = "CASE page_id % 3 WHEN 0 THEN concat('r', page_id, '@outlook.com') WHEN 1 THEN concat('help@', host) END"
AUTH = "CASE page_id % 4 WHEN 0 THEN concat('mx; spf=pass smtp.mailfrom=news@', host, '; dkim=pass; dmarc=pass') WHEN 1 THEN 'mx; spf=fail smtp.mailfrom=x@evil.example; dkim=none; dmarc=fail' WHEN 2 THEN 'mx; spf=softfail; dkim=none; dmarc=pass' END"
LURE = "CASE page_id % 6 WHEN 1 THEN concat('\\nPlease verify your identity within 24 hours: http://203.0.113.9/x', page_id) WHEN 2 THEN concat('\\nUnsubscribe: https://bit.ly/u', page_id) WHEN 3 THEN '\\n您的验证码是 483920，5分钟内有效' ELSE '' END"


@cache
def book() -> Rulebook:
    return rulebook.builtin()


def mails(spark: SparkSession, folder: str, told: DataFrame | None = None) -> DataFrame:
    """The tables' pages and documents as rows of sources.mail. told: columns by page_id that go with them; pages without a row
    of it are none."""
    p = table(spark, folder, "pages").select("page_id", "url", "html")
    p = spread(p if told is None else p.join(told, "page_id"))
    more = [] if told is None else [c for c in told.columns if c != "page_id"]
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), "text", "source")
    x = p.join(d, "page_id", "left").withColumn("host", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    some = lambda sql: F.filter(F.array(F.expr(sql)), lambda v: v.isNotNull() & (v != ""))
    headers = F.map_filter(F.create_map(*[c for k, v in (("from", some(FROM)), ("reply-to", some(REPLY)), ("to", F.array(F.lit("li@corp.example.com"))), ("subject", F.array(F.substring(F.coalesce("text", "url"), 1, 60))), ("list-unsubscribe", some("CASE WHEN page_id % 7 = 0 THEN concat('<https://', host, '/out>') END"))) for c in (F.lit(k), v)]), lambda k, v: F.size(v) > 0)
    body = F.concat(F.coalesce("text", F.lit("")), F.expr(LURE.replace("\\n", "\\\\n").replace("\\\\\\\\n", "\\\\n")))
    content = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit(b"MZ"), F.col("html").cast("binary"))).when(F.col("page_id") % 11 == 1, F.col("html").cast("binary"))
    name = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("Invoice_"), F.col("page_id").cast("string"), F.lit(".pdf.exe"))).otherwise("form.html")
    kind = F.when(F.col("page_id") % 11 == 0, "application/octet-stream").otherwise("text/html")
    file = F.struct(F.lit(0).alias("idx"), name.alias("filename"), kind.alias("content_type"), F.length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"), F.element_at(F.split(name, r"\."), -1).alias("extension"), content.alias("content"))
    files = F.filter(F.array(F.when(content.isNotNull(), file)), lambda f: f.isNotNull())
    path = F.concat(F.lit("/inbox/"), F.col("page_id").cast("string"), F.lit(".eml"))
    return x.select("page_id", path.alias("path"), F.col("page_id").cast("string").alias("mail_id"), F.length("html").cast("long").alias("raw_size"), headers.alias("headers"), some(AUTH).alias("auth_results"), body.alias("body_text"), F.coalesce("html", F.lit("")).alias("body_html"), files.alias("attachments"), F.lit(0).alias("inline_images"), *more)


HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host"
BASE_SQL = f"x AS (SELECT p.page_id, p.url, p.html, d.text, d.source, {HOST} FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id)"
DOMAIN = lambda c: f"nullif(lower(regexp_extract({c}, '@([A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})', 1)), '')"


@query(f"""WITH {BASE_SQL}, h AS (SELECT page_id, {AUTH} AS a, {FROM} AS f, {REPLY} AS r FROM x)
SELECT page_id, nullif(regexp_extract(a, 'spf=([a-z]+)', 1), '') AS spf, nullif(regexp_extract(a, 'dkim=([a-z]+)', 1), '') AS dkim, nullif(regexp_extract(a, 'dmarc=([a-z]+)', 1), '') AS dmarc,
  a IS NOT NULL AS has_auth_header, {DOMAIN("f")} AS from_domain, {DOMAIN("r")} AS reply_to_domain, nullif(regexp_extract(a, 'smtp\\.mailfrom=[^@;]*@([A-Za-z0-9.-]+)', 1), '') AS smtp_mail_domain FROM h""")
def mail_authentication(spark: SparkSession, folder: str) -> DataFrame:
    """Results over all headers, and the domains that take part."""
    x = with_authentication(mails(spark, folder))
    return x.select("page_id", *[F.col(f"auth.{k}").alias(k) for k in ("spf", "dkim", "dmarc", "has_auth_header", "from_domain", "reply_to_domain", "smtp_mail_domain")])


@query()
def mail_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """All seven lists of every mail, and their count."""
    return with_indicators(mails(spark, folder)).select("page_id", "iocs.*", ioc_count().cast("long").alias("ioc_count"))


@query()
def mail_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the mail scope that are no texts."""
    x = with_features(with_authentication(with_indicators(mails(spark, folder))), book())
    return x.select("page_id", "mail.from.*", *[F.col(f"mail.{k}").alias(k) for k in ("url_count", "attachment_count", "link_domains", "link_domain_lookalike", "link_domain_mismatch", "user_content_link", "text_brand_hits", "otp_notice", "hidden_html_text_len", "esp_domain")])


def analysed(spark: SparkSession, folder: str) -> DataFrame:
    return mail_scoring.analysed(mails(spark, folder), book())


@query()
def mail_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Score, verdict, category, signals and reasons of every mail."""
    x = analysed(spark, folder)
    return x.select("page_id", "score", "verdict", "category", F.array_join(F.transform("signals", lambda s: F.concat_ws(":", s["id"], s["points"].cast("int"))), ",").alias("signals"), F.array_join("reasons", "\n").alias("reasons"))


@query()
def mail_trust(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts after trust, with the history of these mails themselves and verdicts on two senders."""
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id % 30 AS int))")
    seen = with_indicators(mails(spark, folder))
    addr = F.lower(F.regexp_extract(every("from"), r"[^<\s]+@[^>\s]+", 0))
    sender = F.struct(addr.alias("addr"), site(F.substring_index(addr, "@", -1)).alias("domain_reg"))
    # The history needs the senders and links only, not the features.
    past = state.history_of(seen.select("page_id", F.struct(sender.alias("from"), F.array_distinct(F.transform("iocs.urls", lambda u: site(link_host(u)))).alias("link_domains")).alias("mail")), at)
    x = mail_scoring.with_signals(with_features(with_authentication(seen), book()), book())
    x = x.select("page_id", "mail_id", "path", "headers", "auth", "iocs", "mail", "attachment", "signals")
    said = spark.createDataFrame([("addr", "a1@gmail.com", "benign", None, ""), ("domain", "web.example.top", "phishing", None, "")], "scope string, key string, verdict string, expires_at timestamp, note string")
    return mail_scoring.scored(trust.with_trust(x, past, said, book(), F.expr("timestamp'2024-02-01 00:00:00'"))).select("page_id", "trust_tier", "score", "verdict")


@query()
def mail_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Report documents with their pages and index rows."""
    r = reports.documents(analysed(spark, folder), F.expr("timestamp'2024-01-01 00:00:00'"))
    return r.select("report_id", "filename", "verdict", "score", "ioc_count", F.to_json(F.struct("category", "reasons", "auth", "iocs")).alias("document"), F.length(reports.page()).alias("page_chars"))


@query()
def mail_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """What would be asked of which service, trusted hosts left out."""
    return reports.lookups(with_indicators(mails(spark, folder)), trusted=("bit.ly",))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Scored mails with `bad`: a page whose document is labelled 0 stands for a bad mail; without a label it is neither. Labels
    are met before mails are scored, and what is asked of `bad` alone is asked there too."""
    l = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return mail_scoring.analysed(mails(spark, folder, l), book())


@query()
def mail_misses(spark: SparkSession, folder: str) -> DataFrame:
    """What bad mails that were judged BENIGN lack."""
    return attribution.miss_causes(labelled(spark, folder), "bad")


@query()
def mail_demotions(spark: SparkSession, folder: str) -> DataFrame:
    """Authentication of demoted mails, and those among them that ask for credentials."""
    return attribution.demotions(analysed(spark, folder))


@query()
def mail_leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of scored mails that were flagged wrongly, and how many each alone has flagged."""
    return attribution.leave_one_out(labelled(spark, folder), "bad")
