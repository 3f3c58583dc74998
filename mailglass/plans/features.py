"""Feature queries: brands, codes, agents, sender keys, sets of links, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailglass.functions import text as X
from mailglass.operators.mail_features import PROGRAMS, junk_program
from mailglass.plans.registry import query, table
from mailglass.plans.state import events

#: Words of the texts that stand for brands here, and hosts on an allow list.
BRANDS = ("apache", "license", "that")
ALLOWED = ("example.com", "example.net")

_HOST = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"


@query(
    "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){b}([^a-z0-9]|$)') THEN '{b}' END" for b in BRANDS) + "], lambda x: x IS NOT NULL), ',') AS brands FROM documents"
)
def brand_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """F19 for ASCII brands: a mention stands between characters that are no ASCII letters or digits."""
    low = F.lower("text")
    hits = [F.when(low.rlike(f"(?<![a-z0-9]){b}(?![a-z0-9])"), F.lit(b)) for b in BRANDS]
    return table(spark, folder, "documents").select("doc_id", F.array_join(F.filter(F.array(*hits), lambda x: x.isNotNull()), ",").alias("brands"))


@query(f"""SELECT page_id, host, NOT (host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.net' OR ends_with(host, '.example.net')) AND NOT contains(host, 'th') AS brandless FROM (SELECT page_id, {_HOST} AS host FROM pages)""")
def brandless_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts that are neither allowed nor hold a brand's name."""
    h = F.col("host")
    p = table(spark, folder, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))
    return p.select("page_id", "host", (~X.suffix_any(h, ALLOWED) & ~h.contains("th")).alias("brandless"))


@query(r"""SELECT doc_id, regexp_matches(lower(text), '(password|token|secret)[\s\S]{0,80}?[a-z0-9]*[0-9][a-z0-9]*') AS near_code FROM documents""")
def code_notice(spark: SparkSession, folder: str) -> DataFrame:
    """a key word with a code within 80 characters behind it."""
    return table(spark, folder, "documents").select("doc_id", F.lower("text").rlike(r"(password|token|secret)[\s\S]{0,80}?[a-z0-9]*[0-9][a-z0-9]*").alias("near_code"))


_AGENT = "concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ' ', p_brand, ' ', CASE p_partkey % 4 WHEN 0 THEN 'Outlook Express' WHEN 1 THEN 'Qwzr 3.1' ELSE '' END)"


@query(f"""WITH a AS (SELECT p_partkey, {_AGENT} AS line FROM part)
SELECT p_partkey, NOT ({" OR ".join(f"contains(lower(line), '{p}')" for p in PROGRAMS)}) AND len(list_filter(regexp_extract_all(line, '[A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z].{{2,8}}'))) >= 2 AS junk FROM a""")
def junk_agents(spark: SparkSession, folder: str) -> DataFrame:
    """an agent line of two or more capitalised words that names no known program."""
    end = F.when(F.col("p_partkey") % 4 == 0, "Outlook Express").when(F.col("p_partkey") % 4 == 1, "Qwzr 3.1").otherwise("")
    line = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit(" "), "p_brand", F.lit(" "), end)
    return table(spark, folder, "part").select("p_partkey", junk_program(line).alias("junk"))


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN concat('file:', event_id) ELSE concat('addr:u', user_id, '@d', user_id % 7, '.example') END AS key FROM events""")
def sender_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The key of an alert's sender: the address, or the file where there is none."""
    addr = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("addr:"), F.lower("addr")))
    return events(spark, folder).select("event_id", F.coalesce(addr, F.concat(F.lit("file:"), F.col("event_id").cast("string"))).alias("key"))


@query("""WITH l AS (SELECT user_id, event_type, event_id % 2 = 0 AS old FROM events), h AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (WHERE old)) AS past, list_sort(list(DISTINCT event_type) FILTER (WHERE NOT old)) AS now FROM l GROUP BY 1)
SELECT user_id, len(coalesce(now, [])) > 0 AND len(list_filter(coalesce(now, []), lambda x: NOT list_contains(coalesce(past, []), x))) = 0 AS consistent FROM h""")
def link_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all links of now are among those of before; none at all is not consistent."""
    old = F.col("event_id") % 2 == 0
    h = events(spark, folder).groupBy("user_id").agg(F.collect_set(F.when(old, F.col("event_type"))).alias("past"), F.collect_set(F.when(~old, F.col("event_type"))).alias("now"))
    return h.select("user_id", ((F.size("now") > 0) & (F.size(F.array_except("now", "past")) == 0)).alias("consistent"))


@query("""SELECT event_id, strftime(ts, '%d-%b-%Y') AS imap_date, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS until FROM events""")
def date_arguments(spark: SparkSession, folder: str) -> DataFrame:
    """A date written out, read back in one of three forms, and the day after as an exclusive end."""
    day = F.coalesce(F.try_to_timestamp(F.date_format("ts", "yyyy/MM/dd"), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.date_format("ts", "yyyy/MM/dd"), F.lit("yyyy/MM/dd")))
    return events(spark, folder).select("event_id", F.date_format(day, "dd-MMM-yyyy").alias("imap_date"), F.date_format(F.date_add(F.to_date(day), 1), "yyyy-MM-dd").alias("until"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) + len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) + len(regexp_extract_all(text, '\b[0-9a-fA-F]{32}\b')) AS n FROM documents""")
def ioc_count(spark: SparkSession, folder: str) -> DataFrame:
    """A01."""
    n = sum(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))) for p in (X.IPV4, X.EMAIL, X.MD5))
    return table(spark, folder, "documents").select("doc_id", n.cast("long").alias("n"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 3""")
def recent_by_sender(spark: SparkSession, folder: str) -> DataFrame:
    """The newest three of each sender."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return events(spark, folder).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("user_id", "event_id")


@query(f"""WITH l AS (SELECT page_id, {_HOST} AS host, list_distinct(list_filter(regexp_extract_all(html, 'href="(/[^"]*)"', 1), lambda x: x <> '')) AS links FROM pages) SELECT page_id, len(list_slice(links, 1, 20)) AS kept  FROM l""")
def link_lists(spark: SparkSession, folder: str) -> DataFrame:
    """How many different links of a page are kept, twenty at most."""
    links = F.array_distinct(F.filter(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)), lambda x: x != ""))
    return table(spark, folder, "pages").select("page_id", F.size(F.slice(links, 1, 20)).cast("long").alias("kept"))
