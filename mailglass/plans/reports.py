"""Queries for headers, registries, upserts, exports and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass.functions import text as X
from mailglass.functions import values as V
from mailglass.plans.registry import query, table
from mailglass.plans.state import events
from mailglass.sources import sinks

_FROM = "concat(c_name, ' <u', c_custkey, '@', ['gmail.com', 'shop.example.com', 'news.co.uk'][c_custkey % 3 + 1], '>')"


def _from(spark: SparkSession, folder: str) -> DataFrame:
    host = F.element_at(F.array(*map(F.lit, ("gmail.com", "shop.example.com", "news.co.uk"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    raw = F.concat("c_name", F.lit(" <u"), F.col("c_custkey").cast("string"), F.lit("@"), host, F.lit(">"))
    return table(spark, folder, "customer").select("c_custkey", raw.alias("raw"))


@query(rf"""SELECT c_custkey, name, addr, split_part(addr, '@', 1) AS localpart, split_part(addr, '@', 2) AS domain, split_part(addr, '@', 2) IN ({", ".join(f"'{f}'" for f in V.FREEMAIL)}) AS freemail,
len(regexp_extract_all(addr, '[0-9]')) > 2 AS numeric_noise FROM (SELECT c_custkey, trim(regexp_extract(raw, '^([^<]*)', 1)) AS name, regexp_extract(raw, '<([^>]+)>', 1) AS addr FROM (SELECT c_custkey, {_FROM} AS raw FROM customer))""")
def from_header(spark: SparkSession, folder: str) -> DataFrame:
    """Name, address and domain of a sender line."""
    x = _from(spark, folder).select("c_custkey", F.trim(F.regexp_extract("raw", "^([^<]*)", 1)).alias("name"), F.regexp_extract("raw", "<([^>]+)>", 1).alias("addr"))
    domain = F.substring_index("addr", "@", -1)
    return x.select("*", F.substring_index("addr", "@", 1).alias("localpart"), domain.alias("domain"), X.suffix_any(domain, V.FREEMAIL).alias("freemail"), (F.regexp_count("addr", F.lit("[0-9]")) > 2).alias("numeric_noise"))


@query(f"""WITH d AS (SELECT c_custkey, concat('help@d', c_custkey % 4, '.example') AS shown, concat('d', c_custkey % 3, '.example') AS domain FROM customer)
SELECT c_custkey, regexp_extract(shown, '@([a-z0-9.-]+)', 1) <> domain AS mismatch FROM d""")
def display_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """An address in the shown name whose domain is not the sender's."""
    k = F.col("c_custkey")
    shown = F.concat(F.lit("help@d"), (k % 4).cast("string"), F.lit(".example"))
    named = F.regexp_extract_all(F.lower(shown), F.lit(r"@([a-z0-9.-]+)"), F.lit(1))
    domain = F.concat(F.lit("d"), (k % 3).cast("string"), F.lit(".example"))
    return table(spark, folder, "customer").select("c_custkey", ((F.size(named) > 0) & ~F.array_contains(named, domain)).alias("mismatch"))


_STEM = "concat(upper(substr(md5(p_name), 1, 3)), substr(md5(p_name), 4, 9), ['Report', 'qzx', 'Final'][p_partkey % 3 + 1])"


@query(rf"""WITH s AS (SELECT p_partkey, {_STEM} AS stem FROM part), l AS (SELECT *, regexp_replace(stem, '[^A-Za-z]', '', 'g') AS letters FROM s),
r AS (SELECT *, coalesce(list_max(list_transform(regexp_extract_all(stem, '(?i)[bcdfghjklmnpqrstvwxyz]+'), lambda x: length(x))), 0) AS run FROM l)
SELECT p_partkey, stem, CAST(run AS INTEGER) AS run, length(stem) >= 10 AND regexp_matches(stem, '[0-9]') AND regexp_matches(stem, '[a-z]') AND regexp_matches(stem, '[A-Z]')
AND ((length(regexp_replace(letters, '(?i)[^aeiou]', '', 'g')) / length(letters) < 0.30 AND NOT regexp_matches(letters, '(?i)[aeiou][aeiou]')) OR run >= 4) AS random FROM r""")
def random_names(spark: SparkSession, folder: str) -> DataFrame:
    """File stems that cannot be spoken."""
    h = F.md5("p_name")
    stem = F.concat(F.upper(F.substring(h, 1, 3)), F.substring(h, 4, 9), F.element_at(F.array(*map(F.lit, ("Report", "qzx", "Final"))), (F.col("p_partkey") % 3 + 1).cast("int")))
    x = table(spark, folder, "part").select("p_partkey", stem.alias("stem"))
    s = F.col("stem")
    return x.select("p_partkey", "stem", X.longest_run(s, "(?i)[bcdfghjklmnpqrstvwxyz]+").alias("run"), X.random_filename(s).alias("random"))


@query("SELECT page_id, rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=') AS url_id FROM pages")
def url_id(spark: SparkSession, folder: str) -> DataFrame:
    """the identifier of an address at a reputation service."""
    return table(spark, folder, "pages").select("page_id", F.rtrim(F.translate(F.base64(F.encode("url", "utf-8")), "+/\r\n", "-_"), F.lit("=")).alias("url_id"))


@query(r"""WITH p AS (SELECT page_id, concat('QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo', CASE WHEN page_id % 2 = 0 THEN '<!-- x -->' ELSE ' ' END, 'YWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXo') AS html FROM pages)
SELECT page_id, list_max(list_transform(regexp_extract_all(html, '[A-Za-z0-9+/=]+'), lambda x: length(x))) < list_max(list_transform(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '[A-Za-z0-9+/=]+'), lambda x: length(x)))
AND list_max(list_transform(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '[A-Za-z0-9+/=]+'), lambda x: length(x))) >= 40 AS split FROM p""")
def comment_split_base64(spark: SparkSession, folder: str) -> DataFrame:
    """an encoded run that grows when comments are taken out."""
    html = F.concat(F.lit("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo"), F.when(F.col("page_id") % 2 == 0, "<!-- x -->").otherwise(" "), F.lit("YWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXo"))
    p = table(spark, folder, "pages").select("page_id", html.alias("html"))
    run = lambda c: X.longest_run(c, "[A-Za-z0-9+/=]+")
    bare = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    return p.select("page_id", ((run(bare) > run(F.col("html"))) & (run(bare) >= 40)).alias("split"))


@query(f"""WITH builtin AS (SELECT * FROM (VALUES {", ".join(f"('{r}', {i}, {p})" for i, (r, p) in enumerate(V.RULES))}) b(rule_id, ord, points)),
custom AS (SELECT CASE WHEN n_nationkey < 5 THEN ['att_html', 'body_otp', 'url_shortener', 'body_urgency', 'signal_stack'][n_nationkey + 1] ELSE lower(n_name) END AS rule_id, n_nationkey AS pos, 1 AS points FROM nation)
SELECT coalesce(b.rule_id, c.rule_id) AS rule_id, CAST(coalesce(ord, {len(V.RULES)} + pos) AS INTEGER) AS ord, CAST(coalesce(c.points, b.points) AS INTEGER) AS points, CASE WHEN c.rule_id IS NULL THEN 'builtin' ELSE 'custom' END AS source
FROM builtin b FULL JOIN custom c USING (rule_id)""")
def rule_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Own rules beside and over the built-in ones; an overriding rule keeps the place of the rule it replaces."""
    b = spark.createDataFrame([(r, i, p) for i, (r, p) in enumerate(V.RULES)], "rule_id string, ord int, points int")
    over = F.element_at(F.array(*map(F.lit, ("att_html", "body_otp", "url_shortener", "body_urgency", "signal_stack"))), (F.least("n_nationkey", F.lit(4)) + 1).cast("int"))
    c = table(spark, folder, "nation").select(F.when(F.col("n_nationkey") < 5, over).otherwise(F.lower("n_name")).alias("rule_id"), F.col("n_nationkey").alias("pos"), F.lit(1).alias("own"))
    x = b.join(c, "rule_id", "full")
    return x.select("rule_id", F.coalesce("ord", F.col("pos") + len(V.RULES)).cast("int").alias("ord"), F.coalesce("own", "points").cast("int").alias("points"), F.when(F.col("own").isNull(), "builtin").otherwise("custom").alias("source"))


@query("""WITH old AS (SELECT user_id AS key, max(value) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1), new AS (SELECT user_id AS key, min(value) AS v FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0 GROUP BY 1)
SELECT key, coalesce(n.v, o.v) AS v FROM old o FULL JOIN new n USING (key)""")
def cache_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Rows put in by key, new over old."""
    e = events(spark, folder)
    old = e.filter("event_id % 3 <> 0").groupBy(F.col("user_id").alias("key")).agg(F.max("value").alias("v"))
    new = e.filter("event_id % 3 = 0 and user_id % 2 = 0").groupBy(F.col("user_id").alias("key")).agg(F.min("value").alias("v"))
    return sinks.upsert(old, new, ["key"])


@query("""WITH e AS (SELECT *, ts + INTERVAL 24 HOUR AS expires_at FROM events) SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE expires_at <= TIMESTAMP '2024-01-15 00:00:00') AS purged,
CAST(sum(length(props)) AS BIGINT) AS bytes FROM e GROUP BY 1""")
def purge_stats(spark: SparkSession, folder: str) -> DataFrame:
    """What a purge of expired rows takes away."""
    gone = F.col("ts") + F.expr("INTERVAL 24 HOUR") <= F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    return events(spark, folder).groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(gone).alias("purged"), F.sum(F.length("props")).cast("long").alias("bytes"))


@query("""WITH h AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS n FROM events GROUP BY 1), r AS (SELECT DISTINCT user_id + 5 AS user_id FROM events WHERE event_type = 'purchase')
SELECT user_id, coalesce(n, 0) AS n, r.user_id IS NOT NULL AS replied FROM h FULL JOIN r USING (user_id)""".replace("SELECT user_id, coalesce(n, 0) AS n, r.user_id IS NOT NULL AS replied FROM h FULL JOIN r USING (user_id)", "SELECT coalesce(h.user_id, r.user_id) AS user_id, coalesce(n, 0) AS n, r.user_id IS NOT NULL AS replied FROM h FULL JOIN r ON h.user_id = r.user_id"))
def mark_replied(spark: SparkSession, folder: str) -> DataFrame:
    """Q09: addresses that were written to; one never seen before comes in with no mails."""
    e = events(spark, folder)
    h = e.groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("n"))
    r = e.filter("event_type = 'purchase'").select((F.col("user_id") + 5).alias("user_id")).distinct().withColumn("r", F.lit(True))
    return h.join(r, "user_id", "full").select("user_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("r", F.lit(False)).alias("replied"))


@query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'phishing' WHEN l.doc_id IS NULL THEN NULL ELSE 'benign' END AS label, l.doc_id IS NULL AS skipped FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)""")
def label_export(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their label; those without are skipped in the export."""
    l = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.lit(True).alias("has"))
    d = table(spark, folder, "documents").select("doc_id").join(l, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("toxic") == 1, "phishing").when(F.col("has"), "benign").alias("label"), F.col("has").isNull().alias("skipped"))


@query("""SELECT event_id, CASE WHEN value >= 100 THEN 4 WHEN value >= 50 THEN 3 ELSE 2 END AS severity, concat('report ', event_id) AS title FROM events WHERE value >= 50""")
def alert_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts of reports that are not benign, read back from their JSON."""
    e = events(spark, folder).filter("value >= 50")
    p = sinks.alert_payload(F.col("verdict"), F.concat(F.lit("report "), F.col("event_id").cast("string")), F.array("addr"))
    x = e.select("event_id", p.alias("p"))
    return x.select("event_id", F.get_json_object("p", "$.severity").cast("int").alias("severity"), F.get_json_object("p", "$.title").alias("title"))


@query("""SELECT concat('URL', chr(9), url, chr(9), count(*)) AS line FROM pages GROUP BY url UNION ALL SELECT concat('DOMAIN', chr(9), h, chr(9), count(*)) FROM (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS h FROM pages) GROUP BY h""")
def indicator_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of an indicator feed."""
    p = table(spark, folder, "pages")
    i = p.select(F.lit("url").alias("kind"), F.col("url").alias("ioc")).unionByName(p.select(F.lit("domain").alias("kind"), X.url_host(F.col("url")).alias("ioc")))
    return sinks.indicator_feed(i).withColumnRenamed("value", "line")


@query("""WITH x AS (SELECT mime, ext FROM (VALUES ('application/pdf', 'exe'), ('application/octet-stream', 'docx'), ('image/png', 'png')) m(mime, ext)) SELECT p_partkey, mime, ext, mime = 'application/octet-stream' AS generic, mime = 'application/pdf' AS conflict
FROM part JOIN (SELECT *, row_number() OVER () - 1 AS i FROM x) ON i = p_partkey % 3""")
def mime_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Declared content types against content and name."""
    from mailglass.operators import attachments as A

    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 3 + 1).cast("int"))
    x = table(spark, folder, "part").select("p_partkey", pick("application/pdf", "application/octet-stream", "image/png").alias("mime"), pick("exe", "docx", "png").alias("ext"), pick("pe", "zip", "png").alias("kind"))
    return x.select("p_partkey", "mime", "ext", A.generic_mime(F.col("mime"), F.col("ext")).alias("generic"), A.mime_conflict(F.col("mime"), F.col("kind")).alias("conflict"))
