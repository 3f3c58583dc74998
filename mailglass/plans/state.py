"""State queries: sender history, verdict feedback, intelligence with expiry, cursors, alert windows, reports. Senders and
reports come from events: the sender is u<user_id>@d<user_id % 7>.example."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailglass.operators import reports
from mailglass.operators import state as S
from mailglass.plans.registry import query, table

ADDR_SQL = "concat('u', user_id, '@d', user_id % 7, '.example')"
DOMAIN_SQL = "concat('d', user_id % 7, '.example')"
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
BAND_SQL = "CASE WHEN value >= 100 THEN 'MALICIOUS' WHEN value >= 50 THEN 'SUSPICIOUS' ELSE 'BENIGN' END"


def events(spark: SparkSession, folder: str) -> DataFrame:
    v = F.when(F.col("value") >= 100, "MALICIOUS").when(F.col("value") >= 50, "SUSPICIOUS").otherwise("BENIGN")
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value", "props", F.expr("concat('u', user_id, '@d', user_id % 7, '.example')").alias("addr"), F.expr("concat('d', user_id % 7, '.example')").alias("domain"), v.alias("verdict"))


HISTORY_SQL = f"""SELECT {ADDR_SQL} AS addr, {DOMAIN_SQL} AS domain, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, bool_or(event_type = 'purchase') AS replied,
string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS links FROM events GROUP BY 1, 2"""


def history(e: DataFrame) -> DataFrame:
    """A mergeable record per sender: mails, first and last sight, whether it was answered, link domains."""
    return e.groupBy("addr", "domain").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.bool_or(F.col("event_type") == "purchase").alias("replied"), F.collect_set("event_type").alias("links"))


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two histories as one; merging parts gives the history of the whole."""
    both = old.unionByName(new)
    return both.groupBy("addr", "domain").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.bool_or("replied").alias("replied"), F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))


def _shown(h: DataFrame) -> DataFrame:
    return h.withColumn("links", F.array_join(F.array_sort("links"), ","))


@query(HISTORY_SQL)
def sender_history(spark: SparkSession, folder: str) -> DataFrame:
    """A12."""
    return _shown(history(events(spark, folder)))


@query(HISTORY_SQL)
def history_incremental_equals_full(spark: SparkSession, folder: str) -> DataFrame:
    """Q08: the history of two halves, merged, against the history of the whole."""
    e = events(spark, folder)
    late = F.col("event_id") % 2 == 1
    return _shown(merge_history(history(e.filter(~late)), history(e.filter(late))))


@query(f"""SELECT domain, CAST(sum(n) AS BIGINT) AS n, CAST(floor(date_diff('second', min(first_seen), max(last_seen)) / 86400) AS BIGINT) AS span_days FROM ({HISTORY_SQL}) GROUP BY 1""")
def domain_history(spark: SparkSession, folder: str) -> DataFrame:
    """Whole days between first and last sight, by elapsed time."""
    h = history(events(spark, folder)).groupBy("domain").agg(F.sum("n").alias("n"), F.min("first_seen").alias("a"), F.max("last_seen").alias("b"))
    return h.select("domain", "n", F.floor(F.expr("timestampdiff(SECOND, a, b)") / 86400).alias("span_days"))


@query(f"""WITH h AS ({HISTORY_SQL}), d AS (SELECT domain, sum(n) AS dn, floor(date_diff('second', min(first_seen), max(last_seen)) / 86400) AS days FROM h GROUP BY 1)
SELECT addr, CASE WHEN NOT replied AND n < 2 THEN 'none' WHEN replied OR (domain <> 'd3.example' AND dn >= 5 AND days >= 14) THEN 'established' ELSE 'known' END AS tier FROM h JOIN d USING (domain)""")
def trust_tier(spark: SparkSession, folder: str) -> DataFrame:
    """None below two mails unless answered; established when answered or by the domain's history, which a
    shared domain does not have."""
    h = history(events(spark, folder))
    d = h.groupBy("domain").agg(F.sum("n").alias("dn"), (F.expr("timestampdiff(SECOND, min(first_seen), max(last_seen))") / 86400).alias("days"))
    old = (F.col("domain") != "d3.example") & (F.col("dn") >= 5) & (F.floor("days") >= 14)
    tier = F.when(~F.col("replied") & (F.col("n") < 2), "none").when(F.col("replied") | old, "established").otherwise("known")
    return h.join(d, "domain").select("addr", tier.alias("tier"))


_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
_MARKS_SQL = f"""v AS (SELECT {ADDR_SQL} AS key, 'addr' AS scope, 'benign' AS verdict, max(ts) + INTERVAL 2 DAY AS expires_at FROM events WHERE event_type = 'purchase' GROUP BY 1
UNION ALL SELECT {DOMAIN_SQL}, 'domain', 'phishing', max(ts) + INTERVAL 1 DAY FROM events WHERE event_type = 'signup' GROUP BY 1),
live AS (SELECT * FROM v WHERE expires_at > {_NOW})"""


@query(f"""WITH {_MARKS_SQL}, s AS (SELECT DISTINCT {ADDR_SQL} AS addr, {DOMAIN_SQL} AS domain FROM events)
SELECT addr, coalesce(a.verdict, d.verdict) AS verdict, CASE WHEN a.verdict IS NOT NULL THEN 'addr' WHEN d.verdict IS NOT NULL THEN 'domain' END AS scope
FROM s LEFT JOIN live a ON a.scope = 'addr' AND a.key = addr LEFT JOIN live d ON d.scope = 'domain' AND d.key = domain""")
def human_verdict_priority(spark: SparkSession, folder: str) -> DataFrame:
    """The address's verdict goes before the domain's; expired ones are gone before that."""
    e = events(spark, folder)
    now = F.expr("timestamp_ntz'2024-01-20 00:00:00'")

    def live(kind: str, by: str, verdict: str, days: int) -> DataFrame:
        m = e.filter(F.col("event_type") == kind).groupBy(by).agg((F.max("ts") + F.expr(f"INTERVAL {days} DAY")).alias("until"))
        return m.filter(F.col("until") > now).select(by, F.lit(verdict).alias(f"by_{by}"))

    s = e.select("addr", "domain").distinct().join(live("purchase", "addr", "benign", 2), "addr", "left").join(live("signup", "domain", "phishing", 1), "domain", "left")
    return s.select("addr", F.coalesce("by_addr", "by_domain").alias("verdict"), F.when(F.col("by_addr").isNotNull(), "addr").when(F.col("by_domain").isNotNull(), "domain").alias("scope"))


@query(f"""WITH c AS (SELECT user_id AS ioc, max(ts) AS at FROM events WHERE event_type = 'click' GROUP BY 1), q AS (SELECT event_id, user_id AS ioc, ts FROM events WHERE event_type <> 'click')
SELECT event_id, CASE WHEN c.at IS NULL THEN 'miss' WHEN c.at + INTERVAL 24 HOUR > q.ts THEN 'hit' ELSE 'expired' END AS found FROM q LEFT JOIN c USING (ioc)""")
def intel_ttl_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A cached result holds for 24 hours."""
    e = events(spark, folder)
    c = e.filter("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("at"))
    q = e.filter("event_type <> 'click'").join(c, "user_id", "left")
    return q.select("event_id", F.when(F.col("at").isNull(), "miss").when(F.col("at") + F.expr("INTERVAL 24 HOUR") > F.col("ts"), "hit").otherwise("expired").alias("found"))


@query(f"SELECT event_id FROM events WHERE {DOMAIN_SQL} NOT IN ('d1.example', 'd4.example')")
def trusted_anti(spark: SparkSession, folder: str) -> DataFrame:
    """What is not on the trusted list is looked up."""
    trusted = spark.createDataFrame([("d1.example",), ("d4.example",)], "domain string")
    return events(spark, folder).join(F.broadcast(trusted), "domain", "left_anti").select("event_id")  # two rows


@query("""WITH f AS (SELECT event_type AS folder, max(event_id) FILTER (WHERE event_id % 2 = 0) AS prev, max(event_id) AS max_uid, min(user_id) % 2 = 0 AS same_validity FROM events GROUP BY 1)
SELECT folder, prev, max_uid, CASE WHEN same_validity THEN prev ELSE 0 END AS since, CASE WHEN same_validity THEN greatest(prev, max_uid) ELSE max_uid END AS next FROM f""")
def cursor_advance(spark: SparkSession, folder: str) -> DataFrame:
    """Q04 Q06: a folder's cursor starts over when its validity changes, and else never goes back."""
    f = events(spark, folder).groupBy(F.col("event_type").alias("folder")).agg(F.max(F.when(F.col("event_id") % 2 == 0, F.col("event_id"))).alias("prev"), F.max("event_id").alias("max_uid"), (F.min("user_id") % 2 == 0).alias("same"))
    return f.select("folder", "prev", "max_uid", F.when(F.col("same"), F.col("prev")).otherwise(0).alias("since"), F.when(F.col("same"), F.greatest("prev", "max_uid")).otherwise(F.col("max_uid")).alias("next"))


@query(f"""WITH a AS (SELECT {ADDR_SQL} AS addr, event_id, ts, epoch_us(ts) // 43200000000 AS slot FROM events WHERE {BAND_SQL} IN ('MALICIOUS', 'SUSPICIOUS'))
SELECT addr, slot, event_id FROM (SELECT *, row_number() OVER (PARTITION BY addr, slot ORDER BY ts, event_id) AS r FROM a) WHERE r = 1""")
def notify_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """One alert a sender and half day, the first."""
    a = events(spark, folder).filter("verdict in ('MALICIOUS', 'SUSPICIOUS')").withColumn("slot", F.floor(F.expr(MICROS) / 43_200_000_000))
    first = a.groupBy("addr", "slot").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.select("addr", "slot", F.col("f.event_id").alias("event_id"))


@query(f"""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE busy > 3) AS limited FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS busy FROM events) GROUP BY 1""")
def rate_limit_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Requests in a sliding window of six hours."""
    w = Window.partitionBy("user_id").orderBy(F.expr(MICROS)).rangeBetween(-6 * 3600 * 1_000_000, 0)
    return events(spark, folder).withColumn("busy", F.count("*").over(w)).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("busy") > 3).alias("limited"))


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, {BAND_SQL} AS verdict, count(*) AS n FROM events GROUP BY 1, 2")
def daily_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Reports per day."""
    return events(spark, folder).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "verdict").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, ts, {BAND_SQL} AS verdict FROM events ORDER BY ts DESC, event_id LIMIT 100")
def list_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The newest reports, a page of 100."""
    return events(spark, folder).select("event_id", "ts", "verdict").orderBy(F.desc("ts"), "event_id").limit(100)


@query(f"SELECT addr, n, last_seen FROM ({HISTORY_SQL}) ORDER BY n DESC, last_seen DESC, addr LIMIT 50")
def list_senders(spark: SparkSession, folder: str) -> DataFrame:
    """The busiest senders, a page of 50."""
    return history(events(spark, folder)).select("addr", "n", "last_seen").orderBy(F.desc("n"), F.desc("last_seen"), "addr").limit(50)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def report_json(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of stored documents."""
    return events(spark, folder).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT n_name AS term FROM nation WHERE n_regionkey <> 3 EXCEPT SELECT r_name FROM region")
def dict_except(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of a list that another has not."""
    a = table(spark, folder, "nation").filter("n_regionkey <> 3").select(F.col("n_name").alias("term"))
    return a.exceptAll(table(spark, folder, "region").select("r_name")).distinct()


@query("""WITH l AS (SELECT lower(n_name) AS term, 0 AS src, n_nationkey AS pos FROM nation UNION ALL SELECT lower(r_name), 1, r_regionkey FROM region UNION ALL SELECT lower(c_mktsegment), 2, c_custkey FROM customer)
SELECT term, src FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY src, pos) AS r FROM l) WHERE r = 1""")
def merge_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lists as one; the first list that has a term keeps it."""
    n = table(spark, folder, "nation").select(F.lower("n_name").alias("term"), F.lit(0).alias("src"))
    r = table(spark, folder, "region").select(F.lower("r_name").alias("term"), F.lit(1).alias("src"))
    c = table(spark, folder, "customer").select(F.lower("c_mktsegment").alias("term"), F.lit(2).alias("src"))
    return n.unionByName(r).unionByName(c).groupBy("term").agg(F.min("src").alias("src"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """B01."""
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("SELECT doc_id, key FROM (SELECT doc_id, md5(concat(doc_id, ':42')) AS key FROM documents) ORDER BY key, doc_id LIMIT 100")
def sample_seeded(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded sample of 100, the same on every run."""
    key = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")))
    return table(spark, folder, "documents").select("doc_id", key.alias("key")).orderBy("key", "doc_id").limit(100)


@query("""SELECT conv_id, count(*) AS turns, CAST(sum(CASE WHEN role = prev THEN 1 ELSE 0 END) AS BIGINT) AS same_role FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1""")
def thread_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of each thread, and how often one side writes twice running."""
    prev = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, folder, "conversations").withColumn("prev", prev)
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.when(F.col("role") == F.col("prev"), 1).otherwise(0)).alias("same_role"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality = 0) AS junk, round(avg(n_chars), 6) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def source_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A16 over labelled texts by source."""
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 0).alias("junk"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("""SELECT event_id FROM events e WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view' AND event_id % 3 <> 0)""")
def ledger_anti(spark: SparkSession, folder: str) -> DataFrame:
    """What the ledger does not have is counted."""
    e = events(spark, folder).withColumn("path", F.col("event_id").cast("string"))
    return S.not_counted(e, e.filter("event_type = 'view' and event_id % 3 <> 0").select("path")).select("event_id")


@query("""SELECT folder, uid, max(uidvalidity) AS uidvalidity FROM (SELECT event_type AS folder, event_id % 500 AS uid, event_id // 500 AS uidvalidity FROM events) GROUP BY 1, 2""")
def uid_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Q07: a mail of a folder counts once, under its newest validity."""
    e = events(spark, folder).select(F.col("event_type").alias("folder"), (F.col("event_id") % 500).alias("uid"), F.floor(F.col("event_id") / 500).alias("uidvalidity"))
    return S.newest_by_uid(e)


@query(f"""SELECT {ADDR_SQL} AS key, max(ts) AS created_at FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY created_at DESC, key LIMIT 50""")
def verdicts_recent(spark: SparkSession, folder: str) -> DataFrame:
    """Human verdicts, the newest first; a report of 50."""
    v = events(spark, folder).filter("event_type = 'purchase'").groupBy(F.col("addr").alias("key")).agg(F.max("ts").alias("created_at"))
    return v.orderBy(F.desc("created_at"), "key").limit(50)


@query(f"""WITH old AS (SELECT {ADDR_SQL} AS key, 'benign' AS verdict FROM events WHERE event_type = 'purchase' GROUP BY 1), new AS (SELECT {ADDR_SQL} AS key, 'phishing' AS verdict FROM events WHERE event_type = 'signup' GROUP BY 1),
gone AS (SELECT {ADDR_SQL} AS key FROM events WHERE event_type = 'click' AND value > 90 GROUP BY 1)
SELECT * FROM (SELECT * FROM old WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT * FROM new) WHERE key NOT IN (SELECT key FROM gone)""")
def verdict_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts for all senders of a batch take the place of older ones, others are revoked."""
    e = events(spark, folder)
    by = lambda kind, verdict: e.filter(F.col("event_type") == kind).select(F.col("addr").alias("key"), F.lit(verdict).alias("verdict")).distinct()
    gone = e.filter("event_type = 'click' and value > 90").select(F.col("addr").alias("key"))
    return S.delete(S.upsert(by("purchase", "benign"), by("signup", "phishing"), ["key"]), gone, ["key"])


@query("""SELECT l_orderkey AS mail_id, l_linenumber AS line, CAST(least(100, 60 * (CAST(l_quantity AS INTEGER) % 3)) AS INTEGER) AS scan_score, l_discount * 1000 >= 50 AS abuse_hit FROM lineitem""")
def lookup_scores(spark: SparkSession, folder: str) -> DataFrame:
    """What a page scanner's and an abuse list's answers count."""
    l = table(spark, folder, "lineitem")
    return l.select(F.col("l_orderkey").alias("mail_id"), F.col("l_linenumber").alias("line"), reports.scan_score(F.col("l_quantity").cast("int") % 3).cast("int").alias("scan_score"), reports.abuse_hit(F.col("l_discount") * 1000).alias("abuse_hit"))


@query("""WITH f AS (SELECT page_id, length(html) AS n, page_id * 60 AS t FROM pages)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(max(t) AS BIGINT) AS newest, CAST(sum(n) AS BIGINT) AS bytes FROM f""")
def input_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a folder has changed: number, newest change and bytes of its files (beside a digest of paths)."""
    p = table(spark, folder, "pages").select(F.col("url").alias("path"), F.timestamp_seconds(F.col("page_id") * 60).alias("modificationTime"), F.length("html").alias("length"))
    parts = F.split("fingerprint", ":")
    return S.fingerprint(p).select(*[parts[i].cast("long").alias(c) for i, c in enumerate(("n", "newest", "bytes"))])
