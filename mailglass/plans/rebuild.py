"""Queries over state that is committed, and over dates and names of mail: what a folder of mail leaves behind."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass.functions.dates import mail_date
from mailglass.functions.names import folder_decoded, folder_encoded, safe_file_name
from mailglass.operators import domain_lists, rebuild
from mailglass.plans import mails as M
from mailglass.plans.indicators import REG
from mailglass.plans.registry import query, table
from mailglass.sources.state_tables import StateTables


def state_root(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; a local master without one (tests) gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
    return f"{at.rstrip('/')}/state-{uuid.uuid4().hex}"


#: The folder, the own address and the Date header of a page's mail; in both engines.
SENT = "page_id % 9 = 4"
SENT_AT = "'Mon, ' || (page_id % 28 + 1) || ' Jan 2024 08:0' || (page_id % 10) || ':00 +0100'"


def landed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Files (path, modificationTime, length, page_id) and their mails with a Date header."""
    dated = F.map_concat("headers", F.create_map(F.lit("date"), F.array(F.expr(SENT_AT))))
    path = F.concat(F.when(F.expr(SENT), "/box/Sent/").otherwise("/box/in/"), "mail_id", F.lit(".eml"))
    x = M.mails(spark, folder).withColumns({"headers": dated, "path": path})
    files = table(spark, folder, "pages").select(F.concat(F.when(F.expr(SENT), "/box/Sent/").otherwise("/box/in/"), F.col("page_id").cast("string"), F.lit(".eml")).alias("path"), F.timestamp_seconds(F.col("page_id")).alias("modificationTime"), F.length("html").cast("long").alias("length"), "page_id")
    return files, x


@query(f"""WITH {M.BASE_SQL}, heads AS (SELECT page_id, lower(regexp_extract({M.FROM}, '[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+')) AS addr FROM x),
received AS (SELECT addr, CAST(count(*) AS BIGINT) AS count, min(page_id % 28) AS first_, max(page_id % 28) AS last_,
  min(TIMESTAMP '2024-01-01 07:00:00' + to_days(CAST(page_id % 28 AS INT)) + to_minutes(page_id % 10)) AS first_seen, max(TIMESTAMP '2024-01-01 07:00:00' + to_days(CAST(page_id % 28 AS INT)) + to_minutes(page_id % 10)) AS last_seen
  FROM heads WHERE addr <> '' AND NOT ({SENT}) GROUP BY addr),
parts AS (SELECT *, string_split(regexp_extract(addr, '@(.*)$', 1), '.') AS p FROM received),
named AS (SELECT addr, {REG} AS domain, count, first_seen, last_seen, false AS replied FROM parts)
SELECT addr, domain, count, first_seen, last_seen, replied FROM named
UNION ALL SELECT 'li@corp.example.com', '', 0, NULL, NULL, true WHERE EXISTS (FROM pages WHERE {SENT})""")
def rebuild_equals_full(spark: SparkSession, folder: str) -> DataFrame:
    """History committed in three rounds of new files, each counted once, is that of all files at once."""
    files, mails = landed(spark, folder)
    tables = StateTables(spark, state_root(spark))
    # A page lands in the round of its number modulo three; what landed before is still in the folder.
    mails_of = lambda todo: mails.join(todo.select("path"), "path", "left_semi")
    for landed_by in range(3):
        rebuild.rebuild_history(tables, "box", files.filter(F.col("page_id") % 3 <= landed_by), sent_folders=("Sent",), incremental=True, mails_of=mails_of)
    return tables.read("sender_history").drop("link_domains")


ZONED = ((0, "+0000"), (330, "+0530"), (-480, "-0800"), (-240, "EDT"), (0, "GMT"), (0, ""), (60, "+0100 (CET)"), (0, "Z"))


@query(f"""SELECT event_id, CASE WHEN event_id % 11 = 10 THEN NULL ELSE date_trunc('second', ts) - CASE event_id % 8 {" ".join(f"WHEN {i} THEN to_minutes({m})" for i, (m, _) in enumerate(ZONED))} END END AS sent FROM events""")
def mail_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Date headers in eight forms, and broken ones, as moments."""
    forms = ("EEE, d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss", "EEE, dd MMM yy HH:mm:ss", "EEE,  d-MMM-yyyy HH:mm:ss", "EEEE, d MMMM yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss", "EEE d MMM yyyy HH:mm:ss", "EEE, d MMM yyyy HH.mm.ss")
    i = F.col("event_id") % 8
    utc = F.to_utc_timestamp(F.from_utc_timestamp("ts", F.current_timezone()), F.current_timezone())
    text = F.coalesce(*[F.when(i == k, F.concat(F.date_format(utc, form), F.lit(" " + zone))) for k, (form, (_, zone)) in enumerate(zip(forms, ZONED, strict=True))])
    broken = F.when(F.col("event_id") % 11 == 10, F.concat(F.lit("sometime in "), F.date_format("ts", "MMMM")))
    return table(spark, folder, "events").select("event_id", mail_date(F.coalesce(broken, text)).alias("sent"))


@query(r"""WITH runs AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20-\x7E]+|[^\x20-\x7E]+') AS r FROM documents),
coded AS (SELECT doc_id, text, array_to_string(list_transform(r, lambda x: CASE WHEN regexp_matches(x, '^[\x20-\x7E]') THEN replace(x, '&', '&-') ELSE '&' || replace(rtrim(base64(unhex(array_to_string(
  list_transform(regexp_extract_all(x, '(?s).'), lambda c: CASE WHEN unicode(c) < 65536 THEN printf('%04X', unicode(c)) ELSE printf('%04X%04X', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END), ''))), '='), '/', ',') || '-' END), '') AS name FROM runs)
SELECT doc_id, md5(name) AS encoded, md5(text) AS decoded, length(name) AS n FROM coded""")
def folder_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as a folder's name, encoded and decoded again."""
    x = table(spark, folder, "documents").select("doc_id", folder_encoded(F.col("text")).alias("name"))
    return x.select("doc_id", F.md5("name").alias("encoded"), F.md5(folder_decoded(F.col("name"))).alias("decoded"), F.length("name").cast("long").alias("n"))


@query(r"""WITH cut AS (SELECT doc_id, rtrim(substr(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\/:*?"<>|\x00-\x1F\x7F]', '_', 'g'), '\s+', ' ', 'g'), '^[. ]+|[. ]+$', '', 'g'), 1, 80), '. ') AS name FROM documents)
SELECT doc_id, CASE WHEN name = '' OR length(name) - length(replace(name, chr(65533), '')) > 0.3 * length(name) THEN 'mail_' || doc_id ELSE name END AS name FROM cut""")
def safe_file_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as a file's name."""
    return table(spark, folder, "documents").select("doc_id", safe_file_name(F.col("text"), F.concat(F.lit("mail_"), "doc_id")).alias("name"))


#: Entries of a list from pages' hosts: as they are, with a wildcard, under a sub-domain, with dots and capitals, or broken.
ENTRY = "CASE page_id % 5 WHEN 0 THEN host WHEN 1 THEN concat('*.', host) WHEN 2 THEN concat('mail.', host, '.') WHEN 3 THEN upper(concat('.', host)) ELSE concat('-', host) END"


@query(f"""WITH hosts AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages), entries AS (SELECT lower(trim({ENTRY})) AS e FROM hosts),
plain AS (SELECT DISTINCT regexp_extract(regexp_replace(e, '^\\.+|\\.+$', '', 'g'), '^(?:\\*\\.)?([a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?(?:\\.[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?)+)$', 1) AS host FROM entries),
split AS (SELECT host, string_split(host, '.') AS p FROM plain WHERE host <> ''), named AS (SELECT host, p, {REG} AS domain FROM split),
ups AS (SELECT host, i, array_to_string(p[i:], '.') AS parent FROM named, generate_series(2, 20) t(i) WHERE i <= len(p)),
met AS (SELECT u.host, arg_min(u.parent, u.i) AS parent FROM ups u JOIN named n ON n.host = u.parent GROUP BY 1)
SELECT n.host, n.domain, m.parent FROM named n LEFT JOIN met m USING (host)""")
def domain_list(spark: SparkSession, folder: str) -> DataFrame:
    """a list of hosts made plain, with the listed host that covers each."""
    hosts = table(spark, folder, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"))
    return domain_lists.covered(domain_lists.normalised(hosts.select(F.expr(ENTRY).alias("entry"))))
