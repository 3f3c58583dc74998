"""Queries over texts, hosts and names: rule predicates, indicators, URL and file-name features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass.functions import rules as R
from mailglass.functions import text as X
from mailglass.functions import values as V
from mailglass.plans.registry import query, table

_WORDS = ("licensed", "password", "secret", "apache license")


def _sql_list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _docs(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", *cols)


def _hosts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", "url", X.url_host(F.col("url")).alias("host"))


HOST = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
REG = f"""CASE WHEN len(p) < 2 THEN array_to_string(p, '.') WHEN array_to_string(p[-2:], '.') IN ({_sql_list(V.TWO_LEVEL)}) THEN array_to_string(p[greatest(len(p) - 2, 1):], '.') ELSE array_to_string(p[-2:], '.') END"""


def _rule(spark, folder, spec: R.Spec, name: str, col: str = "text"):
    docs = _docs(spark, folder, col)
    hit, show = R.condition(spec, lambda f: f if f == col else None)
    return docs.select("doc_id", hit.alias(name), show.alias("shown"))


@query("SELECT doc_id, shown IS NOT NULL AS hit, shown FROM (SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{w}'" for w in _WORDS) + " END AS shown FROM documents)")
def rule_contains_any(spark: SparkSession, folder: str) -> DataFrame:
    """The first term of a list that the text holds."""
    return _rule(spark, folder, R.Spec("text", "contains_any", _WORDS), "hit")


@query("SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'license') AS hit FROM documents")
def rule_contains_all(spark: SparkSession, folder: str) -> DataFrame:
    """P02."""
    return _rule(spark, folder, R.Spec("text", "contains_all", ("the", "license")), "hit").drop("shown")


@query(r"SELECT doc_id, shown IS NOT NULL AS hit, shown FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)[a-z]+@[a-z]+') THEN '[a-z]+@[a-z]+' WHEN regexp_matches(text, '(?i)[0-9]{3}-[0-9]{4}') THEN '[0-9]{3}-[0-9]{4}' END AS shown FROM documents)")
def rule_regex_any(spark: SparkSession, folder: str) -> DataFrame:
    """P03."""
    return _rule(spark, folder, R.Spec("text", "regex_any", ("[a-z]+@[a-z]+", "[0-9]{3}-[0-9]{4}")), "hit")


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)th[a-z]')) > 40 AS many, (length(text) - length(replace(lower(text), 'the', ''))) / 3 > 10 AS often FROM documents")
def rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    """P11 P12."""
    return _counts(_docs(spark, folder, "text"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)th[a-z]')) > 40 AS many, (length(text) - length(replace(lower(text), 'the', ''))) / 3 > 10 AS often FROM documents")
def rule_counts_all(spark: SparkSession, folder: str) -> DataFrame:
    """P11 P12, under the name that it had beside a narrower one."""
    return _counts(_docs(spark, folder, "text"))


def _counts(d: DataFrame) -> DataFrame:
    get = lambda f: f
    many, _ = R.condition(R.Spec("text", "regex_count_gt", ("th[a-z]", 40)), get)
    often, _ = R.condition(R.Spec("text", "count_gt", ("the", 10)), get)
    return d.select("doc_id", many.alias("many"), often.alias("often"))


@query("""SELECT p_partkey, p_size > 20 AS gt, p_size < 5 AS lt, length(p_name) > 12 AS length_gt, length(p_name) < 10 AS length_lt, p_size <> 0 AS exists_size,
lower(p_brand) IN ('brand#12', 'brand#23') AS equals_any, p_size > 20 AND NOT lower(p_brand) IN ('brand#12', 'brand#23') AS excluded FROM part""")
def rule_numeric(spark: SparkSession, folder: str) -> DataFrame:
    """P04 P06-P10 P13 P14."""
    get = lambda f: f
    brands = R.Spec("p_brand", "equals_any", ("Brand#12", "Brand#23"))
    specs = {
        "gt": R.Spec("p_size", "gt", (20,), kind="number"), "lt": R.Spec("p_size", "lt", (5,), kind="number"), "length_gt": R.Spec("p_name", "length_gt", (12,)),
        "length_lt": R.Spec("p_name", "length_lt", (10,)), "exists_size": R.Spec("p_size", "exists", (True,), kind="number"), "equals_any": brands, "excluded": R.Spec("p_size", "gt", (20,), exclude=brands, kind="number"),
    }
    return table(spark, folder, "part").select("p_partkey", *[R.condition(s, get)[0].alias(n) for n, s in specs.items()])


@query(f"""SELECT page_id, host, {" OR ".join(f"host = '{n}' OR ends_with(host, '.{n}')" for n in ("example.com", "example.net"))} AS hit FROM (SELECT page_id, {HOST} AS host FROM pages)""")
def rule_suffix_any(spark: SparkSession, folder: str) -> DataFrame:
    """P05 J03."""
    return _hosts(spark, folder).select("page_id", "host", X.suffix_any(F.col("host"), ("example.com", "example.net")).alias("hit"))


@query("""SELECT o_orderkey AS mail_id, min(l_linenumber) AS first_item FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40 AND l_discount < 0.05 GROUP BY 1""")
def scope_any_first_item(spark: SparkSession, folder: str) -> DataFrame:
    """A rule fires once for a mail if all its conditions hold on one item; the first such item."""
    get = lambda f: f
    hit, _ = R.holds(R.Rule("wide", 3, (R.Spec("l_quantity", "gt", (40,), kind="number"), R.Spec("l_discount", "lt", (0.05,), kind="number"))), get)
    items = table(spark, folder, "lineitem").filter(hit)
    return items.join(table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy(F.col("l_orderkey").alias("mail_id")).agg(F.min("l_linenumber").alias("first_item"))


@query("SELECT p_partkey, concat('large part ', p_name, ' of ', p_brand, ': ', CAST(p_size AS VARCHAR)) AS reason FROM part WHERE p_size > 45")
def reason_render(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of a rule set with their reasons filled in."""
    get = lambda f: f if f in ("p_name", "p_brand", "p_size") else None
    rule = R.Rule("large", 5, (R.Spec("p_size", "gt", (45,), kind="number"),), "large part {p_name} of {p_brand}: {p_size}{missing}")
    s = table(spark, folder, "part").select("p_partkey", F.explode(R.signals([rule], get)).alias("s"))
    return s.select("p_partkey", F.col("s.reason").alias("reason"))


@query(f"SELECT page_id, host, {REG} AS domain, len(p) AS labels FROM (SELECT page_id, host, list_filter(string_split(host, '.'), lambda x: x <> '') AS p FROM (SELECT page_id, {HOST} AS host FROM pages))")
def registrable_domain(spark: SparkSession, folder: str) -> DataFrame:
    """F08 F12 F13."""
    return _hosts(spark, folder).select("page_id", "host", X.registrable_domain(F.col("host")).alias("domain"), F.size(X.labels(F.col("host"))).cast("long").alias("labels"))


@query(rf"""SELECT page_id, regexp_matches(lower(url), '^[a-z]+://[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}') AS ip_literal, contains(lower(url), 'xn--') AS punycode, regexp_matches(url, '^[a-z]+://[^/]*@') AS at_sign,
{" OR ".join(f"ends_with(host, '.{t}')" for t in V.SUSPICIOUS_TLDS)} AS odd_tld, host IN ({_sql_list(V.SHORTENERS)}) AS shortener, len(string_split(host, '.')) > 3 AS many_subdomains,
{" OR ".join(f"contains(lower(url), '{t}')" for t in ("password", "wallet", "recover", "unlock"))} AS keywords FROM (SELECT page_id, url, {HOST} AS host FROM pages)""")
def url_features(spark: SparkSession, folder: str) -> DataFrame:
    """F13 and the URL rules."""
    h, u = F.col("host"), F.lower("url")
    any_of = lambda names: R.condition(R.Spec("url", "contains_any", names), lambda f: f)[0]
    return _hosts(spark, folder).select(
        "page_id", u.rlike(r"^[a-z]+://\d{1,3}(\.\d{1,3}){3}").alias("ip_literal"), u.contains("xn--").alias("punycode"), F.col("url").rlike("^[a-z]+://[^/]*@").alias("at_sign"),
        X.suffix_any(h, V.SUSPICIOUS_TLDS).alias("odd_tld"), X.suffix_any(h, V.SHORTENERS).alias("shortener"), (F.size(F.split(h, r"\.")) > 3).alias("many_subdomains"), any_of(("password", "wallet", "recover", "unlock")).alias("keywords"),
    )


@query(f"""WITH h AS (SELECT DISTINCT {HOST} AS host FROM pages UNION SELECT DISTINCT concat('my', {HOST}) FROM pages WHERE page_id % 3 = 0), k AS (SELECT host, substr(host, i) AS tail, i FROM h, range(2, 80) t(i) WHERE i <= length(host) AND substr(host, i - 1, 1) <> '.')
SELECT k.host AS a, o.host AS b FROM k JOIN h o ON o.host = k.tail WHERE regexp_matches(substr(k.host, i - 1, 1), '[a-z0-9]')""")
def lookalike_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts, and look-alikes of a third of them, that end with another host without a dot between. Every ending of a host is looked up by equality, so
    no pairs of hosts are tried."""
    hosts = _hosts(spark, folder)
    h = hosts.select("host").unionByName(hosts.filter("page_id % 3 = 0").select(F.concat(F.lit("my"), "host").alias("host"))).distinct()
    tails = h.select("host", F.explode(F.sequence(F.lit(2), F.greatest(F.length("host"), F.lit(2)))).alias("i")).withColumn("tail", F.expr("substr(host, i)"))
    j = tails.join(h.select(F.col("host").alias("b")), F.col("tail") == F.col("b"))
    return j.filter(X.lookalike(F.col("host"), F.col("b"))).select(F.col("host").alias("a"), "b")


@query(f"""WITH h AS (SELECT DISTINCT {HOST} AS host FROM pages) SELECT string_split(host, '.')[1] AS owner, count(*) AS hosts FROM h GROUP BY 1""")
def same_owner(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts with the same first label."""
    return _hosts(spark, folder).select("host").distinct().groupBy(F.split("host", r"\.")[0].alias("owner")).agg(F.count("*").alias("hosts"))


_IP_SQL = r"'\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'"
_PRIVATE = r"'^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)'"


@query(rf"""WITH i AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, {_IP_SQL}))) AS ioc, 'ip' AS kind FROM documents
UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}'))), 'email' FROM documents
UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[0-9a-fA-F]{{32}}\b'))), 'md5' FROM documents
UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[0-9a-fA-F]{{64}}\b'))), 'sha256' FROM documents)
SELECT doc_id, CASE WHEN kind = 'ip' AND regexp_matches(ioc, {_PRIVATE}) THEN 'private_ip' ELSE kind END AS kind, ioc FROM i""")
def ioc_text(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses and hashes of every text in long form, each once a text."""
    found = {"ip": X.IPV4, "email": X.EMAIL, "md5": X.MD5, "sha256": X.SHA256}

    def listed(kind: str, pattern: str):
        return F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("ioc")))

    lists = [listed(k, p) for k, p in found.items()]
    x = _docs(spark, folder, "text").select("doc_id", F.explode(F.concat(*lists)).alias("i"))
    kind = F.when((F.col("i.kind") == "ip") & X.private_ip(F.col("i.ioc")), "private_ip").otherwise(F.col("i.kind"))
    return x.select("doc_id", kind.alias("kind"), F.col("i.ioc").alias("ioc"))


@query(f"SELECT host AS ioc, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, {HOST} AS host FROM pages) GROUP BY 1 ORDER BY n DESC, ioc LIMIT 20")
def ioc_top(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent hosts, a report of 20."""
    return _hosts(spark, folder).groupBy(F.col("host").alias("ioc")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages")).orderBy(F.desc("n"), "ioc").limit(20)


@query(rf"""SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: x <> ''))) AS links, length(regexp_replace(regexp_replace(html, '(?is)<(?:style|script)[^>]*>.*?</(?:style|script)>', '', 'g'), '(?s)<[^>]+>', '', 'g')) AS visible,
regexp_matches(html, '(?i)<input[^>]+type=["'']?password') AS password_field, contains(lower(html), 'file:///') AS file_uri, (length(html) - length(replace(html, '<!--', ''))) / 4 > 0 AS comments FROM pages""")
def html_features(spark: SparkSession, folder: str) -> DataFrame:
    """F26 F52 and the HTML rules: links, visible length, password fields, file links, comments."""
    h = F.col("html")
    links = F.size(F.array_distinct(F.filter(F.regexp_extract_all(h, F.lit('href="([^"]*)"'), F.lit(1)), lambda x: x != "")))
    return table(spark, folder, "pages").select(
        "page_id", links.cast("long").alias("links"), F.length(X.tags_removed(h)).cast("long").alias("visible"), h.rlike("""(?i)<input[^>]+type=["']?password""").alias("password_field"),
        F.lower(h).contains("file:///").alias("file_uri"), h.contains("<!--").alias("comments"),
    )


@query(r"""WITH f AS (SELECT page_id, concat(html, '<p style="display:none">hidden words of page ', page_id, '</p>') AS html FROM pages)
SELECT page_id, regexp_extract(html, '(?is)<p[^>]*style="[^"]*display\s*:\s*none[^"]*"[^>]*>(.*?)</p>', 1) AS hidden FROM f""")
def hidden_text(spark: SparkSession, folder: str) -> DataFrame:
    """text that a style hides; each page carries one such paragraph."""
    html = F.concat("html", F.lit('<p style="display:none">hidden words of page '), F.col("page_id").cast("string"), F.lit("</p>"))
    found = F.regexp_extract(html, r"""(?is)<([a-z]+)[^>]*style\s*=\s*["'][^"']*display\s*:\s*none[^"']*["'][^>]*>(.*?)</\1>""", 2)
    return table(spark, folder, "pages").select("page_id", found.alias("hidden"))


@query(rf"""WITH a AS (SELECT page_id, concat('<a href="', url, '">www.other-', page_id % 7, '.example</a>') AS html FROM pages),
x AS (SELECT page_id, lower(regexp_extract(regexp_extract(html, 'href="([^"]*)"', 1), '^[A-Za-z]+://([^/:?#]+)', 1)) AS target, regexp_extract(html, '>([^<]*)</a>', 1) AS shown FROM a)
SELECT page_id, target, shown, target <> shown AS mismatch FROM x""")
def anchor_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """The shown host against the host that the link leads to."""
    html = F.concat(F.lit('<a href="'), "url", F.lit('">www.other-'), (F.col("page_id") % 7).cast("string"), F.lit(".example</a>"))
    p = table(spark, folder, "pages").select("page_id", X.url_host(F.regexp_extract(html, 'href="([^"]*)"', 1)).alias("target"), F.regexp_extract(html, ">([^<]*)</a>", 1).alias("shown"))
    return p.withColumn("mismatch", F.col("target") != F.col("shown"))


_NAME = "concat(replace(p_name, ' ', '.'), '.', ['pdf', 'exe', 'docm', 'zip', 'jpg'][p_partkey % 5 + 1])"


@query(f"""SELECT p_partkey, filename, ext, len(string_split(lower(filename), '.')) >= 3 AND ext IN ({_sql_list(V.EXT_HIGH + V.EXT_MEDIUM)}) AS double_ext,
CASE WHEN ext IN ({_sql_list(V.EXT_HIGH)}) THEN 'high' WHEN ext IN ({_sql_list(V.EXT_MEDIUM)}) THEN 'medium' WHEN ext IN ({_sql_list(V.EXT_LOW)}) THEN 'low' ELSE 'none' END AS risk, length(filename) > 20 AS overlong
FROM (SELECT p_partkey, filename, lower(regexp_extract(filename, '([^.]*)$', 1)) AS ext FROM (SELECT p_partkey, {_NAME} AS filename FROM part))""")
def filename_features(spark: SparkSession, folder: str) -> DataFrame:
    """Extension classes and double extensions of attachment names."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), F.element_at(F.array(*map(F.lit, ("pdf", "exe", "docm", "zip", "jpg"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    x = table(spark, folder, "part").select("p_partkey", name.alias("filename")).withColumn("ext", X.extension(F.col("filename")))
    e = F.col("ext")
    risk = F.when(e.isin(*V.EXT_HIGH), "high").when(e.isin(*V.EXT_MEDIUM), "medium").when(e.isin(*V.EXT_LOW), "low").otherwise("none")
    return x.select("p_partkey", "filename", "ext", X.double_extension(F.col("filename")).alias("double_ext"), risk.alias("risk"), (F.length("filename") > 20).alias("overlong"))


@query("""SELECT doc_id, n_letters, CASE WHEN n_letters > 0 THEN round(n_upper / n_letters, 9) ELSE 0.0 END AS upper_ratio FROM (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS n_letters,
length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) AS n_upper FROM documents)""".replace("\\\\", "\\"))
def upper_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """F27."""
    n = F.length(F.regexp_replace("text", r"[^\p{L}]", "")).cast("long")
    return _docs(spark, folder, "text").select("doc_id", n.alias("n_letters"), F.round(X.upper_ratio(F.col("text")), 9).alias("upper_ratio"))


@query("SELECT c_custkey, translate(lower(c_name), '01345', 'olesa') AS folded, len(regexp_extract_all(c_name, '[0-9]')) > 4 AS numeric_noise FROM customer")
def leet_fold(spark: SparkSession, folder: str) -> DataFrame:
    """F31 and the numeric-noise rule."""
    return table(spark, folder, "customer").select("c_custkey", X.leet(F.lower("c_name")).alias("folded"), (F.regexp_count("c_name", F.lit("[0-9]")) > 4).alias("numeric_noise"))
