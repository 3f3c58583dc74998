"""Queries over content: folding, macros, content families, file types by first bytes, passwords, parsed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass.functions import folding
from mailglass.functions import text as X
from mailglass.functions import values as V
from mailglass.operators import attachments as A
from mailglass.plans.registry import query, table


_PLAIN = "regexp_full_match(text, '[\\x00-\\x7F]*')"


@query(f"SELECT doc_id, folded, plain, folded = text AS same FROM (SELECT doc_id, text, {_PLAIN} AS plain, CASE WHEN {_PLAIN} THEN text ELSE strip_accents(text) END AS folded FROM documents)")
def fold_ascii(spark: SparkSession, folder: str) -> DataFrame:
    """Every text folded, which texts are plain, and which folding leaves alone, as it does all plain ones."""
    text = F.col("text")
    x = table(spark, folder, "documents").select("doc_id", "text", folding.fold_text(text).alias("folded"))
    return x.select("doc_id", "folded", (~text.rlike(folding.NOT_ASCII)).alias("plain"), (F.col("folded") == text).alias("same"))


@query("SELECT doc_id, strip_accents(text) AS folded FROM documents")
def fold_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Letters without their marks."""
    return table(spark, folder, "documents").select("doc_id", folding.fold_text(F.col("text")).alias("folded"))


@query()
def fold_texts(spark: SparkSession, folder: str) -> DataFrame:
    """F01 F02 on every text, as it is and with an invisible character, look-alike, styled and marked letters put in."""
    text = F.col("text")
    masked = F.translate(F.concat(F.substring(text, 1, 1), F.lit("\u200b"), F.expr("substring(text, 2)")), "aeoBd", "аеοВｄ")
    masked = F.replace(masked, F.lit("t"), F.lit("t\u0301"))
    return table(spark, folder, "documents").select("doc_id", folding.fold_text(text).alias("folded"), folding.fold_text(masked).alias("unmasked"))


@query("SELECT page_id, url AS refanged FROM pages")
def refang_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses with an invisible character and an escaped slash put in, made plain again."""
    broken = F.replace(F.concat(F.substring("url", 1, 2), F.lit("­"), F.expr("substring(url, 3)")), F.lit("/"), F.lit("\\/"))
    return table(spark, folder, "pages").select("page_id", folding.refang(broken).alias("refanged"))


_MACRO = "concat('Sub ', ['AutoOpen', 'Document_Open', 'Main', 'Helper'][p_partkey % 4 + 1], ' ', ['Shell x', 'CreateObject y', 'z = 1'][p_partkey % 3 + 1], ' ', ['Chr(65)', 'StrReverse a', 'b'][p_size % 3 + 1], ' ', p_name)"


@query(
    f"SELECT p_partkey, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(code, $$(?i){p}$$) THEN {chr(39)}{n}{chr(39)} END' for n, p in V.MACRO_PATTERNS.items())}], lambda x: x IS NOT NULL), '+') AS findings FROM (SELECT p_partkey, {_MACRO} AS code FROM part)"
)
def macro_grading(spark: SparkSession, folder: str) -> DataFrame:
    """What macro sources do; each part's name stands in a macro."""
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    k, s = F.col("p_partkey"), F.col("p_size")
    code = F.concat_ws(" ", F.lit("Sub"), pick(["AutoOpen", "Document_Open", "Main", "Helper"], k % 4), pick(["Shell x", "CreateObject y", "z = 1"], k % 3), pick(["Chr(65)", "StrReverse a", "b"], s % 3), "p_name")
    return table(spark, folder, "part").select("p_partkey", F.array_join(A.macro_findings(code), "+").alias("findings"))


@query(r"""WITH t AS (SELECT page_id, html, concat(html, CASE page_id % 3 WHEN 0 THEN '<form action=x><input type="password"> please sign in' WHEN 1 THEN 'urgent: verify your account at hxxp://x' ELSE '' END) AS text FROM pages)
SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?is)urgent|immediately|within\s+24\s+hours|action\s+required') AND (regexp_matches(text, '(?is)verify\s+your\s+(account|identity)|confirm\s+your\s+password|update\s+your\s+billing') OR regexp_matches(text, '(?is)<form[^>]*(action|method)')) THEN 'credential_keywords' END,
CASE WHEN regexp_matches(text, '(?is)<(!doctype\s+)?html') AND regexp_matches(text, '(?is)<input[^>]*type=["'']?password') AND regexp_matches(text, '(?is)login|sign\s?in|verify|confirm') THEN 'login_page' END,
CASE WHEN regexp_matches(text, '(?is)hxxps?://') OR regexp_matches(text, '(?is)https?://[^\s/]+@[^\s/]+') OR regexp_matches(text, 'https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') THEN 'obfuscated_url' END], lambda x: x IS NOT NULL), '+') AS families FROM t""")
def content_families(spark: SparkSession, folder: str) -> DataFrame:
    """Content families of pages, two of three with a lure put in."""
    more = F.when(F.col("page_id") % 3 == 0, '<form action=x><input type="password"> please sign in').when(F.col("page_id") % 3 == 1, "urgent: verify your account at hxxp://x").otherwise("")
    return table(spark, folder, "pages").select("page_id", F.array_join(A.content_families(F.concat("html", more)), "+").alias("families"))


_MAGIC = ("25504446", "4D5A", "504B0304", "89504E470D0A1A0A", "")


@query(f"""SELECT doc_id, kind, ext, kind NOT IN ('text', 'html', 'unknown') AND NOT (CASE kind WHEN 'pdf' THEN ext = 'pdf' WHEN 'pe' THEN ext IN ('exe') WHEN 'zip' THEN ext IN ('docx') WHEN 'png' THEN ext = 'png' ELSE false END) AS mismatch
FROM (SELECT doc_id, ['pdf', 'pe', 'zip', 'png', CASE WHEN octet_length(encode(text)) >= 16 THEN 'text' ELSE 'unknown' END][doc_id % 5 + 1] AS kind, ['pdf', 'exe', 'docx', 'png'][doc_id % 4 + 1] AS ext FROM documents)""")
def real_types(spark: SparkSession, folder: str) -> DataFrame:
    """Types by content of texts that begin with the first bytes of four formats, against a claimed extension."""
    magic = F.element_at(F.array(*map(F.lit, _MAGIC)), (F.col("doc_id") % 5 + 1).cast("int"))
    data = F.concat(F.unhex(magic), F.encode("text", "utf-8"))
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "exe", "docx", "png"))), (F.col("doc_id") % 4 + 1).cast("int"))
    x = table(spark, folder, "documents").select("doc_id", A.real_type(data).alias("kind"), ext.alias("ext"))
    return x.withColumn("mismatch", A.type_mismatch(F.col("kind"), F.col("ext")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE doc_id % 3 = 0 END AS script FROM documents")
def pdf_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """X11: script markers in texts that begin as PDF; null for the rest."""
    head = F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7 /JS ").when(F.col("doc_id") % 3 == 1, "%PDF-1.7 ").otherwise("")
    return table(spark, folder, "documents").select("doc_id", A.pdf_markers(A.latin(F.encode(F.concat(head, "text"), "utf-8")))["javascript"].alias("script"))


_STATED = "concat('pwd is ', regexp_extract(text, '[A-Za-z0-9]{3,32}'), chr(10), text)"


@query(rf"""SELECT doc_id, regexp_replace(regexp_extract({_STATED}, '(?i)(?:password|passcode|passwd|pwd)\s*(?:is|[:：=])?\s*([A-Za-z0-9@#$%^&*_\-+.]{{3,32}})', 1), '^\.+|\.+$', '', 'g') AS first_candidate FROM documents""")
def archive_passwords(spark: SparkSession, folder: str) -> DataFrame:
    """the first word that may open an archive, for every text; each begins with a statement of one of its own words."""
    text = F.concat(F.lit("pwd is "), F.regexp_extract("text", "[A-Za-z0-9]{3,32}", 0), F.lit("\n"), "text")
    return table(spark, folder, "documents").select("doc_id", F.coalesce(F.get(A.password_candidates(text), F.lit(0)), F.lit("")).alias("first_candidate"))


@query()
def archive_password_lists(spark: SparkSession, folder: str) -> DataFrame:
    """all words that may open an archive, for every text; each begins with up to nine more, some of them twice."""
    one = lambda i: F.concat(F.element_at(F.array(*map(F.lit, ("Password: ", "pwd=", "the passcode is ", "PASSWD："))), i % 4 + 1), F.lit("k"), (F.col("doc_id") % 7 * (i % 6)).cast("string"), F.lit("-x\n"))
    lead = F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(9)), 1, (F.col("doc_id") % 10).cast("int")), one), "")
    return table(spark, folder, "documents").select("doc_id", A.password_candidates(F.concat(lead, "text")).alias("candidates"))


@query("SELECT doc_id, regexp_matches(text, '[­​-‏⁠-⁤﻿]') AS hidden FROM documents")
def invisible_text(spark: SparkSession, folder: str) -> DataFrame:
    """F03 U01."""
    return table(spark, folder, "documents").select("doc_id", X.invisible_obfuscation(F.col("text")).alias("hidden"))
