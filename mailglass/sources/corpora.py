"""Labelled corpora as mails: rows of sources.mail.parse_mails with `spam`, so that they can be scored and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass.functions.names import safe_file_name
from mailglass.sources.mail import FILES, read_labelled_csv

#: How a whole-text file is named (number, date, owner, kind); kinds of attachments by extension.
NAME = r"(?i)(\d+)\.(\d{4}-\d{2}-\d{2})\.(.+?)\.(ham|spam)\.txt$"
IMAGES = ("png", "jpg", "jpeg", "gif")
KINDS = {"pdf": "application/pdf", "ics": "application/calendar", "zip": "application/zip", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
PLACEHOLDER = b"placeholder"
UNKNOWN = "unknown@unknown.invalid"


def headers(**values: Column) -> Column:
    """A mail's headers; those that are null or empty are left out."""
    pairs = [c for k, v in values.items() for c in (F.lit(k.replace("_", "-")), F.filter(F.array(v), lambda x: x.isNotNull() & (x != "")))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


def mail_row(path: Column, head: Column, auth: Column, text: Column, html: Column, files: Column) -> list[Column]:
    """The columns of a mail; its id follows from all that it says."""
    size = F.length(text) + F.length(html)
    made = {"path": path, "mail_id": F.sha2(F.concat_ws("\x1f", path, F.to_json(head), text, html), 256).substr(1, 32), "raw_size": size.cast("long"), "headers": head, "auth_results": auth, "body_text": text, "body_html": html, "attachments": files, "inline_images": F.lit(0)}
    return [c.alias(name) for name, c in made.items()]


def attachment(name: Column, idx: Column) -> Column:
    """A placeholder of the given name."""
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("bin")
    kind = F.coalesce(*[F.when(ext == k, F.lit(v)) for k, v in KINDS.items()], F.when(ext.isin(*IMAGES), F.concat(F.lit("image/"), ext)), F.lit("application/octet-stream"))
    data = F.lit(PLACEHOLDER)
    return F.struct(idx.cast("int").alias("idx"), name.alias("filename"), kind.alias("content_type"), F.length(data).cast("long").alias("size"), F.sha2(data, 256).alias("sha256"), F.md5(data).alias("md5"), ext.alias("extension"), data.alias("content"))


def mails_of_table(rows: DataFrame) -> DataFrame:
    """Rows of sources.mail.read_labelled_csv as mails with `spam`. Missing senders, subjects and results get what a mail of that
    kind has: an unknown sender, a bounce address of the sender's domain, results `none`."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    bare = lambda c: F.trim(F.regexp_replace(text(c), r"[\r\n]+", " "))
    sender = F.when(bare("from_address") == "", F.lit(UNKNOWN)).otherwise(bare("from_address"))
    domain = F.when(text("from_domain") != "", text("from_domain")).otherwise(F.substring_index(sender, "@", -1))
    result = lambda c: F.when(text(c) == "", "none").otherwise(F.lower(text(c)))
    auth = F.concat(F.lit("mx.local; spf="), result("spf_result"), F.lit(" smtp.mailfrom="), domain, F.lit("; dkim="), result("dkim_result"), F.lit("; dmarc="), result("dmarc_result"))
    head = headers(
        **{"from": sender, "to": F.when(bare("to_addresses") == "", F.lit("undisclosed-recipients:;")).otherwise(bare("to_addresses")), "reply_to": bare("reply_to"), "return_path": F.concat(F.lit("<bounce@"), domain, F.lit(">"))},
        subject=F.when(text("subject") == "", "(no subject)").otherwise(bare("subject")), message_id=text("message_id"), date=text("date"), user_agent=text("user_agent"),
    )
    has = F.lower(text("has_attachments")).isin("true", "1", "yes")
    files = F.transform(F.when(has, F.col("attachment_names")).otherwise(F.array().cast("array<string>")), lambda n, i: attachment(n, i))
    key = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])), 256).substr(1, 12)
    path = F.concat(F.lit("table/"), safe_file_name(bare("subject"), F.lit("mail")), F.lit("_"), key, F.lit(".eml"))
    return rows.select(*mail_row(path, head, F.array(auth), text("body_plain"), text("body_html"), files.cast(FILES)), "spam")


def read_table_corpus(spark: SparkSession, path: str) -> DataFrame:
    return mails_of_table(read_labelled_csv(spark, path))


#: Bytes that Windows' Latin letters use and ISO 8859-1 does not.
_WINDOWS = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]


def decoded_text(content: Column) -> Column:
    """The text of bytes: UTF-8 if they are, else Windows' Latin letters (its five unused bytes as ISO 8859-1 has them)."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(utf8, F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, _WINDOWS)), bytes(_WINDOWS).decode("cp1252")))


def mails_of_texts(files: DataFrame) -> DataFrame:
    """Files (path, content) whose names say number, date, owner and kind, and whose first line is `Subject: ...`, as mails with
    `spam` and `owner`. Files of other names are left out. Such mails know no sender, addressee or authentication; a date that is
    none stays out of the headers."""
    name = F.element_at(F.split(F.url_decode("path"), "/"), -1)
    part = lambda i: F.regexp_extract(name, NAME, i)
    text = F.regexp_replace(F.regexp_replace(decoded_text(F.col("content")), "^﻿", ""), r"\r\n?", "\n")
    first = r"(?i)^subject:([^\n]*)"
    x = files.filter(name.rlike(NAME)).select("path", part(2).alias("date"), F.lower(part(3)).alias("owner"), (F.lower(part(4)) == "spam").alias("spam"), text.alias("text"))
    subject = F.trim(F.regexp_extract("text", first, 1))
    body = F.regexp_replace(F.regexp_replace("text", first, ""), r"^(?:[^\S\n]*\n)+", "")
    sent = F.date_format(F.try_to_date("date", "yyyy-MM-dd"), "EEE, d MMM yyyy")
    head = headers(subject=F.when(subject == "", "(no subject)").otherwise(subject), date=F.concat(sent, F.lit(" 00:00:00 +0000")))
    return x.select(*mail_row(F.col("path"), head, F.array().cast("array<string>"), body, F.lit(""), F.array().cast(FILES)), "spam", "owner")


def read_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All .txt files below a folder as mails; a file is read whole by one task. Spark lists no file without a byte."""
    return mails_of_texts(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(folder))
