"""Mail sources: folders of messages, labelled tables, word lists, reports."""

from __future__ import annotations

import email
import email.policy
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass.functions.batches import bounded

#: Headers that are kept, in lower case; all received lines are kept in order.
HEADERS = (
    "from", "to", "cc", "subject", "date", "message-id", "reply-to", "return-path", "sender", "x-mailer", "user-agent", "content-type", "list-unsubscribe", "list-id", "list-post", "precedence", "received-spf", "x-originating-ip",
    "received",
)
MAX_BYTES = 20 << 20
#: Bytes of one attachment, and of all of a mail's, whose content is kept; larger ones keep name, size and hashes.
MAX_PART, MAX_PARTS = 5 << 20, 20 << 20
#: Names that mails give to character sets, and what they mean by them.
CHARSETS = {"gb2312": "gb18030", "gbk": "gb18030", "gb_2312-80": "gb18030", "ks_c_5601-1987": "cp949", "hz-gb-2312": "hz"}

FILES = "array<struct<idx int, filename string, content_type string, size long, sha256 string, md5 string, extension string, content binary>>"
MAIL = f"""path string, mail_id string, raw_size long, headers map<string, array<string>>, auth_results array<string>, body_text string, body_html string,
attachments {FILES}, inline_images int"""


def readable(text: str) -> float:
    """How well a decoding turned out: the share of ASCII and Chinese characters less four times that of broken ones."""
    if not text:
        return -1.0
    broken = sum(c == "\ufffd" or (c < " " and c not in "\t\n\r\f") for c in text)
    fine = sum(c.isascii() or "\u4e00" <= c <= "\u9fff" or "\u3000" <= c <= "\u303f" or "\uff00" <= c <= "\uffef" for c in text)
    fine -= sum(c < " " and c not in "\t\n\r\f" for c in text)
    return (fine - 4 * broken) / len(text)


def decoded(data: bytes, charset: str | None) -> str:
    """The most readable of the strict decodings by the stated set, UTF-8, GB18030 and Big5, the earlier of equal ones; with
    marks for what is broken if none fits."""
    stated = (charset or "").strip().strip('"').lower()
    texts = []
    for name in dict.fromkeys(filter(None, (CHARSETS.get(stated, stated), "utf-8", "gb18030", "big5"))):
        try:
            texts.append(data.decode(name))
        except (LookupError, UnicodeDecodeError):
            continue
    return max(texts, key=readable) if texts else data.decode("utf-8", "replace")


def clean_name(name: str) -> str:
    """An attachment's decoded name without path separators and zero bytes."""
    try:
        name = str(email.header.make_header(email.header.decode_header(name)))
    except Exception:  # a name that cannot be decoded stays as it is
        pass
    return name.replace("\\", "_").replace("/", "_").replace("\0", "").strip()


def parse_message(raw: bytes) -> dict:
    """A message's kept headers, results of authentication, texts and attachments. Without any text part, everything
    behind the first blank line is the text."""
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    nice = email.message_from_bytes(raw, policy=email.policy.default)
    headers: dict[str, list[str]] = {}
    for name in HEADERS:
        try:
            values = [str(v) for v in nice.get_all(name, [])]
        except Exception:  # a header that the strict parser refuses is read as it stands
            values = [str(v) for v in m.get_all(name, [])]
        if values:
            headers[name] = values
    plain, rich, files, images, held = [], [], [], 0, 0
    for part in m.walk():
        if part.is_multipart():
            continue
        kind, name = part.get_content_type(), clean_name(part.get_filename() or "")
        data = part.get_payload(decode=True)
        if name or part.get_content_disposition() == "attachment":
            data = data or b""
            fits = len(data) <= MAX_PART and held + len(data) <= MAX_PARTS
            held += len(data) if fits else 0
            files.append(
                dict(idx=len(files), filename=name or "(unnamed)", content_type=kind, size=len(data), sha256=hashlib.sha256(data).hexdigest(), md5=hashlib.md5(data).hexdigest(), extension=name.rsplit(".", 1)[-1].lower() if "." in name else "", content=data if fits else None)
            )
        elif data and kind.startswith("image/"):
            images += 1
        elif data is not None and kind in ("text/plain", "text/html"):
            (plain if kind == "text/plain" else rich).append(decoded(data, part.get_content_charset()))
    if not plain and not rich:
        ends = max(raw.find(b"\n\n"), raw.find(b"\r\n\r\n"))
        rest = raw[ends:].lstrip(b"\r\n") if ends > 0 else b""
        plain = [decoded(rest, None)] if rest else []
    return dict(headers=headers, auth_results=[str(v) for v in nice.get_all("authentication-results", [])], body_text="\n".join(plain), body_html="\n".join(rich), attachments=files, inline_images=images)


def parse_mails(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) as mails; content goes no further than its attachments."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, data in zip(p["path"], p["content"], strict=True):
                data = bytes(data)
                rows.append({"path": path, "mail_id": hashlib.sha256(data).hexdigest()[:32], "raw_size": len(data), **parse_message(data)})
            yield pd.DataFrame(rows, columns=["path", "mail_id", "raw_size", "headers", "auth_results", "body_text", "body_html", "attachments", "inline_images"])

    return bounded(files.select("path", "content")).mapInPandas(run, MAIL)


def read_mails(spark: SparkSession, folder: str, recursive: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All .eml files of a folder as mails. Larger files are not read; their path and size stay, all else is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    large = files.filter(F.col("length") > max_bytes).select("path", F.col("length").alias("raw_size"))
    return parse_mails(files.filter(F.col("length") <= max_bytes)).unionByName(large, allowMissingColumns=True)


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """A labelled table of mails: label 0 is ham, everything else spam; attachment names are split at semicolons."""
    t = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = F.filter(F.transform(F.split(F.coalesce("attachment_types", F.lit("")), ";"), F.trim), lambda x: x != "")
    return t.withColumns({"spam": F.coalesce(F.trim("label") != "0", F.lit(True)), "attachment_names": names})


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Lines `label path`."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).filter(F.trim("value") != "").select(F.lower(parts[0]).alias("label"), parts[1].alias("path"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary files: a term a line, # at a line's start is a comment; dict is the file's name."""
    t = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("dict"), F.lower(F.trim("value")).alias("term"))
    return t.filter((F.col("term") != "") & ~F.col("term").startswith("#"))


def read_warning_lists(spark: SparkSession, path: str) -> DataFrame:
    """JSON lists {name, list: [...]} in long form, the position kept."""
    j = spark.read.option("multiLine", True).schema("name string, list array<string>").json(path)
    return j.select("name", F.posexplode("list").alias("pos", "entry"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored reports; broken ones are left out."""
    schema = "report_id string, filename string, score int, verdict string, category string, created_at timestamp, _broken string"
    r = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return r.filter(F.col("_broken").isNull()).drop("_broken")
