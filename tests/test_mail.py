import io
import json
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mailglass.functions import folding
from mailglass.operators import attachments as A
from mailglass.sources import mail, sinks
from mailglass.streaming import watch


def message(subject, text, html=None, files=(), auth=None):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "Some One <one@example.com>", "two@example.org", subject
    if auth:
        m["Authentication-Results"] = auth
    m.set_content(text)
    if html:
        m.add_alternative(html, subtype="html")
    for name, data in files:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m.as_bytes()


def zipped(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, b"x" * 20)
    return out.getvalue()


@pytest.fixture
def mails(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.eml").write_bytes(message("Grüße", "plain text", "<p>rich</p>", [("x.pdf.exe", b"MZ" + b"\0" * 30), ("b.zip", zipped("c.exe"))], "mx; spf=fail; dkim=none"))
    (tmp_path / "in/sub/b.eml").write_bytes(message("second", "more text"))
    (tmp_path / "in/note.txt").write_text("no mail")
    return tmp_path


def test_messages_are_parsed(spark, mails):
    rows = {r.headers["subject"][0]: r for r in mail.read_mails(spark, str(mails / "in")).collect()}
    a = rows["Grüße"]
    assert set(rows) == {"Grüße", "second"} and a.body_text.strip() == "plain text" and a.body_html.strip() == "<p>rich</p>"
    assert [(x.filename, x.extension, x.size) for x in a.attachments][0] == ("x.pdf.exe", "exe", 32) and a.auth_results == ["mx; spf=fail; dkim=none"]
    large = mail.read_mails(spark, str(mails / "in"), max_bytes=10).collect()
    assert len(large) == 2 and all(r.raw_size > 0 and r.body_text is None and r.headers is None for r in large)


def test_stream_takes_each_message_once(spark, mails):
    got = []
    step = lambda df, i: got.extend(r.headers["subject"][0] for r in df.collect())
    for _ in range(2):
        watch.run_watch(watch.mail_stream(spark, str(mails / "in")), step, str(mails / "cp")).awaitTermination(120)
    assert sorted(got) == ["Grüße", "second"]
    (mails / "in/c.eml").write_bytes(message("third", "text"))
    watch.run_watch(watch.mail_stream(spark, str(mails / "in")), step, str(mails / "cp")).awaitTermination(120)
    assert sorted(got) == ["Grüße", "second", "third"]


def test_archives(spark):
    inner = zipped("deep.docm")
    nested = io.BytesIO()
    with zipfile.ZipFile(nested, "w") as z:
        z.writestr("in.zip", inner)
    rows = [(1, zipped("a.txt"), "password: abc123"), (2, zipped(*[f"{i}" for i in range(201)]), None), (3, nested.getvalue(), ""), (4, b"Rar!\x1a\x07xx", ""), (5, b"plain", ""), (6, b"PK\x03\x04broken", ""), (7, None, None), (8, zipped("dir/run.exe"), "")]
    got = {r.id: r.archive for r in A.with_archives(spark.createDataFrame(rows, "id int, content binary, body string")).collect()}
    assert got[1].entries == 1 and not got[1].has_executable and got[2].bomb_guard and got[3].has_macro and got[3].nested_depth == 1
    assert got[4].unreadable and got[5] is None and got[6].unreadable and got[7] is None and got[8].has_executable


def test_types_and_disguises(spark):
    rows = [(b"MZ..", "exe", "pe"), (b"PK\x03\x04", "docx", "zip"), (b"%PDF-1", "exe", "pdf"), (b"  <HTML><body>", "pdf", "html"), (b"just some plain words", "xls", "text"), (b"\x00\x01", "bin", "unknown"), (b"", "x", "unknown"), (None, "x", "unknown"), (b"\0" * 0x8001 + b"CD001", "iso", "iso")]
    df = spark.createDataFrame([(d, e) for d, e, _ in rows], "d binary, e string")
    x = df.select(A.real_type(F.col("d")).alias("k"), A.type_mismatch(A.real_type(F.col("d")), F.col("e")).alias("m"), A.mime_conflict(F.lit("application/pdf; x=y"), A.real_type(F.col("d"))).alias("c"), A.generic_mime(F.lit("application/octet-stream"), F.col("e")).alias("g")).collect()
    assert [r.k for r in x] == [k for *_, k in rows]
    assert [r.m for r in x][:5] == [False, False, True, False, False] and [r.c for r in x][:4] == [True, True, False, False] and [r.g for r in x][:2] == [True, True]
    assert spark.range(1).select(A.bidi_name(F.lit("a‮gpj.exe")).alias("b")).first().b


def test_folding(spark):
    df = spark.createDataFrame([("PаyPal",), ("pa​ypal",), ("café",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(folding.fold_text(F.col("t"))).collect()] == ["PayPal", "paypal", "cafe", "plain", None]
    df = spark.createDataFrame([("h­ttp:\\/\\/evil.example",), ("hxxp://evil[.]com &amp;",)], "t string")
    assert [r[0] for r in df.select(folding.refang(F.col("t"))).collect()] == ["http://evil.example", "hxxp://evil[.]com &"]


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "words.txt").write_text("# note\nAlpha\n\nbeta gamma\n")
    assert [tuple(r) for r in mail.read_terms(spark, str(tmp_path / "words.txt")).collect()] == [("words", "alpha"), ("words", "beta gamma")]
    (tmp_path / "list.json").write_text(json.dumps({"name": "n", "list": ["a", "b"]}))
    assert [tuple(r) for r in mail.read_warning_lists(spark, str(tmp_path / "list.json")).collect()] == [("n", 0, "a"), ("n", 1, "b")]
    (tmp_path / "index").write_text("SPAM ../data/1\nham ../data/2\n")
    assert [tuple(r) for r in mail.read_index(spark, str(tmp_path / "index")).collect()] == [("spam", "../data/1"), ("ham", "../data/2")]
    (tmp_path / "m.csv").write_text('subject,label,attachment_types\n"a, b",0,x.pdf;y.ics\nc,1,\n')
    assert [(r.subject, r.spam, r.attachment_names) for r in mail.read_labelled_csv(spark, str(tmp_path / "m.csv")).collect()] == [("a, b", False, ["x.pdf", "y.ics"]), ("c", True, [])]
    (tmp_path / "r.json").write_text('{"report_id": "1", "score": 5, "verdict": "BENIGN"}\nbroken{\n')
    assert [r.report_id for r in mail.read_reports(spark, str(tmp_path / "r.json")).collect()] == ["1"]
    feed = sinks.indicator_feed(spark.createDataFrame([("url", "u"), ("ip", "i"), ("ip", "j"), ("ip", "j")], "kind string, ioc string"))
    assert [r.value for r in feed.collect()] == ["IP\tj\t2", "IP\ti\t1", "URL\tu\t1"]
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    alert = spark.range(1).select(sinks.alert_payload(F.lit("MALICIOUS"), F.lit("t"), F.array(F.lit("o"))).alias("p")).first().p
    assert json.loads(alert)["severity"] == 4
