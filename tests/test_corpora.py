"""Labelled corpora become mails that score like messages of the same content."""

from collections import Counter

from pyspark.sql import functions as F

from mailglass import rulebook
from mailglass.operators.mail_scoring import analysed
from mailglass.sources import corpora
from mailglass.sources.mail import parse_mails

COLUMNS = "subject body_plain body_html from_address from_domain to_addresses reply_to message_id date spf_result dkim_result dmarc_result user_agent has_attachments attachment_types label".split()


def test_rows_of_a_table(spark, tmp_path):
    rows = [
        ["Hi", "see you at noon", "", "ann@shop.example.org", "example.org", "me@x.org", "", "<1@x>", "Mon, 1 Jan 2024 08:00:00 +0000", "pass", "pass", "pass", "", "false", "a.pdf", "0"],
        ["Verify now", "Verify your account within 24 hours: http://203.0.113.7/login", "", "", "", "", "r@other.example", "", "", "fail", "", "fail", "", "true", "invoice.pdf.exe;b.ics", "1"],
        ["Verify now", "Verify your account within 24 hours: http://203.0.113.7/login", "", "", "", "", "r@other.example", "", "", "fail", "", "fail", "", "true", "invoice.pdf.exe;b.ics", "1"],
    ]
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    (tmp_path / "m.csv").write_text("\n".join(",".join(map(quote, r)) for r in [COLUMNS, *rows]))
    mails = corpora.read_table_corpus(spark, str(tmp_path / "m.csv"))
    assert [f.name for f in parse_mails(spark.createDataFrame([], "path string, content binary")).schema] == mails.columns[:-1]
    got = analysed(mails, rulebook.builtin()).orderBy("score").collect()
    assert [(r.spam, r.verdict) for r in got] == [(False, "BENIGN"), (True, "MALICIOUS"), (True, "MALICIOUS")]
    bad = got[1]
    assert bad.headers["from"] == ["unknown@unknown.invalid"] and bad.headers["reply-to"] == ["r@other.example"] and "message-id" not in bad.headers
    assert bad.auth.spf == "fail" and bad.auth.dkim == "none" and [(a.filename, a.content_type) for a in bad.attachments] == [("invoice.pdf.exe", "application/octet-stream"), ("b.ics", "application/calendar")]
    assert {"att_double_ext", "att_ext_high_risk"} <= {s.id for s in bad.signals} and got[0].attachments == []
    counts = Counter((r.spam, r.verdict) for r in got)
    assert {(r.spam, r.verdict): r["count"] for r in analysed(mails, rulebook.builtin()).groupBy("spam", "verdict").count().collect()} == counts


def test_whole_text_files(spark, tmp_path):
    for name, data in {
        "e1/ham/0001.1999-12-10.farmer.ham.txt": b"Subject: caf\xe9 \x96 plan\r\n\r\nfirst\rsecond\r\n",
        "e1/spam/0002.2003-02-30.BG.spam.txt": "﻿subject:  buy ü\n\n \nnow\n".encode(),
        "e1/ham/0003.2001-05-05.a.b.ham.TXT.txt": b"x",
        "e1/ham/0004.2001-05-05.kaminski-v.ham.txt": b"no first line",
        "e1/Summary.txt": b"Subject: not a mail",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    mails = corpora.read_text_corpus(spark, str(tmp_path))
    got = {r.owner: r for r in mails.collect()}
    assert set(got) == {"farmer", "bg", "kaminski-v"}
    one, two, three = (got[k] for k in ("farmer", "bg", "kaminski-v"))
    assert (one.headers, one.body_text, one.spam) == ({"subject": ["café – plan"], "date": ["Fri, 10 Dec 1999 00:00:00 +0000"]}, "first\nsecond\n", False)
    assert (two.headers, two.body_text, two.spam) == ({"subject": ["buy ü"]}, "now\n", True)
    assert (three.headers["subject"], three.body_text) == (["(no subject)"], "no first line")
    assert len({r.mail_id for r in got.values()}) == 3
    assert {r.verdict for r in analysed(mails, rulebook.builtin()).select("verdict").collect()} == {"BENIGN"}
    assert corpora.mails_of_texts(spark.createDataFrame([("/a/0001.1999-12-10.x.ham.txt", None)], "path string, content binary")).select(F.coalesce("body_text", F.lit("none"))).first()[0] == "none"
