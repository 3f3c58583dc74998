"""Committed state, the rebuild of history and the analysis of landed mail, on folders of real messages."""

import datetime
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mailglass import rulebook
from mailglass.functions.dates import mail_date, seen_at
from mailglass.operators import rebuild, state, trust
from mailglass.sources.state_tables import ConflictError, StateTables, purge_analysis

def now():
    return F.expr("timestamp'2024-03-01 00:00:00'")


def put(folder, name, sender="Ann <ann@shop.example.org>", to="me@corp.example.com", date="Mon, 1 Jan 2024 08:00:00 +0000", text="see https://www.shop.example.org/a", auth=True):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = sender, to, "hello", date
    if auth:
        m["Authentication-Results"] = "mx; spf=pass; dkim=pass; dmarc=pass"
    m.set_content(text)
    (folder / name).parent.mkdir(exist_ok=True, parents=True)
    (folder / name).write_bytes(m.as_bytes())


def files(spark, folder):
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(str(folder))


def history(tables):
    cols = ("addr", "domain", "count", "first_seen", "last_seen", "replied", "link_domains")
    return sorted(tuple(r[c] for c in cols) for r in tables.read("sender_history").collect())


def test_incremental_reads_new_files_only_and_equals_full(spark, tmp_path):
    box, one, two = tmp_path / "box", StateTables(spark, str(tmp_path / "one")), StateTables(spark, str(tmp_path / "two"))
    opts = dict(own=("me@corp.example.com",), sent_folders=("Sent",), now=now())
    run = lambda t, **k: rebuild.rebuild_history(t, "box", files(spark, box), **(opts | k))
    put(box, "in/1.eml")
    put(box, "in/2.eml", "bob@b.example.net", date="never")
    put(box, "Sent/1.eml", "me@corp.example.com", "Cy <CY@cy.example.org>, bob@b.example.net, me@corp.example.com")
    assert run(one, incremental=True) == {"files": 3, "processed": 3, "inbound": 2, "replied_marks": 2, "skipped": False}
    again = run(one, incremental=True)
    assert (again["processed"], again["skipped"], one.manifest()["version"]) == (0, True, 1)
    put(box, "in/3.eml", date="Wed, 31 Jan 2024 10:00:00 +0200", text="http://news.example.info/")
    put(box, "in/4.eml", "cy@cy.example.org")
    assert run(one, incremental=True)["processed"] == 2
    assert run(two)["processed"] == 5 and history(one) == history(two)
    got = {r[0]: r[1:] for r in history(one)}
    day = lambda *a: datetime.datetime(2024, *a)
    assert got["ann@shop.example.org"] == ("example.org", 2, day(1, 1, 8), day(1, 31, 8), False, ["example.info", "example.org"])
    assert got["bob@b.example.net"][1:5] == (1, day(3, 1), day(3, 1), True) and got["cy@cy.example.org"][:2] == ("example.org", 1)
    (box / "in/1.eml").unlink()
    assert run(one, incremental=True)["processed"] == 0 and len(history(one)) == 3  # what has gone keeps its part
    assert run(one)["skipped"] and run(one, force=True)["processed"] == 4
    assert {r[0]: r[2] for r in history(one)}["ann@shop.example.org"] == 1


def test_landed_mail_is_analysed_once(spark, tmp_path):
    box, t, book = tmp_path / "box", StateTables(spark, str(tmp_path / "t")), rulebook.builtin()
    put(box, "in/1.eml")
    put(box, "in/2.eml", "x@y.example.top", text="Verify your account within 24 hours http://203.0.113.7/login", auth=False)
    put(box, "Sent/3.eml", "me@corp.example.com")
    run = lambda **k: rebuild.analyse_landed(t, files(spark, box), book, own=("me@corp.example.com",), now=now(), **k)
    assert run() == {"files": 3, "analysed": 2} and run() == {"files": 3, "analysed": 0}
    first = sorted((r.path, r.score, r.verdict, r.report_id) for r in t.read("reports").collect())
    put(box, "in/4.eml")
    assert run()["analysed"] == 1 and run(full=True) == {"files": 4, "analysed": 3}
    assert sorted((r.path, r.score, r.verdict, r.report_id) for r in t.read("reports").filter("path not like '%4.eml'").collect()) == first
    assert first[0][2] == "BENIGN" and first[1][1] > first[0][1]


def test_a_crash_between_write_and_switch_loses_nothing(spark, tmp_path, monkeypatch):
    t = StateTables(spark, str(tmp_path))
    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string").withColumn("last_at", now())
    keys = lambda v=None: sorted(r.key for r in t.read("notify_state", v).collect())
    assert t.commit({"notify_state": rows("a")}) == 1
    held = t.read("notify_state")
    with monkeypatch.context() as m:
        m.setattr(StateTables, "_switch", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.commit({"notify_state": rows("b"), "reports": t.read("reports")})
    assert keys() == ["a"] and t.manifest()["version"] == 1
    assert t.commit({"notify_state": rows("a", "c")}) == 2
    assert keys() == ["a", "c"] and keys(1) == ["a"] and [r.key for r in held.collect()] == ["a"]
    with pytest.raises(ConflictError):
        t.commit({"notify_state": rows("late")}, base=1)
    with pytest.raises(ValueError):
        t.commit({"unheard_of": rows("x")})
    assert keys() == ["a", "c"] and t.vacuum(keep=1) >= 2 and keys() == ["a", "c"] and t.versions() == [2]


def test_tables_are_cleared_together(spark, tmp_path):
    t = StateTables(spark, str(tmp_path))
    mark = spark.createDataFrame([("a",)], "key string").withColumn("last_at", now())
    intel = spark.createDataFrame([("k", "{}")], "key string, value string").withColumns({"created_at": now(), "expires_at": now()})
    t.commit({"notify_state": mark, "intel_cache": intel})
    assert purge_analysis(t) == {"reports": 0, "report_index": 0, "notify_state": 1} and t.read("intel_cache").count() == 1
    assert purge_analysis(t, with_intel=True) == {"reports": 0, "report_index": 0, "notify_state": 0, "intel_cache": 1}
    assert t.manifest()["version"] == 3 and t.read("intel_cache").count() == 0


def test_an_own_letter_does_not_widen_trust(spark):
    """Five mails of one day: the sender is known. A letter to another address of the domain 20 days later changes nothing."""
    at = F.expr("timestamp'2024-01-01 00:00:00'")
    none = F.array().cast("array<string>")
    past = spark.createDataFrame([("a@x.example.org", 5)], "addr string, count long").select("addr", F.lit("example.org").alias("domain"), "count", at.alias("first_seen"), at.alias("last_seen"), F.lit(False).alias("replied"), none.alias("link_domains"))
    sent = spark.createDataFrame([({"to": ["new@x.example.org"]},)], "headers map<string,array<string>>")
    after = state.mark_replied(past, sent)
    new = after.filter("addr = 'new@x.example.org'").first()
    assert (new.domain, new.first_seen, new.last_seen, new["count"], new.replied) == ("", None, None, 0, True)
    mail = F.struct(F.struct(F.lit("a@x.example.org").alias("addr"), F.lit("example.org").alias("domain_reg")).alias("from"), none.alias("link_domains")).alias("mail")
    m = spark.range(1).select(mail, F.array().cast("array<struct<id:string,points:double,reason:string>>").alias("signals"))
    said = spark.createDataFrame([], "scope string, key string, verdict string, expires_at timestamp, note string")
    for h in (past, after):
        assert trust.with_trust(m, h, said, rulebook.builtin(), at).first().trust_tier == "known"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mon, 1 Jan 2024 08:00:00 +0000", (2024, 1, 1, 8)), ("1 Jan 24 08:00 GMT", (2024, 1, 1, 8)), ("Tue, 29 Feb 2000 23:30:00 -0130 (X)", (2000, 3, 1, 1)), ("1 Jan 99 00:00:00 EST", (1999, 1, 1, 5)),
        ("Thu, 01-Feb-2024 00:00:60 +0100", (2024, 1, 31, 23, 0, 59)), ("1 Jan 124 00:00:00 Q", (2024, 1, 1, 0)), ("30 Feb 2024 00:00:00 +0000", None), ("1 Jan 2024 24:00:00", None), ("", None), (None, None), ("soon", None), ("1 Xyz 2024 00:00:00", None),
    ],
)
def test_dates(spark, text, want):
    x = spark.createDataFrame([(text,)], "t string").select(mail_date(F.col("t")).alias("d"), seen_at(F.col("t"), now()).alias("s")).first()
    assert x.d == (datetime.datetime(*want) if want else None) and x.s == (x.d or datetime.datetime(2024, 3, 1))
