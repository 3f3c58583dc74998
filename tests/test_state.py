"""State tables change as stated; alerts, look-ups and reports of small fixtures."""

from pyspark.sql import functions as F

from mailglass.operators import reports, state


def now():
    return F.expr("timestamp'2024-01-02 00:00:00'")


def test_upsert_delete_purge(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 20), (None, 30), ("c", 40)], "k string, v int")
    assert sorted(map(tuple, state.upsert(t, new, ["k"]).collect()), key=str) == sorted([("a", 1), ("b", 20), (None, 30), ("c", 40)], key=str)
    assert [tuple(r) for r in state.delete(t, new, ["k"]).collect()] == [("a", 1)]
    c = spark.createDataFrame([("x", "2024-01-01"), ("y", "2024-01-03"), ("z", None)], "k string, d string").select("k", F.col("d").cast("timestamp").alias("expires_at"))
    assert sorted(r.k for r in state.purge(c, now()).collect()) == ["y", "z"]


def test_histories_merge_and_answers_count(spark):
    rows = [("a@x.org", "x.org", i, ["l1.org"] if i % 2 else ["l2.org", "l1.org"]) for i in range(5)]
    m = spark.createDataFrame(rows, "addr string, domain string, i int, links array<string>")
    m = m.select(F.struct(F.struct("addr", F.col("domain").alias("domain_reg")).alias("from"), F.col("links").alias("link_domains")).alias("mail"), F.timestamp_seconds(F.col("i") * 86400).alias("at"))
    whole = state.history_of(m, F.col("at"))
    early = F.col("at") < F.timestamp_seconds(F.lit(2 * 86400))
    merged = state.merge_history(state.history_of(m.filter(early), F.col("at")), state.history_of(m.filter(~early), F.col("at")))
    assert whole.collect()[0].asDict() == merged.select(whole.columns).collect()[0].asDict() and whole.first()["count"] == 5
    sent = spark.createDataFrame([({"to": ["A <a@x.org>, b@y.org"], "cc": ["c@z.org"]},)], "headers map<string,array<string>>")
    got = {r.addr: (r["count"], r.replied) for r in state.mark_replied(whole, sent).collect()}
    assert got == {"a@x.org": (5, True), "b@y.org": (0, True), "c@z.org": (0, True)}


def test_fingerprint_follows_every_file(spark):
    f = lambda rows: state.fingerprint(spark.createDataFrame(rows, "path string, t string, length long").select("path", F.col("t").cast("timestamp").alias("modificationTime"), "length")).first()[0]
    one = [("/a", "2024-01-01", 5), ("/b", "2024-01-02", 6)]
    assert f(one) == f(one[::-1]) and f(one).startswith("2:1704153600:11:") and f(one) != f([("/a", "2024-01-01", 5), ("/c", "2024-01-02", 6)])
    assert f([]) == "0:0:0:000000000000"
    ledger = spark.createDataFrame([("/a", 1)], "path string, counted_at int")
    assert [r.path for r in state.not_counted(spark.createDataFrame([("/a",), ("/b",)], "path string"), ledger).collect()] == ["/b"]


def test_own_mail_and_uids(spark):
    m = spark.createDataFrame([("/in/1.eml", {"from": ["Me <ME@x.org>"]}), ("/Sent/2.eml", {"from": ["a@b.org"]}), ("/in/3.eml", {"from": ["a@b.org"]}), ("/in/4.eml", None)], "path string, headers map<string,array<string>>")
    assert [r[0] for r in m.select(state.self_sent(m, ("me@x.org",), ("Sent",))).collect()] == [True, True, False, False]
    u = spark.createDataFrame([("in", 1, 7, "old"), ("in", 1, 8, "new"), ("in", 2, 7, "x")], "folder string, uid long, uidvalidity long, v string")
    assert sorted(r.v for r in state.newest_by_uid(u).collect()) == ["new", "x"]


def test_a_round_pushes_three_and_sums_up_the_rest(spark):
    r = [(f"r{i}", f"s{i}@x.org", "MALICIOUS" if i % 2 else "SUSPICIOUS", 60, "s", f"{i}.eml", i) for i in range(6)] + [("b", "z@x.org", "BENIGN", 0, "s", "b.eml", 9), ("n", "", "MALICIOUS", 70, "s", "n.eml", 10)]
    df = spark.createDataFrame(r, "report_id string, from string, verdict string, score int, subject string, filename string, created_at int")
    st = spark.createDataFrame([("addr:s0@x.org", "2024-01-01 18:00:00"), ("addr:s1@x.org", "2024-01-01 02:00:00")], "key string, t string").select("key", F.col("t").cast("timestamp").alias("last_at"))
    alerts, summary, after = state.alert_round(df, st, now())
    assert sorted(a.report_id for a in alerts.collect()) == ["r1", "r2", "r3"]
    assert [s.others for s in summary.collect()] == [3]
    assert {a.key for a in after.filter(F.col("last_at") == now()).collect()} == {f"addr:s{i}@x.org" for i in range(1, 6)} | {"file:n.eml"}


def test_lookups_states_and_pages(spark):
    answers = {
        '{"data": {"attributes": {"last_analysis_stats": {"malicious": 2, "suspicious": 0, "harmless": 60, "undetected": 33}}}}': ("hit", 30, "2/95 引擎标记恶意"),
        '{"data": {"attributes": {"last_analysis_stats": {"malicious": 0, "harmless": 10}}}}': ("clean", 0, "0/10 引擎标记恶意"),
        '{"not_found": true}': ("unknown", 0, ""),
        None: ("no_key", 0, ""),
    }
    x = spark.createDataFrame([(a,) for a in answers], "a string").select("a", reports.engine_result(F.col("a"), F.lit("domain")).alias("r"))
    assert {r.a: tuple(r.r) for r in x.collect()} == answers
    files = spark.range(1).select(reports.engine_result(F.lit('{"data": {"attributes": {"last_analysis_stats": {"malicious": 6, "undetected": 54}}}}'), F.lit("hash"))["malicious_score"], reports.scan_score(F.lit(2)), reports.abuse_hit(F.lit(50)), reports.abuse_hit(F.lit(49)))
    assert files.first()[:] == (20, 100, True, False)
    asked = spark.createDataFrame([("virustotal", "a.org"), ("virustotal", "b.org")], "source string, ioc string")
    cache = spark.createDataFrame([("v2:virustotal:a.org", "old", "2024-01-01"), ("v2:virustotal:b.org", "live", "2024-01-03")], "key string, value string, e string").select("key", "value", F.col("e").cast("timestamp").alias("expires_at"))
    assert {r.ioc: r.value for r in reports.from_cache(asked, cache, now()).collect()} == {"a.org": None, "b.org": "live"}
    doc = spark.createDataFrame([("<script>", "MALICIOUS", 87, "a&b", "f.eml", ["r"], (["http://x/<"], [], [], [], []))], "subject string, verdict string, score int, from string, filename string, reasons array<string>, iocs struct<urls:array<string>,domains:array<string>,ips:array<string>,hashes:array<string>,header_domains:array<string>>")
    page = doc.select(reports.page()).first()[0]
    assert "<script>" not in page and "&lt;script&gt;" in page and "a&amp;b" in page and "http://x/&lt;" in page and "#EF4444" in page


def test_rulebooks_change_by_copies():
    import pytest

    from mailglass import rulebook as B

    book = B.builtin()
    rule = {"id": "own_rule", "name": "Own", "points": 3, "match": {"field": "body", "operator": "contains_any", "values": ["@dict:own"]}}
    with pytest.raises(B.RuleError):
        B.with_rule(book, rule)  # no such dictionary yet
    more = B.with_rule(B.with_terms(book, "own", add=("Ａbc", "abc", " ")), rule)
    assert more.terms["own"] == ("abc",) and more.rules[-1].id == "own_rule" and len(book.rules) == 90 and more.version != book.version
    assert B.with_terms(more, "own", remove=("ABC",)).terms["own"] == ()
    off = B.patched(more, "att_html", enabled=False, points=9)
    assert [(r.enabled, r.points) for r in off.rules if r.id == "att_html"] == [(False, 9)]
    for bad in ({"points": 99}, {"scope": "url"}):
        with pytest.raises(B.RuleError):
            B.patched(more, "att_html", **bad)
    assert len(B.without(more, "own_rule").rules) == 90
    with pytest.raises(B.RuleError):
        B.without(more, "att_html")
    assert B.listing(more)[-1]["source"] == "custom" and {r["version"] for r in B.listing(more)} == {more.version}
