"""Whole mails, from bytes to verdict, against scores worked out by hand from the rules."""

import json
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mailglass import rulebook
from mailglass.operators import mail_features as M
from mailglass.operators.mail_indicators import address_domain, merged, stated
from mailglass.operators.mail_scoring import analysed
from mailglass.sources.mail import decoded, parse_mails, parse_message

BOOK = rulebook.builtin()
FAILED = "mx.corp.example.com; spf=fail smtp.mailfrom={0}; dkim=none; dmarc=fail"
PASSED = "mx.corp.example.com; spf=pass smtp.mailfrom={0}; dkim=pass; dmarc=pass"


def message(sender, subject, text, auth=None, html=None, attachment=None, whole_attached=None, **headers):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = sender, "li.li@corp.example.com", subject
    if auth:
        m["Authentication-Results"] = auth
    for k, v in headers.items():
        m[k.replace("_", "-")] = v
    m.set_content(text)
    if html:
        m.add_alternative(html, subtype="html")
    if whole_attached:
        for part in m.iter_parts():
            part.add_header("Content-Disposition", "attachment", filename=whole_attached)
    if attachment:
        m.add_attachment(attachment[1], maintype="application", subtype="octet-stream", filename=attachment[0])
    return m.as_bytes()


SAMPLES = {
    "meeting": (message("张伟 <zhangwei@corp.example.com>", "安全周报与评审会议安排", "各位好：\n\n评审会议安排在周四下午。\n", PASSED.format("corp.example.com"), Return_Path="<zhangwei@corp.example.com>"), 0, "BENIGN"),
    "portal": (message("Docs Portal <no-reply@docs.example.org>", "[Docs] 文章已审核通过", "查看页面: https://docs.example.org/guide/policy\n", PASSED.format("example.org"), Return_Path="<bounces@docs.example.org>"), 0, "BENIGN"),
    "storage": (
        message(
            "Cloud Storage Team <notice@cloudstorage.example>", "Action required: your account will be suspended", "Please verify your account within 24 hours.\n\nClick: https://bit.ly/3xFakeAccountVerify\n",
            "mx.corp.example.com; spf=pass smtp.mailfrom=cloudstorage.example; dkim=none; dmarc=pass", '<html><body><form action="http://backup-notice.example.top/verify" method="post"><input name="pass" type="password"></form></body></html>',
            whole_attached="account-verify.html", Return_Path="<notice@cloudstorage.example>", Reply_To="support-desk@other-mail.invalid",
        ),
        None, "MALICIOUS",
    ),
    "deals": (message("Deals Weekly <news@deals-weekly.example.info>", "Your weekly deals are here", "Update your account preferences:\n\nhttps://bit.ly/3xDealsWeekly\nhttp://promo.deals-weekly.example.info/account/update\n\nUnsubscribe anytime.\n"), 33, "SUSPICIOUS"),
    "paypal": (
        message(
            "PayPal Service <service@paypal-secure-verify.example>", "Urgent: Unusual activity detected, verify now!",
            "Your account will be locked within 24 hours unless you verify your identity immediately.\n\n  - http://203.0.113.66/account/verify/login\n  - https://xn--pypl-secure-cvf.example/login\n",
            FAILED.format("paypal-secure-verify.example"), Return_Path="<bounce@mailer-daemon.example.invalid>", Reply_To="recover-center@example.invalid",
        ),
        87, "MALICIOUS",
    ),
    "offer": (message("HR Recruiting <hr-recruit@headhunter-corp.example>", "校园招聘录用通知（请查收 Offer）", "请立即打开附件查看详情，逾期视为放弃。\n\n上传至: hxxp://secure-hr-portal.example.top/offer\n", "mx.corp.example.com; spf=none; dkim=none; dmarc=none", attachment=("Offer_2026.pdf.exe", b"MZ placeholder " * 20)), 75, "MALICIOUS"),
    "parcel": (
        message(
            "DHL Express <tracking@dhl-parcel-notice.example>", "Final notice: package held at customs, pay now",
            "A billing fee must be paid within 24 hours.\n\nPay: hxxp://bit.ly/3xFakeDhlPay\nAlternative: http://198.51.100.23/dhl/billing/verify\nMirror: https://xn--dhl-express-4ed.example/track\n",
            FAILED.format("dhl-parcel-notice.example"), Reply_To="customs-pay@dhl-parcel-notice.example",
        ),
        87, "MALICIOUS",
    ),
    "support": (
        message(
            '"PayPal Support" <service.alerts@gmail.com>', "Action required: your account has been limited", "Confirm your password and card details immediately.\n", PASSED.format("gmail.com"),
            '<html><body><p>Verify now:</p><p><a href="http://203.0.113.99/paypal/login">https://www.paypal.com/secure-login</a></p></body></html>', Return_Path="<service.alerts@gmail.com>", Reply_To="paypal.recovery@outlook.com",
        ),
        67, "MALICIOUS",
    ),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    files = spark.createDataFrame([(k, v[0]) for k, v in SAMPLES.items()], "path string, content binary")
    return {r.path: r for r in analysed(parse_mails(files), BOOK).collect()}


def test_scores_of_sample_mails(verdicts):
    for name, (_, score, verdict) in SAMPLES.items():
        got = verdicts[name]
        assert (got.verdict, got.score if score is not None else None) == (verdict, score), (name, got.score, [s.id for s in got.signals])


def test_signals_keep_their_order_and_reasons(verdicts):
    order = [r.id for r in BOOK.rules]
    for r in verdicts.values():
        at = [order.index(s.id) for s in r.signals]
        assert at == sorted(at)
    offer = verdicts["offer"]
    assert [s.id for s in offer.signals] == ["att_double_ext", "att_ext_high_risk", "att_random_name", "att_generic_mime", "body_urgency", "lure_attachment_pattern", "signal_stack"]
    assert offer.reasons[0].startswith("评分说明") and "启发式: 附件疑似双扩展名伪装: Offer_2026.pdf.exe" in offer.reasons and offer.reasons[-1] == "启发式: 独立风险信号叠加（共 6 项）"
    assert [s.reason for s in verdicts["support"].signals if s.id == "anchor_text_mismatch"] == ["链接显示文本与实际跳转域名不一致: www.paypal.com -> 203.0.113.99"]
    assert verdicts["paypal"].category == "phishing" and verdicts["deals"].category == "unknown"


def test_null_and_empty_mails(spark):
    one = parse_message(b"")
    schema = parse_mails(spark.createDataFrame([], "path string, content binary")).schema
    rows = [("none", None, 5, None, None, None, None, None, None), ("empty", "x", 0, one["headers"], [], "", "", [], 0)]
    got = {r.path: r for r in analysed(spark.createDataFrame(rows, schema), BOOK).collect()}
    for r in got.values():
        assert (r.score, r.verdict, [s.id for s in r.signals]) == (4, "BENIGN", ["header_missing_auth"])
    assert analysed(spark.createDataFrame([], schema), BOOK).collect() == []


def test_intelligence_lifts_and_mailbox_drops(spark):
    files = spark.createDataFrame([("deals", SAMPLES["deals"][0])], "path string, content binary")
    hit = F.array(F.struct(F.lit("http://x.example").alias("ioc"), F.lit("url").alias("ioc_type"), F.lit("vt").alias("source"), F.lit("hit").alias("status"), F.lit(30).alias("malicious_score"), F.lit("2/95").alias("summary")))
    r = analysed(parse_mails(files).withColumn("intel", hit), BOOK, offline=False).first()
    assert (r.score, r.verdict, r.category, r.breakdown.intel) == (48, "SUSPICIOUS", "phishing", 33.0)  # 33 by the floor and 15 points of rules
    assert r.reasons[0] == "威胁情报: 查询 1 条 IOC，命中 1" and "按保底计分" in r.reasons[2]
    r = analysed(parse_mails(files), BOOK, profile="mailbox").first()
    assert r.score == 29 and "header_missing_auth" not in [s.id for s in r.signals] and r.reasons[-1].startswith("说明: 分析档位")


def test_rules_of_a_folder(tmp_path):
    for d in ("builtin", "custom", "dicts"):
        (tmp_path / d).mkdir()
    (tmp_path / "dicts" / "fruit.txt").write_text("# c\nApple\nPеar\n")  # the e is Cyrillic
    rule = {"id": "fruit", "name": "Fruit", "points": 4, "match": {"field": "body", "operator": "contains_any", "values": ["@dict:fruit"]}}
    (tmp_path / "builtin" / "a.jsonl").write_text(json.dumps(rule))
    one = rulebook.read_folder(str(tmp_path))
    assert [(r.id, r.points) for r in one.rules] == [("fruit", 4)] and one.terms["fruit"] == ("apple", "pear")
    (tmp_path / "custom" / "b.jsonl").write_text(json.dumps(rule | {"points": 7}))
    two = rulebook.read_folder(str(tmp_path))
    assert (two.rules[0].points, two.origin["fruit"]) == (7, "custom") and one.version != two.version
    for bad in ({"match": {"field": "x", "operator": "like"}}, {"detector": "unknown", "kind": "detector"}, {"match": {"field": "x", "operator": "regex_any", "values": ["("]}}, {"points": 31}, {"scope": "folder"}):
        (tmp_path / "custom" / "b.jsonl").write_text(json.dumps(rule | bad))
        with pytest.raises(rulebook.RuleError):
            rulebook.read_folder(str(tmp_path))
    assert len(BOOK.rules) == 90 and len(BOOK.version) == 16


def test_brands_codes_and_hosts(spark):
    texts = {"shinapple 北京东四十条 东京都": [], "apple 账户": ["apple"], "关注我们的微信公众号": [], "您的微信账户已被限制": ["微信"], "关注我们的微信公众号" + "x" * 90 + "微信账户": ["微信"]}
    x = M.with_brand_hits(spark.createDataFrame([(t,) for t in texts], "t string"), {"hits": "t"}, BOOK)
    assert {r.t: r.hits for r in x.collect()} == texts
    notices = {"您的验证码是 483920，5分钟内有效": "验证码", "请回填验证码完成认证": "", "": ""}
    x = spark.createDataFrame([(t,) for t in notices], "t string").withColumn("n", M.otp_notice(F.col("t"), BOOK))
    assert {r.t: r.n for r in x.collect()} == notices
    hosts = {"apple.com.evil.top": False, "apple.com.cn": True, "mail.qq.com": True, "myapple.com": False, "": False}
    x = spark.createDataFrame([(t,) for t in hosts], "t string").withColumn("b", M.is_brand_host(F.col("t"), BOOK))
    assert {r.t: r.b for r in x.collect()} == hosts
    programs = {"Axbkgg Ccerhjm 85.26": True, "Microsoft Outlook 16.0": False, "Foo bar": False, "": False}
    x = spark.createDataFrame([(t,) for t in programs], "t string").withColumn("b", M.junk_program(F.col("t")))
    assert {r.t: r.b for r in x.collect()} == programs


def test_authentication_merges_headers(spark):
    rows = [(["spf=fail; dkim=fail", "spf=pass; dkim=none"],), (["dkim=fail dkim=pass", "dkim=fail"],), ([],), (["x-spf=pass; spf=odd; spf=softfail"],)]
    x = spark.createDataFrame(rows, "h array<string>")
    got = [tuple(r) for r in x.select(merged(F.col("h"), "spf"), merged(F.col("h"), "dkim")).collect()]
    assert got == [("pass", "none"), (None, "pass"), (None, None), ("softfail", None)]
    assert spark.range(1).select(stated(F.lit("SPF = Pass"), "spf"), address_domain(F.lit("a <b@Evil.Example>")), address_domain(F.lit("x@localhost")), address_domain(F.lit("none"))).first()[:] == ("pass", "evil.example", "localhost", None)


def test_charsets_are_told_by_their_text():
    zh = "银行账户验证通知"
    assert decoded(zh.encode("utf-8"), "gb2312") == zh and decoded(zh.encode("gb18030"), "us-ascii") == zh and decoded(zh.encode("gbk"), "gb2312") == zh
    assert decoded("é".encode("latin-1"), "latin-1") == "é" and decoded(b"", None) == ""


def test_tracking_links_carry_their_target():
    import base64
    import zlib

    packed = base64.urlsafe_b64encode(zlib.compress(b"https://shop.example/verify?id=0123456789")).decode().rstrip("=")
    assert "shop.example" in M.tracked(f"https://track.esp.example/click/{packed}.html") and M.tracked("https://a.example/short") == ""


def test_stream_gives_verdicts(spark, tmp_path):
    from mailglass.streaming import watch

    (tmp_path / "in").mkdir()
    for name in ("offer", "portal"):
        (tmp_path / "in" / f"{name}.eml").write_bytes(SAMPLES[name][0])
    rounds = []
    stream = watch.verdict_stream(spark, str(tmp_path / "in"), BOOK)
    watch.run_watch(stream, lambda df, n: rounds.append([(r.score, r.verdict) for r in df.collect()]), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(x for r in rounds for x in r) == [(0, "BENIGN"), (75, "MALICIOUS")]


def test_trust_lowers_wording_never_hard_signals(spark):
    from mailglass.operators import mail_scoring, state, trust
    from mailglass.operators.mail_indicators import with_authentication, with_indicators

    deals, offer = SAMPLES["deals"][0], SAMPLES["offer"][0]
    files = spark.createDataFrame([("deals", deals), ("offer", offer)], "path string, content binary")
    x = mail_scoring.with_signals(M.with_features(with_authentication(with_indicators(parse_mails(files))), BOOK), BOOK)
    now = F.expr("timestamp'2024-03-01 00:00:00'")
    schema = "addr string, domain string, count long, first_seen timestamp, last_seen timestamp, replied boolean, link_domains array<string>"
    said = "scope string, key string, verdict string, expires_at timestamp, note string"
    history = spark.createDataFrame([("news@deals-weekly.example.info", "example.info", 1, None, None, True, ["bit.ly", "example.info"]), ("hr-recruit@headhunter-corp.example", "headhunter-corp.example", 9, None, None, True, [])], schema)
    blocked = spark.createDataFrame([("domain", "headhunter-corp.example", "phishing", None, None)], said)
    got = {r.path: r for r in mail_scoring.scored(trust.with_trust(x, history, blocked, BOOK, now)).collect()}
    d, o = got["deals"], got["offer"]
    assert d.trust_tier == "established" and {s.id: s.points for s in d.signals} == {"body_credentials": 2.1, "body_unsubscribe_link": 0.0, "header_missing_auth": 2.0, "url_shortener": 5.0}
    assert d.score == 20 and "你给它写过信" in d.reasons[-1] and "链接域与历史一致" in d.reasons[-1]
    assert (o.trust_tier, o.score) == ("blocked", 75) and "不适用信任降权" in o.reasons[-1]
    free = {r.path: r for r in trust.with_trust(x, history, spark.createDataFrame([], said), BOOK, now).collect()}["offer"]
    assert free.trust_tier == "established" and {s.id: s.points for s in free.signals}["att_ext_high_risk"] == 12.0
    marks = state.label_senders(x, "benign", now, 30)
    assert sorted((r.scope, r.key, str(r.expires_at)[:10]) for r in marks.collect()) == [("addr", "hr-recruit@headhunter-corp.example", "2024-03-31"), ("addr", "news@deals-weekly.example.info", "2024-03-31")]
