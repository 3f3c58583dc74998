"""A landed mailbox with a cursor, and attribution over scored mails against brute force."""

import os
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mailglass.operators import attribution
from mailglass.plans import mails
from mailglass.sources import mailbox
from mailglass.sources.state_tables import StateTables


def land(spark, root, folder, validity, uid, subject="hi/there", changed=None):
    at = spark.range(1).select(mailbox.landing_path(F.lit(folder), F.lit(validity), F.lit(uid), F.lit(uid), F.lit(subject))).first()[0]
    m = EmailMessage()
    m["From"], m["Subject"] = f"u{uid}@x.org", subject
    m.set_content("text")
    p = root / at
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(m.as_bytes())
    if changed:
        os.utime(p, (changed, changed))
    return at


def test_the_cursor_moves_by_uid(spark, tmp_path):
    box, t = tmp_path / "box", StateTables(spark, str(tmp_path / "state"))
    assert land(spark, box, "其他文件夹", 7, 3) == "&UXZO1mWHTvZZOQ-/7/00003_uid3_hi_there.eml"
    for uid in (1, 2):
        land(spark, box, "其他文件夹", 7, uid)
    land(spark, box, "INBOX", 1, 10)
    rounds = []
    take = lambda m: rounds.append(sorted((r.folder, r.uid, r.headers["from"][0]) for r in m.collect()))
    assert mailbox.fetch_round(t, str(box), take, per_round=2) == 3
    assert rounds[-1] == [("INBOX", 10, "u10@x.org"), ("其他文件夹", 1, "u1@x.org"), ("其他文件夹", 2, "u2@x.org")]
    with pytest.raises(ZeroDivisionError):
        mailbox.fetch_round(t, str(box), lambda m: 1 / 0)
    assert mailbox.fetch_round(t, str(box), take) == 1 and rounds[-1][0][1] == 3  # the failed round came again
    before = t.manifest()["version"]
    assert mailbox.fetch_round(t, str(box), take) == 0 and t.manifest()["version"] == before
    for uid in (1, 2):  # the server has counted anew
        land(spark, box, "其他文件夹", 8, uid)
    assert mailbox.fetch_round(t, str(box), take) == 2 and [r[1] for r in rounds[-1]] == [1, 2]
    assert {r.folder: (r.uidvalidity, r.last_uid) for r in t.read("mailbox_sync").collect()} == {"INBOX": (1, 10), "其他文件夹": (8, 2)}


def test_ranges_prune_the_listing_and_move_nothing(spark, tmp_path):
    for uid, day in ((1, 1), (2, 10), (3, 20)):
        land(spark, tmp_path, "INBOX", 1, uid, changed=1_704_067_200 + (day - 1) * 86_400)
    files = mailbox.listed(spark, str(tmp_path), "2024-01-05T00:00:00", "2024-01-15T00:00:00")
    assert [r.uid for r in files.collect()] == [2] and "content" not in files.columns
    assert [r.uid for r in mailbox.read_range(spark, str(tmp_path), since="2024-01-05T00:00:00", first_uid=3).collect()] == [3]
    large = mailbox.mails_of(spark, mailbox.listed(spark, str(tmp_path)), max_bytes=1).collect()
    assert len(large) == 3 and all(r.headers is None and r.raw_size > 1 for r in large)
    assert mailbox.mails_of(spark, mailbox.listed(spark, str(tmp_path)).filter("uid > 9")).collect() == []


def test_attribution_over_scored_mails(spark, folder):
    x = mails.labelled(spark, folder).select("score", "verdict", "signals", "auth", "breakdown", F.struct("iocs.urls").alias("iocs"), F.transform("attachments", lambda a: a["idx"]).alias("attachments"), "bad").persist()
    rows = x.collect()
    missed = [r for r in rows if r.bad and r.verdict == "BENIGN"]
    part = lambda f: round(sum(map(f, missed)) / len(missed), 6) if missed else None
    got = attribution.miss_causes(x, "bad").first()
    assert tuple(got) == (len(missed), part(lambda r: not r.iocs.urls), part(lambda r: not r.attachments), part(lambda r: not r.signals), part(lambda r: not r.auth.has_auth_header), part(lambda r: r.score >= 20))
    every = x.withColumn("bad", F.lit(False))
    flagged = [r for r in rows if r.verdict in ("MALICIOUS", "SUSPICIOUS")]
    want = {}
    for r in flagged:
        for s in r.signals:
            b = r.breakdown
            total = b.intel + b.auth + min(max(b.raw_signals_points - s.points, 0), 30)
            n = want.setdefault(s.id, [0, 0])
            n[0] += 1
            n[1] += round(total / 45 * 100) < 30
    assert flagged and {r.id: [r.flagged, r.cleared] for r in attribution.leave_one_out(every, "bad").collect()} == want
    demoted = x.withColumn("verdict", F.lit("SPAM"))
    d = {r.method: r for r in attribution.demotions(demoted).collect()}
    assert d["spf"].passed == round(sum(r.auth.spf == "pass" for r in rows) / len(rows), 6) and d["any"].demoted == len(rows)
    assert d["any"].with_credential == sum(any(s.id in attribution.CREDENTIAL for s in r.signals) for r in rows)
    x.unpersist()
