"""Alerts with state from round to round, against the batch operator replayed over the same rounds."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from mailglass.functions import names as N
from mailglass.operators import domain_lists
from mailglass.operators.state import alert_round
from mailglass.sources.state_tables import StateTables
from mailglass.streaming import alerts as A

START = datetime.datetime(2024, 1, 1, 8)


def report(round_, i, sender, verdict="MALICIOUS"):
    at = START + datetime.timedelta(hours=5 * round_)
    return {"report_id": f"r{round_}-{i}", "filename": f"{i}.eml", "from": sender, "subject": "s", "verdict": verdict, "score": 60 + i, "created_at": (at + datetime.timedelta(minutes=i)).isoformat()}


ROUNDS = [
    [report(0, 0, "Ann <a@x.org>"), report(0, 1, "a@x.org", "SUSPICIOUS"), report(0, 2, "b@x.org"), report(0, 3, "", "SUSPICIOUS"), report(0, 4, "c@x.org"), report(0, 5, "d@x.org", "BENIGN")],
    [report(1, 0, "A@X.ORG"), report(1, 1, "d@x.org"), report(1, 2, "c@x.org")],
    [report(2, 0, "b@x.org"), report(2, 1, "e@x.org"), report(2, 2, "d@x.org")],
    [report(3, 0, "a@x.org"), report(3, 1, "d@x.org"), report(3, 2, "f@x.org"), report(3, 3, "g@x.org"), report(3, 4, "h@x.org")],
]


@pytest.mark.parametrize("hours", [12, 0])
def test_stream_equals_replay_across_restarts(spark, tmp_path, hours):
    clock = F.to_timestamp(F.lit(START.isoformat())) + F.make_dt_interval(hours=5 * F.regexp_extract("report_id", r"^r(\d+)", 1).cast("int"))
    got, numbers = {}, []

    def push(alerts, summary, number):
        numbers.append(number)
        got[i] = ([r.report_id for r in alerts.collect()], [r.others for r in summary.collect()])

    box = tmp_path / "in"
    box.mkdir()
    for i, rows in enumerate(ROUNDS):  # a query of its own each: what it knows comes from the checkpoint
        (box / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema(A.REPORT).json(str(box))
        q = A.run_alerts(stream, push, str(tmp_path / "check"), hours=hours, clock=clock)
        assert q.awaitTermination(120)
    state = spark.createDataFrame([], "key string, last_at timestamp")
    for i, rows in enumerate(ROUNDS):
        df = spark.read.schema(A.REPORT).json(spark.sparkContext.parallelize(list(map(json.dumps, rows))))
        now = F.lit((START + datetime.timedelta(hours=5 * i)).isoformat()).cast("timestamp")
        alerts, summary, state = alert_round(df, state, now, hours=hours) if hours else alert_round(df, state.limit(0), now)
        assert got.get(i, ([], [])) == ([r.report_id for r in alerts.orderBy("report_id").collect()], [r.others for r in summary.collect()]), i
        state = spark.createDataFrame(state.collect(), "key string, last_at timestamp")
    assert numbers == sorted(set(numbers))
    if hours:
        assert got[0] == (["r0-0", "r0-1", "r0-2"], [2]) and got[1] == (["r1-1"], []) and got[2] == (["r2-1"], [])


def test_the_newest_events_of_each_folder_stay(spark, tmp_path):
    t = StateTables(spark, str(tmp_path))
    batch = lambda n: spark.range(n * 40, n * 40 + 40).select(F.when(F.col("id") % 4 == 0, "small").otherwise("busy").alias("folder"), F.timestamp_seconds("id").alias("at"), F.lit("mail").alias("kind"), F.col("id").cast("string").alias("text"))
    for n in (0, 1, 1, 2):
        A.keep_events(t, batch(n), n, keep=25)
    kept = [(r.folder, int(r.text)) for r in t.read("events").collect()]
    ids = [i for i in range(120)]
    assert sorted(kept) == sorted([("small", i) for i in ids if i % 4 == 0][-25:] + [("busy", i) for i in ids if i % 4][-25:])
    assert t.manifest()["version"] == 3


def test_folder_names(spark):
    pairs = [("&UXZO1mWHTvZZOQ-", "其他文件夹"), ("INBOX", "INBOX"), ("a&-b", "a&b"), ("&2D3eAA-x", "😀x"), ("&ZeVnLIqe-/&U,BTFw-", "日本語/台北"), ("", "")]
    for coded, plain in pairs:
        x = spark.createDataFrame([(coded, plain)], "c string, p string").select(N.folder_encoded(F.col("p")).alias("c"), N.folder_decoded(F.col("c")).alias("p")).first()
        assert (x.c, x.p) == (coded, plain)
    for broken in ("&####-x", "&AA-", "&2D0-x", "open &ab", "&2D0AQQ-"):
        assert spark.createDataFrame([(broken,)], "c string").select(N.folder_decoded(F.col("c"))).first()[0] == broken
    assert spark.createDataFrame([(None,)], "c string").select(N.folder_decoded(F.col("c")), N.folder_encoded(F.col("c"))).first() == (None, None)


def test_names_of_files_and_hosts(spark):
    files = {"a/b\\c:d": "a_b_c_d", "  .x. ": "x", "": "fall", None: "fall", "�" * 4 + "abc": "fall", "�" + "abcd": "�abcd", "n" * 100: "n" * 80, "x\ty\n z": "x_y_ z", "n" * 79 + ". tail": "n" * 79}
    for name, want in files.items():
        assert spark.createDataFrame([(name,)], "n string").select(N.safe_file_name(F.col("n"), F.lit("fall"))).first()[0] == want, name
    hosts = {"*.Mail.Example.com.": ("mail.example.com", "example.com"), "example.co.uk": ("example.co.uk", "example.co.uk"), "a.*.com": ("", ""), "localhost": ("", ""), "-x.org": ("", ""), "..y.org..": ("y.org", "y.org")}
    for entry, want in hosts.items():
        assert tuple(spark.createDataFrame([(entry,)], "e string").select(N.listed_host(F.col("e")), N.listed_domain(F.col("e"))).first()) == want
    entries = spark.createDataFrame([(e,) for e in ("example.com", "*.a.example.com", "b.a.example.com", "example.org", "xexample.com", "bad", None)], "entry string")
    got = {r.host: r.parent for r in domain_lists.covered(domain_lists.normalised(entries)).collect()}
    assert got == {"example.com": None, "a.example.com": "example.com", "b.a.example.com": "a.example.com", "example.org": None, "xexample.com": None}
    assert {r.domain: r.entries for r in domain_lists.list_of_domains(entries).collect()} == {"example.com": 3, "example.org": 1, "xexample.com": 1}
