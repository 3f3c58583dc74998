import hashlib
import random

from pyspark.sql import functions as F

from mailglass.llm import scaled_sketch as M
from mailglass.llm.jaccard_join import shingle_sets


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def shares(a, b):
    if (a or "") == (b or ""):
        return 1.0, 1.0
    x, y = ({int(h) for h in s if int(h) < (1 << 64) // M.SCALE} for s in shingle_sets([a or "", b or ""]))
    both = len(x & y)
    return (both / min(len(x), len(y)) if x and y else 0.0), (both / len(x | y) if x | y else 0.0)


def brute(data):
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (d, t, *_) in enumerate(order):
        t, other = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 2
        new = t[: len(t) - k] + other[:k]
        (ne, re), (nn, rn) = shares(t, new), shares(t, other)
        yield d, len(t), hashlib.sha256(new.encode()).hexdigest(), ne, nn, re, rn


def data():
    out = [(3 * i, prose(i % 23, 5 + 31 * (i % 29)), "x") for i in range(150)]
    return [*out, (-(1 << 61), prose(0, 300), "x"), (1 << 61, None, "x"), (500_000, "", "x"), (500_001, "ÄÖ 日本 " * 2000, "x"), (500_003, "short", "x"), (None, prose(5, 40), "x")]


def test_report_is_that_of_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows, "doc_id long, text string, sketch string").repartition(5)
    got = M.edit_report(df).collect()
    want = sorted(brute(rows), key=repr)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.resembles_edited, r.resembles_next) for r in got), key=repr) == want
    prints = {}
    texts = {d: t or "" for d, t, _ in rows}
    for r in got:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    again = {r.doc_id: r for r in M.edit_report(df.repartition(2)).collect()}
    assert all(again[r.doc_id] == r for r in got)


def test_edits_are_seen(spark):
    df = spark.createDataFrame([(i, prose(i, 600)) for i in range(40)], "doc_id long, text string")
    got = M.edit_report(df).collect()
    assert all(0.25 < r.near_edited < 0.75 and r.near_next == 0 and r.resembles_edited < 0.6 for r in got)


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c d"), (2, "e f"), (None, "n"), (None, "n"), (None, None)]
    got = M.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in got), key=repr) == sorted(((d, len(t or "")) for d, t in rows), key=repr)
    assert sum(r.near_next == 1.0 for r in got) == 2  # each pair of equal rows follows itself


def test_few_rows(spark):
    assert M.edit_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = M.edit_report(spark.createDataFrame([(7, "abcdé")], "doc_id long, text string")).first()
    assert (one.n_chars, one.near_next, one.edited_sha256) == (5, 1.0, hashlib.sha256("abcab".encode()).hexdigest())
    none = M.edit_report(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert (none.doc_id, none.n_chars, none.near_edited, none.near_next) == (None, 0, 1.0, 1.0)


def test_sketches_merge_and_tell_containment(spark):
    long, part = prose(1, 20_000), " ".join(prose(1, 20_000).split()[4000:4400])
    df = spark.createDataFrame([("long", long), ("other", prose(2, 3000)), ("part", part), ("half", part + " " + prose(3, 396)), ("none", None)], "name string, text string")
    s = M.sketch(df)
    by = {r.name: r.sketch for r in s.collect()}
    assert by["none"] == [] and len(by["part"]) > 20 and set(by["part"]) <= set(by["long"])
    corpus = M.merged(s.filter("name in ('long', 'other')").withColumn("k", F.lit(1)), ["k"])
    assert {r.hash for r in corpus.collect()} == set(by["long"]) | set(by["other"])
    found = {r.name: r.containment for r in M.containment(M.merged(s.filter("name in ('part', 'half')"), ["name"]), corpus, ["name"]).collect()}
    assert found["part"] == 1.0 and 0.3 < found["half"] < 0.7
