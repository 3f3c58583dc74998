import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from mailglass.llm import resampling as M

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WORD.findall(low)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, aims, s):
    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    a, b = (Counter(bucket(f) for x in xs for f in features(x, s.longest)[0]) for xs in ([t for _, t in docs], aims))
    A, B = sum(a.values()), sum(b.values())
    gain = lambda k: math.floor(1000 * math.log((b[k] + 1.0) * (A + s.buckets) / ((a[k] + 1.0) * (B + s.buckets))))
    out = []
    for d, t in docs:
        f, n = features(t, s.longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= s.least_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for i, r in enumerate(fit[: s.percent * len(fit) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


def docs():
    out = [(i, " ".join(f"{'Wort' if i % 3 else 'Éclair'}{(i * j) % 97}-{j % 7}" for j in range(i % 60))) for i in range(300)]
    return [*out, (None, "x y " * 30), (1000, None), (1001, ""), (1002, "a" * 5000 + " " + "日本" * 1000 + " z" * 30), (1003, "1 2 3 \x00 ~ 4")]


AIMS = ["wort5 7 éclair 3 1 2", "wort5 wort7 wort9 !", None, ""]


def test_whole_results(spark):
    for s in (M.Settings(), M.Settings(buckets=50, longest=3, least_words=5, percent=33, seed="s")):
        df = spark.createDataFrame(docs(), "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank").repartition(4)
        got = M.resample(df, spark.createDataFrame([(a,) for a in AIMS], "text string"), s).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got), key=repr) == brute(docs(), AIMS, s)


def test_ties_repeats_and_empty_tables(spark):
    text = "one two three " * 10
    rows = [(5, text), (5, text), (6, text), (6, "one " * 25), (None, text), (None, text)] * 3
    aims = spark.createDataFrame([], "text string")
    s = M.Settings(percent=50)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.resample(df, aims, s).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 10))
    kept = sorted(got, key=lambda r: r.rank or 99)[:9]
    assert min(r.score for r in kept) >= max(r.score for r in got if r.rank is None)
    assert M.resample(spark.createDataFrame([], "doc_id long, text string"), df).collect() == []
    drawn = M.drawn(df.selectExpr("*", "'keep' as weight"), aims, s)
    assert drawn.columns == ["doc_id", "text", "weight"] and {r.doc_id for r in drawn.collect()} == {r.doc_id for r in kept}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=1500), max_size=12), st.integers(0, 3))
def test_crcs_of_spans(spans, gap):
    start = np.cumsum([0, *(len(x) + gap for x in spans)])[:-1]
    data = np.frombuffer(b"".join(x + b"?" * gap for x in spans), np.uint8)
    got = M.span_crcs(data, start.astype(np.int64), np.array([len(x) for x in spans], np.int64))
    assert got.tolist() == [zlib.crc32(x) for x in spans]


def test_crc_of_long_spans():
    for n in (255, 256, 257, 512, 513, 100_003, 3_000_000):
        data = np.arange(n, dtype=np.int64).astype(np.uint8) * 7
        assert M.span_crcs(data, np.array([0]), np.array([n])).tolist() == [zlib.crc32(data.tobytes())]


def test_words_end_with_their_text():
    buckets, owner, words = M.buckets_of(pa.array(["left out", "ab", "cd ef", None, "", "gh"])[1:], M.Settings(longest=2))
    assert words.tolist() == [1, 2, 0, 0, 1] and sorted(owner.tolist()) == [0, 1, 1, 1, 4]
