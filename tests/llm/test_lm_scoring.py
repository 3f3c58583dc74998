import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailglass.llm import lm_scoring as M
from mailglass.llm.queries import op3_bloom_language_model


def tokens(t):
    return [*(t or "").encode().lower().split(), 0]


def check(rows, texts, trains):
    c = Counter(w for i, t in texts.items() if trains(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score <= 0


def test_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op3_bloom_language_model(spark, folder).collect()
    assert len(rows) == len(texts)
    check(rows, texts, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # pairs help


@pytest.mark.parametrize(("filter_bytes", "exact_words"), [(M.FILTER_BYTES, M.EXACT_WORDS), (600, M.EXACT_WORDS), (600, 1)])
def test_passes_and_joined_counts_agree(spark, filter_bytes, exact_words):
    texts = {i: " ".join(f"w{(i * j) % 23}" for j in range(i % 30)) for i in range(80)} | {100: None, 101: "", 102: "Straße ÄÖ É \x85x"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, score string").repartition(3)
    got = M.lm_scores(df, F.col("doc_id") % 7 != 2, filter_bytes, exact_words).collect()
    assert len(got) == len(texts)
    check(got, texts, lambda i: i % 7 != 2)
    plain = {r.doc_id: r.score for r in M.lm_scores(df, F.col("doc_id") % 7 != 2).collect()}
    assert all(math.isclose(r.score, plain[r.doc_id], rel_tol=1e-9, abs_tol=1e-9) for r in got)


def test_nothing_to_learn_from_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [(r.train_tokens, r.n_known, r.base_score) for r in M.lm_scores(df, F.lit(False)).collect()] == [(0, 0, 0.0)] * 2
    assert M.lm_scores(df.limit(0), F.lit(True)).count() == 0


def test_filter_counts_never_fall_short():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64) >> np.uint64(7)
    counts = np.minimum(rng.zipf(1.5, 5000), 10**6)
    f = M.Filter(M.build_segment(keys, counts), np.array([0, 10**9, 10**9]), 1)
    f.starts = np.array([0, len(f.data), len(f.data)])
    got, want = f.counts(keys), M.MEANS[M.level_of(counts)]
    assert (got >= want).all() and (got == want).mean() > 0.9
    strange = rng.integers(0, 2**63, 20000).astype(np.uint64) >> np.uint64(7)
    assert (f.counts(strange) > 0).mean() < 0.06


def test_scores_do_not_depend_on_partitions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r.score for r in M.lm_scores(docs.repartition(n), F.col("doc_id") % 7 != 2).collect()} for n in (1, 40))
    assert one == many


def test_repeated_and_very_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    df = spark.createDataFrame([(1, long), (1, long), (2, "w1 w2"), (3, long + " strange")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.score) for r in M.lm_scores(df, F.col("doc_id") < 3).collect())
    assert got[0] == got[1] and [g[:3] for g in got] == [(1, 300_001, 300_001), (1, 300_001, 300_001), (2, 3, 3), (3, 300_002, 300_001)]
