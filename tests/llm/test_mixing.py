import math
from collections import Counter

from pyspark.sql import functions as F

from mailglass.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, full, left = {}, set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * level > most * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in rest}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            full.add(s)


def rows(n=600):
    out = []
    for i in range(n):
        s = ["big", "big", "big", "ä", "mid", None, "z"][i % 7] if i else "tiny"
        out.append((i, " ".join(["w"] * (i * 37 % 211)) or None, s, "x"))
    return out


def test_targets_and_taken_words(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    got = M.mix_counts(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(d[0] for d in data)
    sizes, taken, target = Counter(), Counter(), {}
    src = {d[0]: d[2] for d in data}
    for r in got:
        assert r.size == len((data[r.doc_id][1] or "").split()) and r.taken in (0, r.size, 2 * r.size)
        sizes[src[r.doc_id]] += r.size
        taken[src[r.doc_id]] += r.taken
        target[src[r.doc_id]] = r.target
    want = targets({s: sizes[s] for s in target})
    for s in target:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - target[s]) <= 211
    again = {r.doc_id: r.taken for r in M.mix_counts(df.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_rows_follow_counts(spark):
    df = spark.createDataFrame(rows(200), "doc_id long, text string, source string, target string")
    counts = {r.doc_id: (r.size, r.taken) for r in M.mix_counts(df).collect()}
    mixed = M.mix_sources(df)
    assert mixed.columns == df.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert all(times[i] * s == t for i, (s, t) in counts.items())


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(rows(50), "doc_id long, text string, source string, x string")
    plan = M.mix_sources(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_tree_splits_quotas_exactly(spark):
    draws = spark.createDataFrame([(s, n) for s, q in ((0, 700), (1, 60), (2, 1)) for n in range(1, q + 1)], "src int, nth int")
    got = M.shard_draws(draws, 3, "t").collect()
    assert Counter(r.src for r in got) == {0: 700, 1: 60, 2: 1}
    assert len({(r.src, r.nth) for r in got}) == 761
    per = Counter(r.shard for r in got)
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 1
    shares = [sum(r.src == 1 for r in got if r.shard == k) for k in range(8)]
    assert 0 < min(shares) and max(shares) < 20  # about 7.5 each, as a random permutation would give


def test_draws_have_the_hypergeometric_mean(spark):
    nodes = spark.range(400).select(F.col("id").alias("node"), F.expr("array(30L, 70L)").alias("quotas"))
    left = M.split_quotas(nodes, 0, "m").filter("node % 2 = 0").select(F.col("quotas")[0].alias("x")).agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).first()
    assert abs(left["m"] - 15) < 0.5 and 3.5 < left["v"] < 7.5  # 15 and 5.3


def test_empty_and_blank(spark):
    schema = "doc_id long, text string, source string"
    assert M.mix_counts(spark.createDataFrame([], schema)).collect() == []
    got = M.mix_counts(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in got) == [(1, 0, 0), (2, 0, 0)]


def test_shards_hold_exact_quotas(spark, monkeypatch):
    """Every draw of a block goes to one shard; each shard gets its share of each source's draws, as a draw without
    replacement spreads them, and all shards together hold each draw once."""
    monkeypatch.setattr(M, "BLOCK_WORDS", 200)
    df = spark.createDataFrame([(i, "w " * 20, "ab"[i % 4 == 0]) for i in range(4000)], "doc_id long, text string, source string")
    sized = M.cut(df.select("doc_id", "source", M.words(F.col("text")).alias("size"), M.unit_hash("mix", F.col("doc_id")).alias("h")))
    sources, blocks = M.plan_mix(sized)
    draws = blocks.select("src", F.explode("draws").alias("d")).select("src", "d.nth", "d.shard").collect()
    for src in {r.src for r in draws}:
        nths = sorted(r.nth for r in draws if r.src == src)
        assert nths == list(range(1, len(nths) + 1))
        counts = Counter(r.shard for r in draws if r.src == src)
        assert len(counts) == 8 and sum(counts.values()) == len(nths)
        mean = len(nths) / 8
        assert all(abs(n - mean) < 6 * math.sqrt(mean) for n in counts.values())
    per_shard = Counter(r.shard for r in draws)
    assert max(per_shard.values()) - min(per_shard.values()) <= 3  # a node's halves differ by one draw at most
    got = M.mix_counts(df).collect()
    assert all(len(r.shards) * r.size == r.taken for r in got)
