import numpy as np
from pyspark.sql import functions as F

from mailglass.llm import neighbours as N
from mailglass.llm.queries import op1_learned_partitions


def brute(rows, is_query, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if is_query(i):
            s = sorted(((-float(np.einsum("i,i->", q, x)), j) for j, x in good if j != i))
            out[i] = [(j, -d) for d, j in s[:k]]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)]  # many ties
    rows += [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 1.0, 0.0, 0.0]), (104, [float("inf"), 1.0, 0.0, 0.0]), (105, []), (106, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got: dict = {}
    for r in N.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == brute(rows, lambda i: i % 20 == 0, 20)


def test_blocks_do_not_change_results(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(100)] + [(i, [1.0, 0.5, 0.0, 0.0]) for i in range(200, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = (sorted(map(tuple, N.search(df, F.col("vec_id") % 10 == 0, 7, N.Settings(block=n, sample=30)).collect())) for n in (16384, 9))
    assert a == b and len(a) == 20 * 7


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.search(df, F.col("vec_id") % 20 == 0).collect() == []


def test_partition_is_balanced_and_cuts_little():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((64, 8)) * 0.2 + c for c in np.eye(8)[:4] * 3])
    near = N.top_rows(x, x, 8, np.arange(len(x)))
    part = N.partition_graph(near, 4, rng)
    assert sorted(np.bincount(part)) == [64] * 4
    assert (part[near] == part[:, None]).mean() > 0.9


def test_recall_with_learned_parts(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    more = e.unionAll(e.select(F.col("vec_id") + 1000, F.transform("embedding", lambda x: (x * 0.9 + 0.01).cast("float")).alias("embedding"), "label"))
    rows = more.collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    got = {(r.query_id, r.vec_id) for r in N.search(more, F.col("vec_id") % 20 == 0, 20).collect()}
    hit = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        top = np.lexsort((ids, -s))[:20]
        hit += sum((ids[i], ids[j]) in got for j in top)
        n += 20
    assert hit / n >= 0.9


def test_query_shape(spark, folder):
    r = op1_learned_partitions(spark, folder)
    assert r.columns == ["query_id", "rank", "vec_id", "score"] and r.groupBy("query_id").count().filter("count <> 20").isEmpty()
