import random

import pytest

from mailglass.llm import jaccard_join as J
from mailglass.llm.components import connected_components

SCHEMA = "doc_id long, text string, n_shingles string, lang string"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    passage = [rnd.choice(words) for _ in range(40)]
    for _ in range(25):  # families of near copies of many sizes, short ones included
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 5, 7, 8, 9, 10, 12, 14, 20, 60, 150]))]
        if rnd.random() < 0.3:
            base += passage
        for _ in range(rnd.randint(1, 8)):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(t))
                t[k : k + rnd.randint(0, 1)] = [rnd.choice(words)] * rnd.randint(0, 1)
            rows.append((n, " ".join(t) if rnd.random() < 0.9 else " ".join(t).upper()))
            n += rnd.randint(1, 3)
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = [*corpus(seed), (9000, None), (9001, ""), (9002, " \t\n")]
    df = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_open_pairs_join_in_blocks(spark, monkeypatch):
    for name, value in (("TURNS", 0), ("BLOCK", 2)):
        monkeypatch.setattr(J, name, value)
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()} == brute(rows)


def test_small_sets_link_by_subsets(spark):
    base = [f"a{i}" for i in range(13)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "z"])), (3, " ".join(base[:-1])), (4, "a b c"), (5, "a b c"), (6, "a b c d")]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()} == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(None, "one two three four five six", None, None), (7, "one two three four five six", None, None)], SCHEMA)
    got = sorted(J.jaccard_components(df).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(None, 2, None), (7, 2, 7)]
    assert J.one_of_each(df).count() == 2


def test_large_group_stays_linear(spark):
    base = [f"q{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 110], f"x{i}", *base[i % 110 + 1 :]])) for i in range(300)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    assert {r.component_id for r in J.jaccard_components(df).collect()} == {0}


def test_boundary_follows_cost():
    sets = {n: 100 for n in range(1, 25)}
    assert J.boundary(sets, {n: 100 for n in sets}) <= J.boundary(sets, {n: 100_000 for n in sets})
    assert J.boundary(sets, {5: 100 * J.subsets_of(5) + 1}) == 0  # sizes 1 to 4 cost more than that gains
    assert J.boundary({5: 10}, {5: 10 * J.subsets_of(5) + 1}) == 5
    for a in range(1, 60):
        for b in range(J.least_partner(a), J.largest_partner(a) + 1):
            c = J.overlap(a, b)
            assert 100 * c >= 80 * (a + b - c) and 100 * (c - 1) < 80 * (a + b - c + 1)


def short_group():
    """Many short near copies: lists are long, so their sets are small by cost."""
    base = [f"a{i}" for i in range(10)]
    return [(i, " ".join([*base[: 9 + i % 2], f"z{i // 2 % 7}" * (i % 3 > 0)]).strip()) for i in range(60)]


@pytest.mark.parametrize("on", [True, False])
def test_links_of_small_sets_come_from_subsets(spark, monkeypatch, on):
    if not on:  # without their subsets, small sets lose their links: the lists do not find them in secret
        monkeypatch.setattr(J, "subset_keys", lambda s, small, percent: iter(()))
    rows = short_group()
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()}
    assert (got == brute(rows)) is on


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, one, None, None), (1, two, None, None), (2, one + " x", None, None), (3, two + " y", None, None), (3, two + " y", None, None), (4, "else", None, None)], SCHEMA)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect())
    assert got == [(1, 26, 1), (1, 36, 1), (2, 37, 1), (3, 27, 1), (3, 27, 1), (4, 1, 4)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(3, 3), (50, 51), (51, 50)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 50: 50, 51: 50}
