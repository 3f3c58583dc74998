"""Nulls, repeated rows, very long texts, ties, empty tables and clashing columns, for operators and stages."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from mailglass.llm import html_extraction, language_id, neighbours, quality_classifier, quality_rules
from mailglass.llm.queries import PIECES, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", kept boolean, spans string, size long, share long, node long, score string, row long"
LONG = " ".join(f"word{i % 5003}" for i in range(400_000))


def docs(spark, rows, extra=False):
    tail = (None, "x", 1, 2, 3, "s", 4) if extra else ()
    return spark.createDataFrame([(*r, *tail) for r in rows], DOCS + (CLASH if extra else ""))


def prose(seed, n=60):
    return " ".join(f"{a}{b}" for i in range(n) for a, b in [("the and of to in that was his with for".split()[(i * seed) % 10], ["", "re", "ing"][i % 3])])


def test_rows_that_repeat_get_equal_results(spark):
    rows = [(1, prose(3), "en", "s", 1), (1, prose(3), "en", "s", 1), (2, None, None, None, None), (3, LONG, "en", "s", 1)]
    got = sorted(((r.doc_id, r.n_words, r.kept, r.base_failed) for r in quality_rules.quality_rules(docs(spark, rows, True), vocabulary(PIECES)).collect()), key=str)
    assert got[0] == got[1] and got[2][1:] == (0, False, True) and got[3][1] == 400_000
    pages = spark.createDataFrame([("<p>a story of some length</p>", "t"), ("<p>a story of some length</p>", "t"), (None, None), ("<p>" + LONG + "</p>", "t")], "html string, text string")
    out = sorted((r.n_chars, r.text) for r in html_extraction.extract(pages).collect())
    assert [n for n, _ in out] == [0, 22, 22, len(LONG)] and out[1] == out[2]


def test_long_texts_and_ties_of_languages(spark):
    rows = [(1, "aaa bbb", "xx", "s", 1), (2, "aaa bbb", "yy", "s", 1), (3, "aaa bbb", None, None, None), (4, LONG, None, None, None), (5, None, None, None, None), (6, "123 !", None, None, None)]
    d = docs(spark, rows, True)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(d, language_id.learn(d)).collect()}
    assert (got[1], got[2], got[3], got[5], got[6]) == ("xx", "xx", "xx", "und", "und") and got[4] in ("xx", "yy")


def test_classifier_takes_long_texts_and_bounds_what_it_learns_from(spark):
    d = docs(spark, [(i, f"good fine text {i} " * 20, None, None, None) if i % 2 else (i, f"%% || junk {i} " * 20, None, None, None) for i in range(40)] + [(99, LONG, None, None, None), (100, None, None, None, None)])
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))
    s = quality_classifier.Settings(sample_chars=6_000, epochs=4)
    out = {r.doc_id: r.score for r in quality_classifier.score(d, quality_classifier.learn(d, labels, s)).collect()}
    assert len(out) == 42 and all(0 <= x <= 1 for x in out.values()) and out[1] > out[2]


def test_vectors_of_one_id_count_each(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 0.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 1, 0.5)]


def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, folder):
    odd = [(None, prose(7), None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, prose(3), "en", "s", 1), (3, prose(3), "en", "s", 1), (4, prose(3) + " password=hunter2hunter2", "en", "s", 1)]
    for rows in ([], odd):
        for extra in (False, True):
            d = docs(spark, rows, extra)
            for name, stage in P.STAGES[:-1]:
                if name == "quality_rules":  # its verdict on these few words does not matter here
                    assert stage(spark, d, folder).columns == d.columns
                    continue
                out = stage(spark, d, folder)
                assert out.columns == d.columns, name
                assert out.count() <= 3 * len(rows)
        last = P.pack(spark, docs(spark, rows), folder).collect()
        assert {r.doc_id for r in last} == {r[0] for r in rows}
