import random
import zlib

from mailglass.llm import language_id as L
from mailglass.llm import quality_classifier as C
from mailglass.llm.queries import op2_quality_classifier, op8_language_filters
from pyspark.sql import functions as F


def test_quality_on_held_out_labels(spark, folder):
    folder = folder.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op2_quality_classifier(spark, folder).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, ("good clean words " if i % 2 else "*** ### junk ") * 3, 0.3) for i in range(40)] + [(90, None, 0.1), (91, "", 0.1), (1, "dup", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (777, 1), (5, 1)], "doc_id long, y int")
    got = {(r.doc_id, r.text): r.score for r in C.quality_scores(docs, labels, F.lit(True)).collect()}
    assert all(got[i, t] > 0.7 if i % 2 else got[i, t] < 0.3 for i, t in got if i < 40 and t != "dup")
    assert got[90, None] == got[91, ""]
    assert C.quality_scores(docs, labels.limit(0), F.lit(True)).select("score").distinct().collect()[0][0] == 0.5
    assert C.quality_scores(docs.limit(0), labels, F.lit(True)).count() == 0


def test_repeats_and_bags_agree_with_scoring():
    s = C.Settings(buckets=512)
    texts = ["a a b b b", "", "x y", "a", "b a a"]
    words, starts = C.split_words(texts)
    ids = C.WordTable(C.word_hashes).ids(words)
    assert C.repeats(ids, starts).tolist() == [3, 0, 0, 0, 1]
    model = C.train([(f, c, i % 2) for i, (f, c) in enumerate(C.bags(texts, s))], s)
    p = C.probabilities(texts, model, C.table_of(model))
    for (f, c), q in zip(C.bags(texts, s), p, strict=True):
        z = (c / c.sum()) @ model.vectors[f] @ model.weights
        import math

        assert abs(1 / (1 + math.exp(z[0] - z[1])) - q) < 1e-5


def test_language_on_held_out_texts(spark, folder):
    folder = folder.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op8_language_filters(spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "12 34 !!", "de"), (6, "und die", None), (1, "the cat and the dog", "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = sorted((r.doc_id, r.lang_pred) for r in L.identify_held_out(df, F.lit(True)).collect())
    assert got == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de")]
    assert {r.lang_pred for r in L.identify_held_out(df, F.lit(False)).collect()} == {"und"}
    assert L.identify_held_out(df.limit(0), F.lit(True)).count() == 0


def test_filter_has_no_false_negatives_and_corrects_strangers():
    import numpy as np

    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    langs = rng.integers(0, 70, 3000)  # more than one column of masks
    m = L.build([f"l{i:02d}" for i in range(70)], keys, langs)
    assert m.votes(keys)[np.arange(3000), langs].all()
    strange = m.votes(rng.integers(0, 2**63, 20000).astype(np.uint64)).mean(axis=0)
    assert np.abs(strange - m.rates).max() < 0.01


def test_no_n_gram_is_left_out(spark, monkeypatch):
    """However few n-grams one filter holds, a rare language beside a large one keeps its own, and all passes add up."""
    rnd = random.Random(4)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7)))
    text = lambda letters: " ".join(word(letters) for _ in range(40))
    rows = [(i, text("abcdefghij"), "aa") for i in range(300)] + [(1000 + i, text("abcdefklmn"), "bb") for i in range(2)]
    rows += [(2000 + i, text("abcdefklmn"), None) for i in range(5)] + [(3000, None, None), (3001, "12 34", None), (0, rows[0][1], None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    learned = L.learn(df)
    whole = sorted(map(tuple, L.identify_held_out(df, F.lit(True)).collect()), key=repr)
    monkeypatch.setattr(L, "MOST_GRAMS", 1500)
    got = L.identify_held_out(df, F.lit(True))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert [r[:3] for r in got] == [r[:3] for r in whole] and len(got) == len(rows)
    assert all(r[3] == ("aa" if r[0] < 1000 else "und" if r[0] >= 3000 else "bb") for r in got), got
    assert all(abs(a[4] - b[4]) < 0.05 for a, b in zip(got, whole, strict=True))
    parts = L.learn(df)
    assert parts.parts > 3 and sum(parts.grams.filter(F.shiftrightunsigned("gram", 33) % parts.parts == i).count() for i in range(parts.parts)) == learned.grams.count() == parts.grams.count()


def test_letters_of_many_words_at_once():
    words = ["Ab1c", "", "ΣΑΣ", "ΟΔΟΣ", "İx", "a²b", "--", "naïve,", "x\u0301y", "Ⅷth", "\u00a0q"]
    assert L.letters_of([w.encode() for w in words]) == [L.letters(w) for w in words] and L.letters_of([]) == []
