import random

import numpy as np
from mailglass.llm import quality_rules as Q
from mailglass.llm.queries import PIECES, op9_tokeniser_fertility, vocabulary


def brute(t):
    import sentencepiece

    sp = brute.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES)))
    t = t or ""
    w = t.encode().split()
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    toks = [x for y in w for x in sp.encode(y.decode())]
    chars = sum(len(x.decode()) for x in w)
    p = np.unique(toks, return_counts=True)[1] / max(1, len(toks))
    return len(w), chars, sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w), len(toks), sum(map(sp.is_byte, toks)), float(-(p * np.log2(p)).sum()) if toks else None


def texts():
    rnd = random.Random(3)
    some = ["alpha", "beta", "gamma###", "dé", "漢字", "a|b", "x"]
    out = [" ".join(rnd.choice(some) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    loop = "one two three four five six seven eight nine "
    return [*out, None, "", "\n\n", loop * 5, "same line\nother\nsame line\n \n \nsame line", "a " * 9, "\x1fnot a space here", "Привет мир " * 15]


def test_counts_and_measures_match_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id long, text string, n_words string")
    for r in Q.quality_rules(df, vocabulary(PIECES)).collect():
        n, chars, sym, dup, rep, failed, toks, fallback, h = brute(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_tokens) == (n, chars, sym, dup, rep, failed, toks), rows[r.doc_id]
        if toks:
            assert abs(r.chars_per_token - chars / toks) < 1e-12 and abs(r.fallback_share - fallback / toks) < 1e-12 and abs(r.token_entropy - h) < 1e-9
        assert not (r.base_failed and r.kept)


def test_empty_table_and_scripts(spark):
    assert Q.quality_rules(spark.createDataFrame([], "doc_id long, text string"), vocabulary(PIECES)).count() == 0
    assert [Q.script_of(t) for t in ("plain text", "Привет", "漢字漢字a", "123 !?", "", "שלום")] == ["LATIN", "CYRILLIC", "CJK", "NONE", "NONE", "HEBREW"]


def test_bands_decide():
    bands = {**Q.BANDS, "LATIN": Q.Band(100, 200, 0, 0, 0)}
    cols = Q.measure_texts(["word other again more text here " * 2 + " ".join(f"w{i}" for i in range(40))], vocabulary(PIECES), bands)
    assert cols[5].to_pylist() == [False] and cols[-1].to_pylist() == [False]


def test_clean_documents_stay(spark, folder):
    got = {r.doc_id: r for r in op9_tokeniser_fertility(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1 and not got[i].base_failed]
    assert clean and all(got[i].kept for i in clean)


def test_language_floors_reject_junk(spark, folder):
    """Labelled junk that the base rule passes goes, and clean texts stay."""
    got = {r.doc_id: r for r in op9_tokeniser_fertility(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {q: [got[i].kept for i, x in labels.items() if x == q and not got[i].base_failed] for q in (0, 1)}
    assert kept[0] and sum(kept[0]) <= 0.2 * len(kept[0]) and all(kept[1])


def test_letters_tell_the_language():
    fertility = Q.Fertility(vocabulary(PIECES))
    texts = {
        "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience",
        "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt",
        "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience",
        "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia",
        "": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem",
    }
    words = [t.encode().split() for t in [*texts.values(), "", "123 !?", "漢字"]]
    ids = fertility.table.ids([w for ws in words for w in ws])
    assert fertility.languages(ids, np.cumsum([0, *map(len, words)])) == [*texts, "", "", ""]


def test_texts_are_measured_in_small_steps(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from mailglass.llm import quality_rules as Q

    real = Q.append_columns
    seen = lambda texts: [pa.array([sum(map(len, texts))] * len(texts), pa.int64())]
    monkeypatch.setattr(Q, "append_columns", lambda df, col, work, fields, *most: real(df, col, seen, [T.StructField("seen", T.LongType())], *most))
    docs = spark.range(12, numPartitions=1).select("id", F.repeat(F.lit("x"), 1 << 18).alias("text"))
    assert Q.quality_rules(docs, "none").agg(F.max("seen")).first()[0] <= Q.STEP_BYTES
