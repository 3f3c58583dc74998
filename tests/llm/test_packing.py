import zlib
from collections import defaultdict

import numpy as np

from mailglass.llm import packing as P
from mailglass.llm.queries import WORD_BPE, op5_harmonic_packing, vocabulary


def check(rows, docs, tok):
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert set(by_doc) == set(docs)
    for i, t in docs.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return len(seqs), sum(r.length for r in rows)


def test_round_trip_and_padding(spark, folder):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    n, total = check(op5_harmonic_packing(spark, folder).collect(), docs, Tokenizer.from_file(vocabulary(WORD_BPE)))
    assert total > 0.97 * 2048 * (n - 1)


def test_odd_texts(spark):
    from tokenizers import Tokenizer

    texts = [None, "", " \n", "It's 12 o'clock <|endoftext|> x<|ENDOFTEXT|>", "İstanbul ŉ ſ é É ª º ǅ", "漢字 " * 900, "a" * 5000, "word " * 5000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length long")
    check(P.pack(df, vocabulary(WORD_BPE)).collect(), dict(enumerate(texts)), Tokenizer.from_file(vocabulary(WORD_BPE)))
    assert P.pack(df.limit(0), vocabulary(WORD_BPE)).count() == 0
    twice = P.pack(df.filter("doc_id = 7").unionAll(df.filter("doc_id = 7")), vocabulary(WORD_BPE), keep_ids=True).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens and all(len(r.ids) == r.length for r in twice)


def test_cut_lengths():
    for n in range(0, 6000, 7):
        parts = P.cut_length(n)
        assert sum(parts) == n and all(0 < p <= 2048 for p in parts)
        for p in parts:
            k = 2048 // p
            assert k * p >= 0.97 * 2048 or p <= 45


def test_what_is_left_over_is_bounded_by_the_capacity():
    assert P.most_left(2048) < 10_000
    for n in range(1, 2048):
        assert all(0 < x <= 2048 for x in P.cut_length(n)) and sum(P.cut_length(n)) == n


def test_ids_meet_their_pieces(spark, folder):
    import zlib

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(60)
    twice = docs.unionByName(docs.filter("doc_id < 10")).unionByName(spark.createDataFrame([(None, "no id here")], docs.schema))
    rows = P.pack(twice, vocabulary(WORD_BPE), keep_ids=True).collect()
    plain = P.pack(twice, vocabulary(WORD_BPE)).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    key = lambda rs: sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.ids_crc32) for r in rs)
    assert key(rows) == key(plain)


def test_a_task_gives_its_memory_back(monkeypatch):
    from mailglass.llm import common

    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("given back"))

    def run(batches):
        for b in batches:
            yield b
        said.append("ended")

    assert list(common.tidy(run)(iter([1, 2]))) == [1, 2] and said == ["ended", "given back"]


def test_few_words_are_remembered_and_slices_small(spark):
    rows = spark.range(40, numPartitions=1).selectExpr("id AS doc_id", "repeat('word and ', 8000) AS text")
    assert P.SLICE_BYTES <= 1 << 18 and P.TABLE_WORDS <= 100_000
    assert P.pieces(rows, vocabulary(WORD_BPE)).agg({"length": "sum"}).first()[0] == 40 * 16_001


def test_words_that_come_again_stay_remembered(monkeypatch):
    often = [a + b for a in "abcdefghijklmnopqrst" for b in ("anner", "ield", "orest", "under")]
    asked, look = [], P.WordIds.look
    monkeypatch.setattr(P.WordIds, "look", lambda self, words: (asked.extend(words), look(self, words))[1])
    ids = P.WordIds(vocabulary(WORD_BPE))
    for n in range(25):
        once = ["q" + "".join(chr(97 + (10_000 * n + i) // 26**k % 26) for k in range(4)) for i in range(10_000)]
        ids.encode([" ".join(often + once)])
    assert sum(w.decode() in often for w in asked) < 1.5 * len(often)


def test_remembered_words_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tok, ids = Tokenizer.from_file(vocabulary(WORD_BPE)), P.WordIds(vocabulary(WORD_BPE))
    texts = ["", "word*** it's rock'n'roll, a|b <|x. y.<|endoftext|>z.. a\0 a a\0\0", "Éa! ÷× ªº ſŉİ", "e\u0301, x<\u0338 a\u00a0b\x1cc", "漢字漢字漢字漢字 " * 3, "lo" + "ng" * 40 + "; 1234567890123456"]
    for _ in range(3):
        flat, at = ids.encode(texts)
        assert [flat[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
