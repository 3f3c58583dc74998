import re
from collections import Counter

import corpus_pipeline as P
from mailglass.llm import jaccard_join, quality_rules
from mailglass.llm.queries import PIECES, vocabulary


def test_stages_work_on_what_was_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    all_rows = docs.collect()
    assert [n for n, _ in P.STAGES] == ["quality_rules", "jaccard_join", "secret_scan", "mix_sources", "packing"]
    good = P.keep_good(spark, docs, folder)
    verdict = quality_rules.measure_texts([r.text for r in all_rows], vocabulary(PIECES), quality_rules.BANDS)[-1].to_pylist()
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r, k in zip(all_rows, verdict, strict=True) if k)
    one = P.drop_near_copies(spark, good, folder)
    comp = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(good).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(comp.values()))
    fixture = spark.createDataFrame([(1, "a password=hunter2hunter2 b", "en", "s", 27), (2, "clean", "en", "s", 5), (3, None, None, None, None)], docs.schema)
    clean = P.redact_secrets(spark, fixture, folder)
    assert [tuple(r) for r in clean.collect()] == [(1, "a [assign] b", "en", "s", 12), (2, "clean", "en", "s", 5), (3, None, None, None, None)]
    for d in (good, one, clean, P.mix(spark, fixture, folder)):
        assert d.columns == docs.columns


def test_whole_run(spark, folder):
    rows = P.run(spark, folder).collect()
    assert rows
    by_seq = Counter()
    for r in rows:
        by_seq[r.sequence_id] += r.length
    assert max(by_seq.values()) <= 2048


def test_entry_registers_everything():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == {str(i) for i in range(1, 14)}
    assert set(e.oracle_sql()) <= names


def test_sequences_carry_their_tokens(spark, folder):
    rows = P.pack(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(20), folder).collect()
    assert rows and all(len(r.ids) == r.length for r in rows) and sum(r.length for r in rows) > 0
