"""Queries over every row of a table, against brute force."""

import re
import unicodedata

import pytest
from mailglass.functions import values as V
from mailglass.plans import catalog, mails


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def folded(text):
    out = []
    for c in text:
        for d in unicodedata.normalize("NFKD", c):
            if d not in "\u00ad\ufeff" and not "\u200b" <= d <= "\u200f" and not "\u2060" <= d <= "\u2064" and unicodedata.category(d) != "Mn":
                out.append(dict(zip(*V.HOMOGLYPHS, strict=True)).get(d, d))
    return "".join(out)


def test_every_text_is_folded(spark, folder, texts):
    rows = catalog.queries()["fold_texts"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and any(not t.isascii() for t in texts.values())
    assert all(r.folded == r.unmasked == folded(texts[r.doc_id]) for r in rows)


def test_plain_texts_are_folded_with_all_others(spark, folder, texts):
    rows = catalog.queries()["fold_ascii"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.folded, r.plain, r.same) == (folded(t), t.isascii(), folded(t) == t)
        assert r.same or not r.plain


def test_every_password_candidate_is_found(spark, folder, texts):
    rows = catalog.queries()["archive_password_lists"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = set()
    for r in rows:
        lead = [f"k{r.doc_id % 7 * (i % 6)}-x" for i in range(r.doc_id % 10)]
        more = re.findall(r"(?:password|passcode|passwd|pwd)\s*(?:is|[:：=])?\s*([A-Za-z0-9@#$%^&*_\-+.]{3,32})", texts[r.doc_id], re.I)
        assert list(r.candidates) == list(dict.fromkeys([*lead, *more]))[:8]
        sizes.add(len(r.candidates))
    assert max(sizes) >= 6


def test_every_language_is_counted(spark, folder, texts):
    rows = catalog.queries()["rule_counts_all"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.many, r.often) == (len(re.findall("th[a-z]", t, re.I)) > 40, t.lower().count("the") > 10)


def test_labels_are_met_before_mails_are_scored(spark, folder):
    x = mails.labelled(spark, folder)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("ArrowEvalPython") < plan.index("Join Inner")
    labels = {r.doc_id: r.quality == 0 for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    pages = {r.page_id for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert {r.page_id: r.bad for r in x.select("page_id", "bad").collect()} == {k: v for k, v in labels.items() if k in pages}
