"""The automaton against one search after the other."""

import re
from dataclasses import replace

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailglass import rulebook
from mailglass.functions.folding import bare_one, fold_one, refang_one
from mailglass.functions.rules import Rule, Spec, condition_sql
from mailglass.operators import mail_texts as M

BOOK = rulebook.builtin()
SEEK = M.seek_of(BOOK)
WORDS = sorted({k for _, terms in SEEK.lists for k, _ in terms} | set(SEEK.brands) | set(SEEK.codes) | set(SEEK.clauses) | {c for _, cs in SEEK.shadows for c in cs} | set(M.CUES))
pieces = st.lists(st.one_of(st.sampled_from(WORDS), st.sampled_from([" ", "x", "1", "\n", "483920", "é"])), max_size=12).map("".join)


def met(parts, of, terms):
    return next((v for k, v in terms if any(k in parts[p] for p in of)), None)


def brands(text, texts):
    return [b for b in SEEK.brands if any(re.search(M.brand_pattern(b), t) for t in texts) and (not (b in M.PLATFORMS or b in dict(SEEK.shadows)) or M.brand_stands(text, b, dict(SEEK.shadows).get(b, ())))]


@settings(max_examples=150, deadline=None)
@given(st.fixed_dictionaries({p: pieces for p in M.PARTS}))
def test_all_that_is_found(parts):
    got = M.Finder.of(SEEK).mail(parts)
    assert got["hits"] == [met(parts, of, terms) for of, terms in SEEK.lists]
    for name, of in M.BRAND_TEXTS.items():
        texts = [parts[p] for p in of]
        assert got["brands"][name] == brands("\n".join(texts), texts), name
    assert got["code"] == M.code_notice(parts["text"] + "\n" + parts["visible"], SEEK.codes, SEEK.clauses)


def test_slots_are_those_of_the_book():
    assert len(SEEK.lists) > 15 and SEEK.lists[0] == (M.FIELDS["body"], tuple((u, u) for u in M.UNSUBSCRIBE))
    own = rulebook.with_rule(BOOK, {"id": "fruit", "points": 4, "match": {"field": "subject", "operator": "contains_any", "values": ["Pear", "apple"]}})
    assert M.seek_of(own).slot("subject", (("pear", "Pear"), ("apple", "apple"))) == len(SEEK.lists) and M.hits_of(own) != M.hits_of(BOOK)
    assert SEEK.slot("subject", (("pear", "Pear"),)) is None and SEEK.slot("from.domain", SEEK.lists[1][1]) is None
    spec = Spec("subject", "contains_any", ("Pear",))
    assert condition_sql(spec, lambda f: "s", folded=lambda f: "low", slot=lambda f, t: "hits[3]") == ("coalesce(hits[3] is not null, false)", "hits[3]")
    assert "contains(_hay" in condition_sql(spec, lambda f: "s", folded=lambda f: "low", slot=lambda f, t: None)[0]


def test_a_book_without_terms(spark):
    bare = replace(BOOK, rules=(Rule("r", 3, (Spec("subject", "length_gt", (2,)),)),), terms=BOOK.terms | {"brands": (), "otp_keywords": ()}, shadows={})
    seek = M.seek_of(bare)
    assert len(seek.lists) == 1 and M.Finder(seek).mail({p: "PayPal 验证码" for p in M.PARTS}) == {"hits": [None], "brands": {"seen": [], "hidden": [], "name": []}, "code": ""}
    x = spark.createDataFrame([("ＵNSUBSCRIBE &amp; x", None)], "t string, n string")
    got = x.select(M.read_texts({p: F.col("t" if p in ("html", "text") else "n") for p in M.GIVEN}, bare).alias("r")).first().r
    assert (got.text, got.html, got.plain, got.subject, got.hits) == ("unsubscribe &amp; x", "unsubscribe &amp; x", "unsubscribe & x", "", ["unsubscribe"])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("a&;é\u0301\u200b\u1d400аＡ\\/")), max_size=40))
def test_folding_by_runs_is_folding_whole(text):
    import html
    import unicodedata

    from mailglass.functions import values as V
    from mailglass.functions.text import ZERO_WIDTH

    bare = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn")
    seen = re.sub(ZERO_WIDTH, "", text)
    assert bare_one(text) == bare(text)
    assert fold_one(text) == (seen if seen.isascii() else bare(seen).translate(str.maketrans(*V.HOMOGLYPHS)))
    assert refang_one(text) == re.sub(r"\\+/", "/", bare(html.unescape(seen)))
