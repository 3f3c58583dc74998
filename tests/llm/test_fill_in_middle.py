import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa
from mailglass.llm import fill_in_middle as M

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TEXTS = [None, "", " ", "one", "a b\n c  ", "übel  über\t日本 語", "holds <P> itself", "<", "x <S", "P> y", "\x00 nul \x0b vt", "😀 😀😀 é", "word " * 3000, "z" * 100_000]


def brute(text, doc_id, s=M.Settings()):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, q, m = s.marks
    if not text or any(k in text for k in s.marks) or h3 % 100 >= s.rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < s.spm:
        return len(units), "spm", len(prefix), len(middle), q + suffix + p + prefix + m + middle
    return len(units), "psm", len(prefix), len(middle), p + prefix + q + suffix + m + middle


def rows():
    return [(i if i % 17 else None, TEXTS[i % len(TEXTS)], "keep", "clash") for i in range(12 * len(TEXTS))]


def test_outputs_and_round_trip(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, own string, Form string").repartition(3)
    out = M.restore(M.fill_in_middle(df)).collect()
    want = sorted(((d, t, *brute(t, d)) for d, t, *_ in rows()), key=repr)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr) == want
    assert all(r.restored == (r.text or "") and r.own == "keep" for r in out)
    assert {r.form for r in out} == set(M.FORMS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = M.digests(df).collect()
    assert sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in got), key=repr) == sorted(((d, sha(brute(t, d)[-1]), sha(t or "")) for d, t, *_ in rows()), key=repr)


def test_other_settings_and_columns(spark):
    s = M.Settings("7", 100, 0, ("⟦pre⟧", "⟦suf⟧", "⟦mid⟧"))
    df = spark.createDataFrame([(i, f"some  words {i} and ⟦more⟧") for i in range(30)], "k int, body string")
    got = M.restore(M.fill_in_middle(df, s, "k", "body"), s).collect()
    assert [(r.k, r.output) for r in sorted(got)] == [(i, brute(f"some  words {i} and ⟦more⟧", i, s)[-1]) for i in range(30)]
    assert all(r.form == "psm" and r.restored == r.body for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.fill_in_middle(df).collect() == [] and M.digests(df).collect() == []
    one = spark.createDataFrame([(None, None), ("x", None)], "output string, form string")
    assert [r.restored for r in M.restore(one).collect()] == [None, None]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.sampled_from("aé日 \t\n<PSM>"), max_size=40), st.integers(0, 1 << 20)), min_size=1, max_size=8), st.integers(0, 2))
def test_slices_of_a_batch(pairs, skip):
    """Descriptors lie in the whole Arrow buffer, so a slice that starts later must give the same."""
    texts = pa.array([*["left out"] * skip, *[t for t, _ in pairs]], pa.string())[skip:]
    digests = [hashlib.sha256(f"42:{i}".encode()).hexdigest() for _, i in pairs]
    draws = np.array([[int(d[8 * k : 8 * k + 8], 16) for k in range(4)] for d in digests])
    pieces, said = M.rearrange(texts, draws, M.Settings())
    want = [brute(t, i) for t, i in pairs]
    assert [o.decode() for o in pieces.joined()] == [w[-1] for w in want]
    assert list(zip(said["n"], said["form"], said["prefix_chars"], said["middle_chars"], strict=True)) == [w[:-1] for w in want]
    assert [b.decode() for b in M.restored(pieces.joined(), said["form"], M.Settings()).joined()] == [t for t, _ in pairs]
