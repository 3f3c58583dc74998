import hashlib
import random
import re
import time

import numpy as np
import pytest

from mailglass.llm import queries
from mailglass.llm import secrets as S

PLAIN = [
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(t):
    out = []
    for r, (kind, p, g, least) in enumerate(PLAIN):
        out += [(m.start(), r, m.end()) for m in p.finditer(t) if len(m.group(g)) >= least]
    return sorted(out)


def test_base_spans_match_plain_expressions():
    rnd = random.Random(5)
    bits = ["password", "Token", "API_key", "apikey", "=", ": ", " ", '"', "'", "AKIA", "A1B2C3D4", "abc", "0123456789abcdef", "é", "漢", "\n", "x", "secret=", "ſecret", "passwd"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 50))) for _ in range(1500)] + ["token=" + "a" * 50_000, "f" * 9000, ""]
    for t, got in zip(texts, S.find_spans(texts, S.RULES), strict=True):
        assert [x for x in got if x[1] < 3] == brute(t)


def test_added_kinds():
    texts = ["x ghp_" + "a1B2" * 9 + " y", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890ab", "AIza" + "x" * 35, "no secret here"]
    kinds = [[S.RULES[r].kind for _, r, _ in f] for f in S.find_spans(texts, S.RULES)]
    assert [("forge" in k[:1]) for k in kinds][:1] == [True] and kinds[1] == ["pem"] and "chat" in kinds[2] and "maps" in kinds[3] and kinds[4] == []


def test_minimal_automaton_is_deterministic_and_small():
    a = S.compile_rules(S.RULES)
    assert a.next_row.max() < len(a.accepts) * a.n_classes and not a.accepts[0]
    assert len(a.accepts) < 2000 and a.resets[10]


def test_column_and_redaction(spark):
    df = spark.createDataFrame([(1, "password=abcdef12 tail", "clash"), (2, None, None), (3, "", None), (1, "password=abcdef12 tail", "clash"), (4, "é token: 'zzzzzz' AKIA" + "A" * 16, None)], "doc_id long, text string, spans string")
    rows = S.secret_spans(df).collect()
    assert [len(r.spans) for r in rows] == [1, 0, 0, 1, 2]
    assert rows[4].spans[0].start == 2
    assert S.redact(df).columns == df.columns
    assert [r.text for r in S.redact(df).collect()] == ["[assign] tail", None, "", "[assign] tail", "é [assign]' [access]"]
    assert S.secret_spans(df.limit(0)).count() == 0


def test_query(spark, folder):
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, folder).collect()}
    rows = queries.op7_secret_scan(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        base = ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert [x for x in r.spans.split(",") if x and x.split(":")[0] in ("assign", "access", "hex")] == [x for x in base.split(",") if x]


def test_lanes_agree_with_a_single_pass():
    rnd = random.Random(5)
    auto = S.compile_rules(S.RULES)
    parts = ["password = ", "  ", "0123456789abcdef", "token=", "AKIA", "A1B2", "\n", "xyz ", "é", "eyJ", "'", ": "]
    for size in (0, 1, 63, 64, 65, 5000, 30000):
        data = np.frombuffer("".join(rnd.choice(parts) for _ in range(size)).encode(), np.uint8)
        row, want = 0, []
        for i, b in enumerate(data.tolist()):
            row = int(auto.next_row[row + int(auto.class_of[b])])
            if auto.accepts[row // auto.n_classes]:
                want.append((i, int(auto.accepts[row // auto.n_classes])))
        where, bits = S.accepting(data, auto) if len(data) else ([], [])
        assert sorted(zip(map(int, where), map(int, bits), strict=True)) == want


@pytest.mark.parametrize("text", ["ab01" * 2_000_000, "token=" + "x" * 8_000_000, "password" + " " * 100_000 + "= abcdefgh"])
def test_long_texts_without_a_break(text):
    start = time.perf_counter()
    assert len(S.find_spans([text], S.RULES)[0]) == 1
    assert time.perf_counter() - start < 40
