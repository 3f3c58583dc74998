import pytest
from pyspark.sql import functions as F

from mailglass.functions import rules as R
from mailglass.functions import text as X


def get(name):
    return f"`{name}`" if name in ("s", "n", "b", "a", "h") else None


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "Verify your ACCOUNT now", 5, True, ["x"], "mail.example.com"), (2, "", 0, False, [], "example.com"), (3, None, None, None, None, "badexample.com"), (4, "a@b@c", -1, True, ["x", "y"], "")]
    return spark.createDataFrame(rows, "id int, s string, n int, b boolean, a array<string>, h string")


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        (R.Spec("s", "contains_any", ("none", "account")), [1]),
        (R.Spec("s", "contains_any", ("account",), case_sensitive=True), []),
        (R.Spec("s", "contains_all", ("verify", "now")), [1]),
        (R.Spec("s", "regex_any", (r"v[a-z]+y\s",)), [1]),
        (R.Spec("n", "equals_any", ("5", "0"), kind="number"), [1, 2]),
        (R.Spec("b", "equals_any", ("false",), kind="boolean"), [2]),
        (R.Spec("h", "suffix_any", ("example.com",)), [1, 2]),
        (R.Spec("s", "exists", (True,)), [1, 4]),
        (R.Spec("s", "exists", (False,)), [2, 3]),
        (R.Spec("n", "gt", (0,), kind="number"), [1]),
        (R.Spec("n", "lt", (0,), kind="number"), [4]),
        (R.Spec("s", "gt", (0,)), []),
        (R.Spec("a", "length_gt", (1,), kind="array"), [4]),
        (R.Spec("s", "length_lt", (1,)), [2]),
        (R.Spec("s", "count_gt", ("@", 1)), [4]),
        (R.Spec("s", "regex_count_gt", ("[A-Z]", 3)), [1]),
        (R.Spec("n", "gt", (-5,), kind="number", exclude=R.Spec("b", "exists", (True,), kind="boolean")), [2]),
        (R.Spec("unknown", "exists", (False,)), []),
    ],
)
def test_operators(items, spec, want):
    hit, _ = R.condition(spec, get)
    assert [r.id for r in items.filter(hit).orderBy("id").collect()] == want


def test_dictionaries_reasons_and_order(items):
    rules = [
        R.Rule("first", 3, (R.Spec("s", "contains_any", ("@dict:d",)),), "saw {value} in {s} {nothing}"),
        R.Rule("off", 3, (R.Spec("s", "exists", (True,)),), enabled=False),
        R.Rule("both", 2, (R.Spec("n", "gt", (0,), kind="number"), R.Spec("b", "exists", (True,), kind="boolean"))),
    ]
    d = {"d": ["zzz", "Account"]}
    for r in rules:
        R.validate(r, d)
    got = {r.id: r.signals for r in items.select("id", R.signals(rules, get, d).alias("signals")).collect()}
    assert [(s.ord, s.id, s.points) for s in got[1]] == [(0, "first", 3.0), (2, "both", 2.0)] and got[3] == []
    assert got[1][0].reason == "saw Account in Verify your ACCOUNT now "
    with pytest.raises(R.RuleError):
        R.validate(R.Rule("x", 1, (R.Spec("s", "contains_any", ("@dict:missing",)),)), d)
    with pytest.raises(R.RuleError):
        R.validate(R.Rule("Bad Id", 1, ()), d)
    with pytest.raises(R.RuleError):
        R.validate(R.Rule("x", 1, (R.Spec("s", "regex_any", ("(",)),)), d)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_text_functions(spark):
    L = F.lit
    assert [one(spark, X.registrable_domain(L(h))) for h in ("www.tsinghua.edu.cn", "mail.example.com", "203.0.113.66", "")] == ["tsinghua.edu.cn", "example.com", "113.66", ""]
    assert one(spark, X.lookalike(L("bizsupport.co"), L("support.co"))) and not one(spark, X.lookalike(L("foo-example.com"), L("example.com")))
    assert one(spark, X.double_extension(L("x.pdf.exe"))) and not one(spark, X.double_extension(L("cv.last.pdf")))
    assert not one(spark, X.random_filename(L("ReportQ3Final2026"))) and one(spark, X.random_filename(L("xK7bQz9TrWp2")))
    assert one(spark, X.invisible_obfuscation(L("pay​pal"))) and one(spark, X.invisible_obfuscation(L("𝐏ay"))) and not one(spark, X.invisible_obfuscation(L("Pagé")))
    assert [one(spark, X.private_ip(L(i))) for i in ("10.0.0.1", "172.31.0.1", "172.32.0.1", "100.64.0.1", "8.8.8.8")] == [True, True, False, True, False]
    assert one(spark, X.auth_points(L("softfail"), L("none"), L(None).cast("string"))) == pytest.approx(3.6)
    assert [one(spark, X.verdict(L(s))) for s in (29, 30, 54, 55)] == ["BENIGN", "SUSPICIOUS", "SUSPICIOUS", "MALICIOUS"]
    assert one(spark, X.mechanism(L("spf=fail; SPF = pass"), "spf")) == "pass" and one(spark, X.mechanism(L("dkim=none"), "spf")) is None
