"""From features to signals, a score, a verdict, a category and reasons: one projection per mail, no shuffle.

Every enabled rule becomes a column expression over its scope. Signals keep the rules' order, which the stack signal counts
along. Trust comes in as a column (see operators.trust), so that a batch or a stream without a history needs no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailglass.functions import values as V
from mailglass.functions.rules import Rule, Spec, holds_sql, quoted, reason_sql
from mailglass.functions.text import auth_points, settled, verdict
from mailglass.operators.mail_features import with_features
from mailglass.operators.mail_indicators import ioc_count, with_authentication, with_indicators
from mailglass.operators.mail_texts import Seek, hits_of, seek_of
from mailglass.rulebook import Rulebook

SIGNAL = "array<struct<id:string,points:double,reason:string>>"
#: What names an item of a scope in a reason where no condition shows a value.
NAMES = {"url": "url", "attachment": "filename", "domain": "domain", "mail": None}
#: Mail fields whose text is folded already.
FOLDED = ("subject", "body", "text", "visible_text", "from.display_name", "from.display_brand", "text_brand_hits", "otp_notice")


def _kind(schema: T.StructType, path: str) -> str | None:
    for name in path.split("."):
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return None
        schema = schema[name].dataType
    if isinstance(schema, T.BooleanType):
        return "boolean"
    if isinstance(schema, T.ArrayType):
        return "array"
    return "number" if isinstance(schema, T.NumericType) else "string"


def _typed(s: Spec, schema: T.StructType) -> Spec:
    return Spec(s.field, s.operator, s.values, s.case_sensitive, _typed(s.exclude, schema) if s.exclude else None, _kind(schema, s.field) or "string")


def _path(item: str, path: str) -> str:
    return ".".join([item, *(f"`{name}`" for name in path.split("."))])


def _reader(item: str, schema: T.StructType):
    return lambda path: _path(item, path) if _kind(schema, path) else None


def _shown(get, schema: T.StructType):
    """Fields as reasons show them: lists in brackets."""

    def show(path: str) -> str | None:
        c = get(path)
        return f"concat('[', array_join(transform({c}, v -> concat('\\'', v, '\\'')), ', '), ']')" if c and _kind(schema, path) == "array" else c

    return show


def _signal(rule: Rule, points: str, text: str) -> str:
    return f"named_struct('id', {quoted(rule.id)}, 'points', cast({points} as double), 'reason', {text})"


def _declared(rule: Rule, schemas: dict[str, T.StructType], book: Rulebook, seek: Seek | None) -> str:
    """The signal of a rule of conditions, null where it does not hold. Of several items the first that fits counts.

    seek: of the automaton that has read the mail's texts; None if it read them for another book."""
    schema = schemas[rule.scope]
    typed = Rule(rule.id, rule.points, tuple(_typed(s, schema) for s in rule.specs), rule.reason, rule.scope)

    def judge(item: str, folded, slot=None) -> str:
        get = _reader(item, schema)
        hit, value = holds_sql(typed, get, book.terms, folded, slot)
        own = get(NAMES[rule.scope]) if NAMES[rule.scope] else "''"
        return f"case when {hit} then {_signal(rule, str(rule.points), reason_sql(rule.reason, f'coalesce({value}, {own})' if value else own, _shown(get, schema)))} end"

    if rule.scope == "mail":

        def folded(path: str) -> str | None:
            if path in FOLDED:
                return _path("mail", path)
            return {"raw_html": "found.folded_html", "from.raw": "found.folded_from.raw", "from.domain": "found.folded_from.domain"}.get(path)

        def slot(path: str, terms) -> str | None:
            n = seek.slot(path, terms) if seek else None
            return None if n is None else f"get(found.{hits_of(book)}, {n})"

        return judge("mail", folded, slot)
    if rule.scope == "url":
        judged = f"transform(url, (x, i) -> {judge('x', lambda path: 'get(found.folded_urls, i)' if path == 'url' else None)})"
    else:
        judged = f"transform({rule.scope}, x -> {judge('x', lambda path: None)})"
    return f"get(filter({judged}, s -> s is not null), 0)"


def _detected(rule: Rule, schema: T.StructType) -> str:
    """Signals of a rule whose detector reads one mail alone."""
    show = _shown(_reader("mail", schema), schema)
    found = f"found.{rule.detector}"
    make = lambda value: _signal(rule, str(rule.points), reason_sql(rule.reason, value, show))
    if rule.detector == "att_random_name":
        return f"transform({found}, v -> {make('v')})"
    if rule.detector == "text_invisible_obfuscation":
        return f"array(case when {found} then {make(quoted(''))} end)"
    return f"array(case when {found} is not null then {make(found)} end)"


def with_signals(mails: DataFrame, book: Rulebook) -> DataFrame:
    """mails (with features) with `signals`: id, points and reason of every rule that fires, in the rules' order."""
    kinds = {scope: mails.schema[scope].dataType for scope in ("mail", "url", "domain", "attachment")}
    schemas = {scope: k.elementType if isinstance(k, T.ArrayType) else k for scope, k in kinds.items()}
    seek = seek_of(book) if hits_of(book) in mails.schema["found"].dataType.names else None
    real = lambda parts: [f"filter({p}, s -> s is not null)" for p in parts]
    all_of = lambda parts: f"cast(concat({', '.join(parts)}) as {SIGNAL})" if parts else f"cast(array() as {SIGNAL})"
    parts: list[str] = []
    singles: list[str] = []
    x = mails

    def settle() -> None:
        if singles:
            parts.extend(real([f"array({', '.join(singles)})"]))
            singles.clear()

    for rule in book.rules:
        if not rule.enabled:
            continue
        if rule.detector is None:
            singles.append(_declared(rule, schemas, book, seek))
        elif rule.detector == "signal_stack":
            settle()
            x = x.withColumn("_fired", F.expr(all_of(parts)))
            n = f"size(filter(_fired, s -> not s.id in ({', '.join(map(quoted, V.STACK_NOISE))})))"
            points = "case " + " ".join(f"when {n} >= {least} then {given}" for least, given in V.STACK_TIERS) + " end"
            parts[:] = ["_fired", *real([f"array(case when {points} is not null then {_signal(rule, points, reason_sql(rule.reason, n, lambda path: None))} end)"])]
        else:
            settle()
            parts += real([_detected(rule, schemas["mail"])])
    settle()
    return settled(x, "signals", F.expr(all_of(parts))).drop("_fired")


def has_signal(ids: tuple[str, ...]) -> Column:
    return F.exists("signals", lambda s: s["id"].isin(*ids))


def category(intel_hit: Column) -> Column:
    """phishing with a strong signal or an intelligence hit, marketing with two different marks of it, else unknown."""
    marks = F.size(F.array_distinct(F.filter(F.transform("signals", lambda s: s["id"]), lambda i: i.isin(*V.MARKETING))))
    return F.when(has_signal(V.STRONG) | intel_hit, "phishing").when(marks >= 2, "marketing").otherwise("unknown")


def auth_reasons() -> Column:
    def one(method: str) -> Column:
        r = F.col(f"auth.{method}")
        said = {"fail": "fail", "softfail": "softfail", "none": "none（未配置）", "neutral": "neutral（未作断言）"}
        return reduce(lambda c, kv: c.when(r == kv[0], F.lit(f"邮件认证: {method.upper()}: {kv[1]}")), said.items(), F.when(F.lit(False), F.lit("")))

    return F.filter(F.array(*map(one, ("spf", "dkim", "dmarc"))), lambda x: x.isNotNull())


#: States of a look-up and how a report calls them; what reasons say beside the rules' own texts.
STATES = {"hit": "命中", "clean": "确认干净", "unknown": "无历史", "error": "失败", "no_key": "未启用"}
PROFILE_DROP = {"gateway": (), "mailbox": ("header_missing_auth",)}
PROFILE_NOTE = "说明: 分析档位: mailbox（邮箱直读）——认证结果头缺失属渠道形态，不计分（服务商不写 Authentication-Results，非发件方风险行为）（已剔除信号: header_missing_auth）"
OFFLINE_NOTE = f"评分说明: 离线模式（本次未查询威胁情报），已按本地维度（认证+启发式，满分 {V.OFFLINE_MAX}）归一化到 0-100"
NO_IOC_NOTE = f"评分说明: 未发出情报查询（本邮件没有可提取的外部 IOC），已按本地维度（认证+启发式，满分 {V.OFFLINE_MAX}）归一化到 0-100"
INTEL = "array<struct<ioc:string,ioc_type:string,source:string,status:string,malicious_score:int,summary:string>>"


def scored(mails: DataFrame, offline: bool = True, profile: str = "gateway") -> DataFrame:
    """mails (with signals and, if given, `intel` and `trust_note`) with score, verdict, category, reasons and breakdown.

    intel: results of look-ups (INTEL). Without a usable one, or offline, the local parts are scaled to 100.
    """
    dropped = PROFILE_DROP[profile]
    x = mails.withColumn("intel", F.coalesce(F.col("intel"), F.array().cast(INTEL)) if "intel" in mails.columns else F.array().cast(INTEL))
    x = x.withColumn("trust_note", F.coalesce(F.col("trust_note"), F.lit("")) if "trust_note" in mails.columns else F.lit(""))
    x = x.withColumn("_gone", has_signal(dropped) if dropped else F.lit(False)).withColumn("signals", F.filter("signals", lambda s: ~s["id"].isin(*dropped)) if dropped else F.col("signals"))
    hits = F.filter("intel", lambda r: r["status"] == "hit")
    x = x.withColumn("_hits", hits)
    best = F.coalesce(F.array_max(F.transform("_hits", lambda r: F.coalesce(r["malicious_score"], F.lit(0)))), F.lit(0))
    raw = F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["points"])
    x = x.withColumns({"_best": best, "_raw": raw, "_auth": auth_points(*[F.col(f"auth.{m}") for m in ("spf", "dkim", "dmarc")])})
    x = x.withColumn("_intel", F.when(F.size("_hits") > 0, F.greatest("_best", F.lit(V.INTEL_FLOOR)) / 100 * V.INTEL_WEIGHT * 100).otherwise(0.0))
    x = x.withColumn("_heuristic", F.least("_raw", F.lit(float(V.HEURISTIC_CAP)))).withColumn("_total", F.col("_intel") + F.col("_auth") + F.col("_heuristic"))
    usable = F.exists("intel", lambda r: (r["status"] == "hit") | ((r["status"] == "clean") & (r["ioc_type"] == "hash")))
    x = x.withColumn("_local", F.lit(True) if offline else ~F.coalesce(usable, F.lit(False)))
    x = x.withColumn("score", F.when(F.col("_local"), F.bround(F.col("_total") / V.OFFLINE_MAX * 100)).otherwise(F.bround("_total")).cast("int"))
    x = x.withColumn("category", category(F.size("_hits") > 0)).withColumn("_was", verdict(F.col("score")))
    passed = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"auth.{m}") == "pass", F.lit(False)) for m in ("spf", "dkim", "dmarc")))
    x = x.withColumn("_spam", (F.col("_was") != "BENIGN") & (F.col("category") == "marketing") & passed)
    x = x.withColumn("verdict", F.when(F.col("_spam"), "SPAM").otherwise(F.col("_was")))
    # Reasons: the summary of look-ups, what was done to the result, then what counted.
    n_of = lambda k: F.size(F.filter("intel", lambda r: F.coalesce(r["status"], F.lit("error")) == k))
    states = F.array_join(F.filter(F.array(*[F.when(n_of(k) > 0, F.concat(F.lit(v + " "), n_of(k).cast("string"))) for k, v in STATES.items()]), lambda t: t.isNotNull()), "，")
    summary = F.when(F.size("intel") > 0, F.concat(F.lit("威胁情报: 查询 "), F.size("intel").cast("string"), F.lit(" 条 IOC，"), states))
    marks = F.size(F.array_distinct(F.filter(F.transform("signals", lambda s: s["id"]), lambda i: i.isin(*V.MARKETING)))).cast("string")
    demoted = F.when(F.col("_spam"), F.concat(F.lit("处置降档: 类别判定 marketing（"), marks, F.lit(" 项独立营销证据）且发件方认证通过，无钓鱼强信号与情报命中，结论降为 SPAM（营销/垃圾归档，非安全事件）")))
    useless = F.concat(F.lit("评分说明: 威胁情报未提供有效数据（已查询 "), F.size("intel").cast("string"), F.lit(f" 条 IOC，均无恶意命中），已按本地维度（认证+启发式，满分 {V.OFFLINE_MAX}）归一化到 0-100"))
    note = F.when(F.col("_local"), F.lit(OFFLINE_NOTE) if offline else F.when(F.size("intel") == 0, F.lit(NO_IOC_NOTE)).otherwise(useless))
    floor = F.when(
        (F.size("_hits") > 0) & (F.col("_best") < V.INTEL_FLOOR),
        F.concat(F.lit("威胁情报命中: 最高检出置信度 "), F.col("_best").cast("string"), F.lit(f"/100 低于命中保底 {V.INTEL_FLOOR}，按保底计分（{V.INTEL_FLOOR * V.INTEL_WEIGHT:.1f} 分）——命中即至少定性为可疑，检出引擎数只在保底之上继续拉开差距")),
    )
    hit_lines = F.transform("_hits", lambda r: F.concat(F.lit("威胁情报命中: ["), r["source"], F.lit("] "), r["ioc"], F.lit(": "), F.coalesce(r["summary"], F.lit(""))))
    lines = F.concat(
        F.array(summary, demoted, note), hit_lines, F.array(floor), auth_reasons(), F.transform("signals", lambda s: F.concat(F.lit("启发式: "), s["reason"])),
        F.array(F.when(F.col("_gone"), F.lit(PROFILE_NOTE)), F.when(F.col("trust_note") != "", F.concat(F.lit("说明: "), F.col("trust_note")))),
    )
    x = x.withColumn("reasons", F.filter(lines, lambda t: t.isNotNull()))
    parts = F.struct(F.round("_intel", 1).alias("intel"), F.round("_auth", 1).alias("auth"), F.round("_heuristic", 1).alias("heuristic"), F.col("_raw").alias("raw_signals_points"), F.col("_local").alias("normalized"))
    # Settled, so that a filter on the verdict is not pushed below all that the verdict follows from, and computed there again.
    result = F.struct("score", "verdict", "category", "reasons", parts.alias("breakdown"))
    kept = [c for c in x.columns if c not in ("score", "verdict", "category", "reasons", "breakdown") and (c in mails.columns or not c.startswith("_"))]
    return settled(x.select(*[F.col(f"`{c}`") for c in kept], result.alias("_made")), "_result", F.col("_made")).select(*[F.col(f"`{c}`") for c in kept], "_result.*")


def analysed(mails: DataFrame, book: Rulebook, offline: bool = True, profile: str = "gateway", **options) -> DataFrame:
    """mails of sources.mail.parse_mails with everything up to the verdict, and ioc_count."""
    x = with_features(with_authentication(with_indicators(mails)), book, **options)
    return scored(with_signals(x, book), offline, profile).withColumn("ioc_count", ioc_count())
