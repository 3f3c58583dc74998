"""What is known of a sender lowers signals of wording and form, never hard ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.functions import values as V
from mailglass.functions.text import terms
from mailglass.rulebook import Rulebook

MIN_COUNT, MIN_DOMAIN_COUNT, MIN_SPAN_DAYS = 2, 5, 14


def live_verdicts(verdicts: DataFrame, now: Column) -> DataFrame:
    """Verdicts (scope addr or domain, key, verdict, expires_at, note) that hold at `now`; no expiry holds for ever."""
    return verdicts.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def with_trust(mails: DataFrame, history: DataFrame, verdicts: DataFrame, book: Rulebook, now: Column | None = None) -> DataFrame:
    """mails (with signals) whose signals are lowered by trust, with trust_tier and trust_note.

    history: addr, domain, count, first_seen, last_seen, replied, link_domains, one row per address. A human verdict goes
    first, the address's before the domain's: phishing blocks all trust, benign stands for an established sender. Without
    one, an address that was answered or seen MIN_COUNT times is known; it is established when answered or by the history
    of its domain, which shared domains do not have. An established sender's links to its usual domains count less too.
    """
    now = F.current_timestamp() if now is None else now
    x = mails.withColumns({"_addr": F.col("mail.from.addr"), "_dom": F.col("mail.from.domain_reg")})
    h = history.select(F.col("addr").alias("_addr"), F.col("count").alias("_n"), F.col("replied").alias("_replied"), F.col("link_domains").alias("_known"))
    span = F.floor((F.unix_timestamp(F.max("last_seen")) - F.unix_timestamp(F.min("first_seen"))) / 86400)
    d = history.groupBy(F.col("domain").alias("_dom")).agg(F.sum("count").alias("_dn"), span.alias("_days"))
    v = live_verdicts(verdicts, now)
    by = lambda scope, key: v.filter(F.col("scope") == scope).select(F.col("key").alias(key), F.struct("verdict", "scope", "key", "expires_at", "note").alias(f"_{scope}_verdict"))
    x = x.join(h, "_addr", "left").join(d, "_dom", "left").join(by("addr", "_addr"), "_addr", "left").join(by("domain", "_dom"), "_dom", "left")
    human = F.coalesce("_addr_verdict", "_domain_verdict")
    x = x.withColumn("_human", F.when(F.col("_addr") != "", human))
    benign = F.coalesce(F.col("_human.verdict") == "benign", F.lit(False))
    blocked = F.coalesce(F.col("_human.verdict") == "phishing", F.lit(False))
    replied = F.coalesce("_replied", F.lit(False))
    shared = F.array_contains(terms([*book.terms["freemail"], *book.terms["esp_domains"]]), F.col("_dom"))
    old = ~shared & (F.coalesce("_dn", F.lit(0)) >= MIN_DOMAIN_COUNT) & (F.coalesce("_days", F.lit(0)) >= MIN_SPAN_DAYS)
    seen = benign | replied | (F.coalesce("_n", F.lit(0)) >= MIN_COUNT)
    tier = F.when(F.col("_addr") == "", "none").when(blocked, "blocked").when(~seen, "none").when(benign, "human_benign").when(replied | old, "established").otherwise("known")
    x = x.withColumn("trust_tier", tier)
    links = F.col("mail.link_domains")
    steady = F.col("trust_tier").isin("established", "human_benign") & (F.size(links) > 0) & (F.size(F.array_except(links, F.coalesce("_known", F.array().cast("array<string>")))) == 0)
    x = x.withColumn("_steady", steady)
    some, full = F.col("trust_tier").isin("known", "established", "human_benign"), F.col("trust_tier").isin("established", "human_benign")
    zero = [i for i in V.STRUCTURAL_DEMOTE if i not in V.NEVER_DEMOTE]
    less = [i for i in V.WORDING_DEMOTE if i not in V.NEVER_DEMOTE]

    def factor(s: Column) -> Column:
        i = s["id"]
        return F.when(some & i.isin(*zero), 0.0).when(full & (i == "signal_stack"), 0.0).when((full & i.isin(*less)) | (F.col("_steady") & (i == "link_domain_mismatch")), V.WORDING_FACTOR)

    lowered = F.transform(F.filter("signals", lambda s: factor(s).isNotNull()), lambda s: s["id"])
    x = x.withColumn("_lowered", F.array_sort(lowered))
    signals = F.transform("signals", lambda s: F.struct(s["id"].alias("id"), F.coalesce(F.round(s["points"] * factor(s), 2), s["points"]).alias("points"), s["reason"].alias("reason")))
    name = F.when(F.col("_dom") == "", F.col("_addr")).otherwise(F.concat("_addr", F.lit("（域 "), "_dom", F.lit("）")))
    parts = [
        F.when(F.col("_n").isNotNull(), F.concat(F.lit("该发件地址历史收到 "), F.col("_n").cast("string"), F.lit(" 封"))),
        F.when(benign, F.concat(F.lit("人工判定 "), F.col("_human.scope"), F.lit("="), F.col("_human.key"), F.lit(" 为正常"), F.when(F.coalesce(F.col("_human.note"), F.lit("")) != "", F.concat(F.lit("（"), F.col("_human.note"), F.lit("）"))).otherwise(""))),
        F.when(full & replied, F.lit("你给它写过信")).when(full & ~shared & (F.coalesce("_dn", F.lit(0)) > 0), F.concat(F.lit("域级历史 "), F.col("_dn").cast("string"), F.lit(" 封/跨度 "), F.col("_days").cast("string"), F.lit(" 天"))),
        F.when(F.col("_steady"), F.lit("链接域与历史一致")),
    ]
    told = F.array_join(F.filter(F.array(*parts), lambda t: t.isNotNull()), "；")
    why = F.when(full, F.concat(F.lit("已建立往来: "), name, F.lit("（"), told, F.lit("）"))).otherwise(F.concat(F.lit("已建立往来: "), name, F.lit("，"), told))
    note = F.concat(F.lit("信任上下文: "), why, F.lit(" → 降权 "), F.size("_lowered").cast("string"), F.lit(" 项话术/结构信号（"), F.array_join("_lowered", ", "), F.lit("）；硬信号不受影响"))
    until = F.when(F.col("_human.expires_at").isNotNull(), F.concat(F.lit("，"), F.date_format("_human.expires_at", "yyyy-MM-dd"), F.lit(" 到期"))).otherwise("")
    stop = F.concat(F.lit("该发件人已被人工确认为钓鱼（"), F.col("_human.scope"), F.lit("="), F.col("_human.key"), until, F.lit("）→ 不适用信任降权（硬信号与话术信号均按原口径计分）"))
    x = x.withColumn("trust_note", F.when(F.col("trust_tier") == "blocked", stop).when(F.size("_lowered") > 0, note).otherwise("")).withColumn("signals", signals)
    return x.select(*mails.columns, "trust_tier", "trust_note")
