"""Scoring queries. Signals come from lineitem: a mail is an order, its lines are signals, and the rule of a line is its
part's number modulo the number of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailglass.functions import text as X
from mailglass.functions import values as V
from mailglass.plans.registry import query, table

_N = len(V.RULES)
_STACK = next(i for i, (r, _) in enumerate(V.RULES) if r == "signal_stack")


def _list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


#: The rules as a table in SQL, and the signals on top of it.
RULES_SQL = "(VALUES " + ", ".join(f"({i}, '{r}', {p})" for i, (r, p) in enumerate(V.RULES)) + ") AS rules(ord, rule_id, points)"
SIGNALS_SQL = f"""
rules AS (SELECT * FROM {RULES_SQL}),
base AS (SELECT l_orderkey AS mail_id, l_linenumber AS line, r.ord, r.rule_id, CAST(r.points AS DOUBLE) AS points
         FROM lineitem JOIN rules r ON r.ord = l_partkey % {_N} WHERE r.rule_id <> 'signal_stack'),
stack AS (SELECT mail_id, count(*) FILTER (WHERE ord < {_STACK} AND rule_id NOT IN ({_list(V.STACK_NOISE)})) AS n FROM base GROUP BY mail_id),
signals AS (SELECT mail_id, line, ord, rule_id, points FROM base
            UNION ALL SELECT mail_id, 0, {_STACK}, 'signal_stack', CASE WHEN n >= 6 THEN 12.0 WHEN n >= 5 THEN 8.0 ELSE 4.0 END FROM stack WHERE n >= 4)
"""
VERDICT_SQL = "CASE WHEN score >= 55 THEN 'MALICIOUS' WHEN score >= 30 THEN 'SUSPICIOUS' ELSE 'BENIGN' END"
SCORED_SQL = f"""
{SIGNALS_SQL},
auth AS (SELECT o_orderkey AS mail_id, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'none' END AS spf,
         CASE WHEN o_custkey % 3 = 0 THEN 'softfail' ELSE 'pass' END AS dkim FROM orders),
sums AS (SELECT mail_id, sum(points) AS raw, count(*) AS n_signals, bool_or(rule_id IN ({_list(V.STRONG)})) AS strong,
         count(DISTINCT CASE WHEN rule_id IN ({_list(V.MARKETING)}) THEN rule_id END) AS marketing FROM signals GROUP BY mail_id),
scored AS (SELECT s.*, a.spf, a.dkim, CASE spf WHEN 'fail' THEN 4.0 WHEN 'none' THEN 4 * 0.3 ELSE 0.0 END + CASE dkim WHEN 'softfail' THEN 4 * 0.6 ELSE 0.0 END AS auth
           FROM sums s JOIN auth a USING (mail_id)),
finals AS (SELECT *, CAST(round_even((auth + least(raw, 30.0)) / 45 * 100, 0) AS INTEGER) AS score,
           CASE WHEN strong THEN 'phishing' WHEN marketing >= 2 THEN 'marketing' ELSE 'unknown' END AS category FROM scored),
verdicts AS (SELECT mail_id, n_signals, raw, CAST(round(auth, 6) AS DOUBLE) AS auth, score, category,
             CASE WHEN score >= 30 AND category = 'marketing' AND (spf = 'pass' OR dkim = 'pass') THEN 'SPAM' ELSE {VERDICT_SQL} END AS verdict FROM finals)
"""


def _ords(names) -> Column:
    """The rules' numbers as a literal array."""
    return X.terms(str(i) for i, (r, _) in enumerate(V.RULES) if r in names).cast("array<int>")


POINTS, NAMES = [str(float(p)) for _, p in V.RULES], [r for r, _ in V.RULES]


def rule_name(ord: Column) -> Column:
    return F.get(X.terms(NAMES), ord)


def fired(spark: SparkSession, folder: str) -> DataFrame:
    """mail_id, ords (the rules' numbers, a number for each time), stack (points of the stack signal, which counts only what
    fired before it and is no noise). One scan and one shuffle; a mail has as many numbers as signals."""
    ord = (F.col("l_partkey") % _N).cast("int")
    m = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("mail_id"), ord.alias("ord")).filter(F.col("ord") != _STACK).groupBy("mail_id").agg(F.collect_list("ord").alias("ords"))
    noise = _ords(V.STACK_NOISE)
    n = F.size(F.filter("ords", lambda o: (o < _STACK) & ~F.array_contains(noise, o)))
    return m.withColumn("stack", X.tiers(n, V.STACK_TIERS).cast("double"))


def own_points(ord: Column) -> Column:
    """All points of a rule in a mail."""
    times = F.size(F.filter("ords", lambda o: o == ord))
    return F.when(ord == _STACK, F.col("stack")).otherwise(F.get(X.terms(POINTS).cast("array<double>"), ord) * times)


def rules_of() -> Column:
    """The different rules of a mail, the stack included."""
    return F.array_distinct(F.when(F.col("stack") > 0, F.concat("ords", F.array(F.lit(_STACK)))).otherwise(F.col("ords")))


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """mail_id, rule_id, points: a row per signal, with the stack signal."""
    every = F.when(F.col("stack") > 0, F.concat("ords", F.array(F.lit(_STACK)))).otherwise(F.col("ords"))
    x = fired(spark, folder).select("mail_id", "stack", F.explode(every).alias("ord"))
    points = F.when(F.col("ord") == _STACK, F.col("stack")).otherwise(F.get(X.terms(POINTS).cast("array<double>"), F.col("ord")))
    return x.select("mail_id", rule_name(F.col("ord")).alias("rule_id"), points.alias("points"))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """A row per mail: ords and stack, their sum, authentication, normalised score, category, verdict and the mail's label."""
    x = fired(spark, folder)
    raw = F.aggregate("ords", F.lit(0.0), lambda a, o: a + F.get(X.terms(POINTS).cast("array<double>"), o)) + F.col("stack")
    x = x.withColumns({"raw": raw, "n_signals": F.size("ords").cast("long") + (F.col("stack") > 0).cast("int"), "strong": F.arrays_overlap("ords", _ords(V.STRONG)), "marketing": F.size(F.array_intersect("ords", _ords(V.MARKETING)))})
    spf = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("none")
    dkim = F.when(F.col("o_custkey") % 3 == 0, "softfail").otherwise("pass")
    auth = table(spark, folder, "orders").select(F.col("o_orderkey").alias("mail_id"), spf.alias("spf"), dkim.alias("dkim"), (F.col("o_custkey") % 4 == 0).alias("spam"))
    x = x.join(auth, "mail_id").withColumn("auth", X.auth_points(F.col("spf"), F.col("dkim"), F.lit(None)))
    x = x.withColumn("score", F.bround((F.col("auth") + F.least("raw", F.lit(float(V.HEURISTIC_CAP)))) / V.OFFLINE_MAX * 100, 0).cast("int"))
    x = x.withColumn("category", F.when(F.col("strong"), "phishing").when(F.col("marketing") >= 2, "marketing").otherwise("unknown"))
    lowered = (F.col("score") >= V.SUSPICIOUS_AT) & (F.col("category") == "marketing") & ((F.col("spf") == "pass") | (F.col("dkim") == "pass"))
    return x.withColumn("verdict", F.when(lowered, "SPAM").otherwise(X.verdict(F.col("score"))))


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).select("mail_id", "n_signals", "raw", F.round("auth", 6).alias("auth"), "score", "category", "verdict")


@query(f"WITH {SCORED_SQL} SELECT * FROM verdicts")
def score_signals(spark: SparkSession, folder: str) -> DataFrame:
    """The score, category and verdict of every mail."""
    return verdicts(spark, folder)


@query(f"WITH {SCORED_SQL} SELECT category, verdict, count(*) AS n FROM verdicts GROUP BY 1, 2")
def verdict_category_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    """A13."""
    return verdicts(spark, folder).groupBy("category", "verdict").agg(F.count("*").alias("n"))


@query(f"WITH {SCORED_SQL} SELECT coalesce(category, 'all') AS category, coalesce(verdict, 'all') AS verdict, count(*) AS n FROM verdicts GROUP BY CUBE (category, verdict)")
def verdict_category_cube(spark: SparkSession, folder: str) -> DataFrame:
    """A13 with totals."""
    c = verdicts(spark, folder).cube("category", "verdict").agg(F.count("*").alias("n"))
    return c.select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("verdict", F.lit("all")).alias("verdict"), "n")


@query(f"WITH {SIGNALS_SQL} SELECT rule_id, count(*) AS n FROM signals GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 15")
def rule_triggers_top(spark: SparkSession, folder: str) -> DataFrame:
    """The rules that fire most, a report of 15."""
    return signals(spark, folder).groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(15)


@query(f"WITH {SCORED_SQL} SELECT verdict, count(*) AS n, round(avg(score), 6) AS mean_score, max(score) AS max_score FROM verdicts GROUP BY 1")
def verdict_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A05 A07."""
    return verdicts(spark, folder).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("max_score"))


@query(f"WITH {SCORED_SQL} SELECT CAST(b AS INTEGER) AS bucket, count(mail_id) AS n FROM range(11) t(b) LEFT JOIN verdicts ON least(score // 10, 10) = b GROUP BY 1")
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Eleven buckets, empty ones too."""
    got = verdicts(spark, folder).groupBy(F.least(F.floor(F.col("score") / 10), F.lit(10)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(11).select(F.col("id").cast("int").alias("bucket")).join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {SCORED_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'MALICIOUS') AS malicious, count(*) FILTER (WHERE verdict = 'SUSPICIOUS') AS suspicious,
count(*) FILTER (WHERE verdict = 'BENIGN') AS benign FROM verdicts""")
def dashboard_kpis(spark: SparkSession, folder: str) -> DataFrame:
    """Spam has no column of its own."""
    of = lambda v: F.count_if(F.col("verdict") == v.upper()).alias(v)
    return verdicts(spark, folder).agg(F.count("*").alias("total"), of("malicious"), of("suspicious"), of("benign"))


@query(f"""WITH {SCORED_SQL} SELECT mail_id, verdict, score FROM verdicts
ORDER BY CASE verdict WHEN 'MALICIOUS' THEN 0 WHEN 'SUSPICIOUS' THEN 1 WHEN 'SPAM' THEN 2 ELSE 3 END, score DESC, mail_id LIMIT 50""")
def severity_sort(spark: SparkSession, folder: str) -> DataFrame:
    """The gravest mails first, a report of 50."""
    rank = F.when(F.col("verdict") == "MALICIOUS", 0).when(F.col("verdict") == "SUSPICIOUS", 1).when(F.col("verdict") == "SPAM", 2).otherwise(3)
    return verdicts(spark, folder).select("mail_id", "verdict", "score").orderBy(rank, F.desc("score"), "mail_id").limit(50)


LABEL_SQL = "label AS (SELECT o_orderkey AS mail_id, o_custkey % 4 = 0 AS spam FROM orders)"


@query(f"""WITH {SCORED_SQL}, {LABEL_SQL}, c AS (SELECT count(*) FILTER (WHERE spam AND verdict <> 'BENIGN') AS tp, count(*) FILTER (WHERE NOT spam AND verdict <> 'BENIGN') AS fp,
count(*) FILTER (WHERE spam AND verdict = 'BENIGN') AS fn, count(*) FILTER (WHERE NOT spam AND verdict = 'BENIGN') AS tn FROM verdicts JOIN label USING (mail_id))
SELECT *, round(tp / (tp + fp), 9) AS prec, round(tp / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged means not benign."""
    hit = F.col("verdict") != "BENIGN"
    c = judged(spark, folder).agg(*[F.count_if(a & b).alias(n) for n, a, b in (("tp", F.col("spam"), hit), ("fp", ~F.col("spam"), hit), ("fn", F.col("spam"), ~hit), ("tn", ~F.col("spam"), ~hit))])
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return c.select("*", F.round(tp / (tp + fp), 9).alias("prec"), F.round(tp / (tp + fn), 9).alias("recall"), F.round(2.0 * tp / (2 * tp + fp + fn), 9).alias("f1"))


@query(f"""WITH {SCORED_SQL}, {LABEL_SQL} SELECT round(count(*) FILTER (WHERE verdict = 'MALICIOUS') / count(*), 9) AS recall_strict,
round(count(*) FILTER (WHERE verdict IN ('MALICIOUS', 'SUSPICIOUS')) / count(*), 9) AS recall_flagged FROM verdicts JOIN label USING (mail_id) WHERE spam""")
def recall_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Spam verdicts do not count here."""
    n = F.count("*")
    return judged(spark, folder).filter("spam").agg(F.round(F.count_if(F.col("verdict") == "MALICIOUS") / n, 9).alias("recall_strict"), F.round(F.count_if(F.col("verdict").isin("MALICIOUS", "SUSPICIOUS")) / n, 9).alias("recall_flagged"))


@query(f"""WITH {SCORED_SQL}, {LABEL_SQL}, h AS (SELECT verdict, score, row_number() OVER (ORDER BY score, mail_id) - 1 AS r, count(*) OVER () AS n FROM verdicts JOIN label USING (mail_id) WHERE NOT spam)
SELECT round(avg(CASE WHEN verdict <> 'BENIGN' THEN 1.0 ELSE 0 END), 9) AS fp_rate, round(avg(CASE WHEN verdict = 'MALICIOUS' THEN 1.0 ELSE 0 END), 9) AS severe_rate,
round(avg(score), 6) AS mean_score, max(CASE WHEN r = n // 2 THEN score END) AS median_score, max(score) AS max_score FROM h""")
def fp_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The median is the upper one. Scores are few whole numbers, so it is read off their counts, not off sorted mails."""
    h = judged(spark, folder).filter("not spam").groupBy("score").agg(F.count("*").alias("c"), F.count_if(F.col("verdict") != "BENIGN").alias("fp"), F.count_if(F.col("verdict") == "MALICIOUS").alias("severe"))
    upto = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy())})
    middle = F.floor(F.col("n") / 2)
    return h.agg(
        F.round(F.sum("fp") / F.sum("c"), 9).alias("fp_rate"),
        F.round(F.sum("severe") / F.sum("c"), 9).alias("severe_rate"),
        F.round(F.sum(F.col("score") * F.col("c")) / F.sum("c"), 6).alias("mean_score"),
        F.min(F.when(F.col("upto") > middle, F.col("score"))).alias("median_score"),
        F.max("score").alias("max_score"),
    )


FP_SQL = f"{SCORED_SQL}, {LABEL_SQL}, fp AS (SELECT mail_id, raw, score FROM verdicts JOIN label USING (mail_id) WHERE NOT spam AND verdict IN ('MALICIOUS', 'SUSPICIOUS'))"


def false_positives(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).filter("not spam and verdict in ('MALICIOUS', 'SUSPICIOUS')")


@query(f"WITH {FP_SQL} SELECT rule_id, count(DISTINCT mail_id) AS n, round(count(DISTINCT mail_id) / (SELECT count(*) FROM fp), 9) AS share FROM signals JOIN fp USING (mail_id) GROUP BY 1")
def fp_presence(spark: SparkSession, folder: str) -> DataFrame:
    """In which share of the false positives each rule fired. All mails count under the number -1."""
    c = false_positives(spark, folder).select(F.explode(F.concat(rules_of(), F.array(F.lit(-1)))).alias("ord")).groupBy("ord").agg(F.count("*").alias("n"))
    every = F.max(F.when(F.col("ord") == -1, F.col("n"))).over(Window.partitionBy())  # a row per rule
    return c.withColumn("all", every).filter("ord >= 0").select(rule_name(F.col("ord")).alias("rule_id"), "n", F.round(F.col("n") / F.col("all"), 9).alias("share"))


@query(f"""WITH {SCORED_SQL}, f AS (SELECT s.rule_id, count(*) AS n, count(*) FILTER (WHERE v.verdict <> 'BENIGN') AS flagged FROM signals s JOIN verdicts v USING (mail_id) GROUP BY 1)
SELECT * FROM f ORDER BY flagged DESC, rule_id LIMIT 15""")
def signals_top_flagged(spark: SparkSession, folder: str) -> DataFrame:
    """The rules that fire most in flagged mails, and overall; a report of 15."""
    x = judged(spark, folder).withColumn("ord", F.explode(F.when(F.col("stack") > 0, F.concat("ords", F.array(F.lit(_STACK)))).otherwise(F.col("ords"))))
    c = x.groupBy("ord").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") != "BENIGN").alias("flagged"))
    return c.select(rule_name(F.col("ord")).alias("rule_id"), "n", "flagged").orderBy(F.desc("flagged"), "rule_id").limit(15)


@query(f"WITH {FP_SQL}, one AS (SELECT mail_id, min(rule_id) AS rule_id FROM signals JOIN fp USING (mail_id) GROUP BY 1 HAVING count(*) = 1) SELECT rule_id, count(*) AS n FROM one GROUP BY 1")
def single_signal_causes(spark: SparkSession, folder: str) -> DataFrame:
    """False positives with one signal, by that signal."""
    one = false_positives(spark, folder).filter("n_signals = 1").select(rule_name(F.coalesce(F.get("ords", F.lit(0)), F.lit(_STACK))).alias("rule_id"))
    return one.groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"""WITH {FP_SQL}, hit AS (SELECT mail_id, rule_id, sum(points) AS own FROM signals JOIN fp USING (mail_id) GROUP BY 1, 2)
SELECT h.rule_id, count(*) FILTER (WHERE least(fp.raw - own, 30.0) + greatest(fp.score / 100.0 * 45 - least(fp.raw, 30.0), 0) < 13.5) AS saved, count(*) AS n
FROM hit h JOIN fp USING (mail_id) GROUP BY 1""")
def fp_leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    """The false positives that would fall below the line without a rule, all rules of a mail judged where it stands."""
    hit = false_positives(spark, folder).withColumn("ord", F.explode(rules_of()))
    rest = F.greatest(F.col("score") / 100.0 * 45 - F.least("raw", F.lit(30.0)), F.lit(0.0))
    saved = F.least(F.col("raw") - own_points(F.col("ord")), F.lit(30.0)) + rest < 13.5
    return hit.groupBy("ord").agg(F.count_if(saved).alias("saved"), F.count("*").alias("n")).select(rule_name(F.col("ord")).alias("rule_id"), "saved", "n")


@query(f"WITH {FP_SQL}, c AS (SELECT mail_id, string_agg(DISTINCT rule_id, '+' ORDER BY rule_id) AS combo FROM signals JOIN fp USING (mail_id) GROUP BY 1) SELECT combo, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, combo LIMIT 10")
def signal_combos_top(spark: SparkSession, folder: str) -> DataFrame:
    """The sets of rules that most often fire together in false positives, a report of 10."""
    c = false_positives(spark, folder).select(F.array_join(F.array_sort(F.transform(rules_of(), rule_name)), "+").alias("combo"))
    return c.groupBy("combo").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combo").limit(10)


@query(f"WITH {FP_SQL}, m AS (SELECT mail_id, bool_and(rule_id IN ({_list(V.STACK_NOISE)})) AS noise FROM signals JOIN fp USING (mail_id) GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (WHERE noise) AS noise_only FROM m")
def noise_only_share(spark: SparkSession, folder: str) -> DataFrame:
    """False positives, and those of them that noise alone made."""
    noise = F.size(F.array_except(rules_of(), _ords(V.STACK_NOISE))) == 0
    return false_positives(spark, folder).agg(F.count("*").alias("n"), F.count_if(noise).alias("noise_only"))


@query(f"""WITH {SIGNALS_SQL}, {LABEL_SQL}, t AS (SELECT count(*) FILTER (WHERE spam) AS s, count(*) FILTER (WHERE NOT spam) AS h FROM label),
r AS (SELECT rule_id, count(DISTINCT mail_id) FILTER (WHERE spam) AS in_spam, count(DISTINCT mail_id) FILTER (WHERE NOT spam) AS in_ham FROM signals JOIN label USING (mail_id) GROUP BY 1)
SELECT rule_id, in_spam, in_ham, round(in_spam / s, 9) AS spam_rate, round(in_ham / h, 9) AS ham_rate, in_spam / s > in_ham / h AS effective FROM r, t""")
def label_discrimination(spark: SparkSession, folder: str) -> DataFrame:
    """How much more often a rule fires on labelled mail."""
    t = table(spark, folder, "orders").agg(F.count_if(F.col("o_custkey") % 4 == 0).alias("s"), F.count_if(F.col("o_custkey") % 4 != 0).alias("h"))
    r = judged(spark, folder).select("spam", F.explode(rules_of()).alias("ord")).groupBy("ord").agg(F.count_if("spam").alias("in_spam"), F.count_if(~F.col("spam")).alias("in_ham"))
    a, b = F.col("in_spam") / F.col("s"), F.col("in_ham") / F.col("h")
    return r.crossJoin(F.broadcast(t)).select(rule_name(F.col("ord")).alias("rule_id"), "in_spam", "in_ham", F.round(a, 9).alias("spam_rate"), F.round(b, 9).alias("ham_rate"), (a > b).alias("effective"))  # one row


@query(f"""WITH {SCORED_SQL}, f AS (SELECT * FROM (VALUES (0.0), (0.3), (0.5)) f(factor)), hit AS (SELECT mail_id, rule_id, sum(points) AS own FROM signals GROUP BY 1, 2)
SELECT rule_id, CAST(factor AS DOUBLE) AS factor, count(*) FILTER (WHERE v.score >= 30) AS was_flagged,
count(*) FILTER (WHERE round_even((auth + least(raw - own * (1 - CAST(factor AS DOUBLE)), 30.0)) / 45 * 100, 0) >= 30) AS flagged FROM hit JOIN verdicts v USING (mail_id), f GROUP BY 1, 2""")
def downweight_simulation(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged mails if a rule's points are scaled, for all rules and factors in one pass over the mails."""
    factors = (0.0, 0.3, 0.5)
    x = judged(spark, folder).withColumn("auth", F.round("auth", 6)).withColumn("ord", F.explode(rules_of())).withColumn("own", own_points(F.col("ord")))
    new = lambda f: F.bround((F.col("auth") + F.least(F.col("raw") - F.col("own") * F.lit(1 - f), F.lit(30.0))) / 45 * 100, 0)
    c = x.groupBy("ord").agg(F.count_if(F.col("score") >= 30).alias("was_flagged"), F.array(*[F.struct(F.lit(f).alias("factor"), F.count_if(new(f) >= 30).alias("flagged")) for f in factors]).alias("by"))
    return c.select(rule_name(F.col("ord")).alias("rule_id"), "was_flagged", F.inline("by")).select("rule_id", "factor", "was_flagged", "flagged")


_STRUCT, _WORD = _list(V.STRUCTURAL_DEMOTE), _list(V.WORDING_DEMOTE)


@query(f"""WITH {SIGNALS_SQL} SELECT mail_id, round(sum(CASE WHEN rule_id IN ({_STRUCT}) THEN 0 WHEN rule_id IN ({_WORD}) THEN points * 0.3 WHEN rule_id = 'signal_stack' THEN 0 ELSE points END), 6) AS trusted,
sum(points) AS raw FROM signals GROUP BY 1""")
def trust_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Points left for an established sender: structure and stack count nothing, wording three tenths."""
    p = F.when(F.col("rule_id").isin(*V.STRUCTURAL_DEMOTE, "signal_stack"), 0.0).when(F.col("rule_id").isin(*V.WORDING_DEMOTE), F.col("points") * 0.3).otherwise(F.col("points"))
    return signals(spark, folder).groupBy("mail_id").agg(F.round(F.sum(p), 6).alias("trusted"), F.sum("points").alias("raw"))


@query("""WITH hits AS (SELECT l_orderkey AS mail_id, CAST(l_quantity AS INTEGER) % 25 AS engines FROM lineitem),
s AS (SELECT mail_id, CASE WHEN engines >= 20 THEN 90 WHEN engines >= 10 THEN 78 WHEN engines >= 5 THEN 60 WHEN engines >= 3 THEN 44 WHEN engines >= 2 THEN 30 WHEN engines >= 1 THEN 18 ELSE 0 END AS score FROM hits)
SELECT mail_id, count(*) FILTER (WHERE score > 0) AS hits, count(*) FILTER (WHERE score = 0) AS clean,
CAST(round(CASE WHEN max(score) > 0 THEN greatest(max(score), 60) * 0.55 ELSE 0 END, 6) AS DOUBLE) AS intel FROM s GROUP BY 1""")
def intel_max_floor(spark: SparkSession, folder: str) -> DataFrame:
    """Reputation tiers, then the largest hit with its floor and weight."""
    engines = F.col("l_quantity").cast("int") % 25
    s = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("mail_id"), X.tiers(engines, V.REPUTATION_TIERS).alias("score"))
    top = F.max("score")
    return s.groupBy("mail_id").agg(F.count_if(F.col("score") > 0).alias("hits"), F.count_if(F.col("score") == 0).alias("clean"), F.round(F.when(top > 0, F.greatest(top, F.lit(V.INTEL_FLOOR)) * V.INTEL_WEIGHT).otherwise(0), 6).alias("intel"))


@query("""SELECT l_suppkey AS ioc, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS bad,
CAST(least(100, floor(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) / sum(CAST(l_quantity AS BIGINT)) * 100 * 2)) AS INTEGER) AS score FROM lineitem GROUP BY 1""")
def hash_ratio_score(spark: SparkSession, folder: str) -> DataFrame:
    """M02 for hashes: twice the share of engines that report, at most 100."""
    q = F.col("l_quantity").cast("long")
    x = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("ioc")).agg(F.sum(q).alias("total"), F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(0)).alias("bad"))
    return x.withColumn("score", F.least(F.lit(100), F.floor(F.col("bad") / F.col("total") * 100 * 2)).cast("int"))


@query("""SELECT c_custkey AS mail_id, spf, dkim, dmarc, CAST(round(CASE spf WHEN 'fail' THEN 4.0 WHEN 'softfail' THEN 4 * 0.6 WHEN 'none' THEN 4 * 0.3 ELSE 0 END
+ CASE dkim WHEN 'fail' THEN 4.0 WHEN 'none' THEN 4 * 0.3 ELSE 0 END + CASE dmarc WHEN 'fail' THEN 4.0 WHEN 'none' THEN 4 * 0.3 ELSE 0 END, 6) AS DOUBLE) AS points, dmarc = 'pass' AND spf <> 'pass' AND dkim <> 'pass' AS contradiction
FROM (SELECT c_custkey, ['pass', 'fail', 'softfail', 'none'][c_custkey % 4 + 1] AS spf, ['pass', 'fail', 'none'][c_custkey % 3 + 1] AS dkim, ['pass', 'none', 'fail', 'none', 'none'][c_nationkey % 5 + 1] AS dmarc FROM customer)""")
def auth_parse_score(spark: SparkSession, folder: str) -> DataFrame:
    """Results parsed out of a header line, their points, and a pass that no mechanism bears out."""
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    c = table(spark, folder, "customer")
    header = F.concat(
        F.lit("mx.example; spf="), pick(["pass", "fail", "softfail", "none"], F.col("c_custkey") % 4), F.lit(" smtp.mailfrom=x; DKIM = "), pick(["pass", "fail", "none"], F.col("c_custkey") % 3),
        F.lit("; dmarc="), pick(["pass", "none", "fail", "none", "none"], F.col("c_nationkey") % 5),
    )
    x = c.select(F.col("c_custkey").alias("mail_id"), *[X.mechanism(header, n).alias(n) for n in ("spf", "dkim", "dmarc")])
    spf, dkim, dmarc = map(F.col, ("spf", "dkim", "dmarc"))
    return x.select("*", F.round(X.auth_points(spf, dkim, dmarc), 6).alias("points"), ((dmarc == "pass") & (spf != "pass") & (dkim != "pass")).alias("contradiction"))
