"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

Each source's share of the mix in words becomes a whole number of blocks of its permuted documents (the last one cut at a
document). A tree splits these block quotas among the output shards: a node hands its left half of the slots a draw
without replacement from its quotas (a multivariate hypergeometric draw, source after source) and the right half the rest,
so that each shard's quotas are those of a random permutation of all blocks and sum up exactly. A shard then draws the next
blocks of each source's permutation, which no other shard draws, and is shuffled by itself.

Documents fall into blocks by a hash of their id, so no step ever gathers a source: at most MAX_BLOCKS rows a source are
ranked. Everything is decided by hashes; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailglass.llm.common import SPACE, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 1 << 16
MAX_BLOCKS = 1 << 16
SHARD_WORDS = 1 << 24
#: Rows of sources, or of blocks, up to which their table is broadcast; beyond, Spark joins by shuffling.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def unit_hash(salt: str, *cols: Column) -> Column:
    """A number of 60 bits from md5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, src (its number), source_size, weight, target, blocks.

    Targets share `share` times all words by weight; none passes `most` times its source. Filling to a common level l gives
    min(cap, weight * l); with the sources by cap / weight, l is the largest level found by taking those before as full.
    A row per source here, one task.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("src", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(most)
    fill = Window.orderBy(cap / F.col("weight"), "src")
    full = F.coalesce(F.sum(cap).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    s = s.withColumn("full", full).withColumn("rest", rest).withColumn("all", F.sum("source_size").over(every))
    s = s.withColumn("level", F.max((F.col("all") * share - F.col("full")) / F.col("rest")).over(every))
    count = F.least(F.greatest(F.col("source_size") / BLOCK_WORDS, F.lit(1)), F.lit(MAX_BLOCKS))
    return s.select("source", "src", "source_size", "weight", F.least(cap, F.col("weight") * F.col("level")).alias("target"), F.pow(F.lit(2), F.ceil(F.log2(count))).cast("long").alias("blocks"))


def in_block(blocks: Column, h: Column) -> Column:
    """A document's block in its source's permutation of blocks; the number of blocks is a power of two."""
    return F.pmod(F.pmod(h, blocks) * 5 + 3, blocks)


def block_draws(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """src, block, nth (of the source's draws), h_cut: what is drawn; h_cut: of a cut block, only documents up to this hash."""
    docs = sized.join(_small(sources), F.col("source").eqNullSafe(F.col("of_source"))).select("src", in_block(F.col("blocks"), F.col("h")).alias("block"), "size", "h")
    by_rank = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = docs.groupBy("src", "block").agg(F.sum("size").alias("words")).filter("words > 0")
    b = b.withColumn("before", F.coalesce(F.sum("words").over(by_rank), F.lit(0)))
    b = b.join(sources.select("src", "source_size", "target"), "src").withColumn("turn", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(MOST)).cast("int") - 1)))
    b = b.withColumn("room", F.col("target") - F.col("before") - F.col("turn") * F.col("source_size")).filter("room > 0")
    b = cut(b.select("src", "block", "words", "room", F.row_number().over(Window.partitionBy("src").orderBy("turn", "block")).alias("nth")))
    # One block a source at most is cut. There documents are taken in order of hash while half of the next still fits.
    last = b.filter("room < words").select("src", "block", "room", "nth")
    by_hash = Window.partitionBy("src", "block").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    fit = docs.join(F.broadcast(last), ["src", "block"]).groupBy("src", "block", "nth", "room", "h").agg(F.sum("size").alias("size"))
    fit = fit.withColumn("upto", F.sum("size").over(by_hash)).filter(F.col("upto") - F.col("size") / 2 <= F.col("room"))
    fit = fit.groupBy("src", "block", "nth").agg(F.max("h").alias("h_max"))
    j = b.join(fit, ["src", "block", "nth"], "left")
    return j.select("src", "block", "nth", F.when(F.col("room") < F.col("words"), F.coalesce("h_max", F.lit(-1))).alias("h_cut"))


def _small(sources: DataFrame) -> DataFrame:
    s = sources.withColumnRenamed("source", "of_source")
    return F.broadcast(s) if s.count() <= BROADCAST_ROWS else s


#: One hypergeometric draw: x of `draws` from `total`, of which `good` count. Inverse distribution function at u, over all
#: x within ten standard deviations of the mean; weights follow from one x to the next by their exact ratio.
_RATIO = "((p.good - k) * (p.draws - k)) / (double(k + 1) * (p.total - p.good - p.draws + k + 1))"
_DRAW = f"""
transform(array(struct(p.*, aggregate(sequence(p.lo, p.hi), struct(double(0) as s, double(1) as w),
    (a, k) -> struct(a.s + a.w as s, a.w * {_RATIO} as w)).s as mass)), p ->
  aggregate(sequence(p.lo, p.hi), struct(double(0) as s, double(1) as w, p.lo as x),
    (a, k) -> struct(a.s + a.w as s, a.w * {_RATIO} as w, if(a.s <= p.u * p.mass, k, a.x) as x)).x)[0]
"""


def split_quotas(nodes: DataFrame, level: int, salt: str) -> DataFrame:
    """node, quotas (by source) -> the two children of each node."""
    n = "cast(s.draws as double) * q / s.total"
    sd = "sqrt(s.draws * (q / double(s.total)) * (1 - q / double(s.total)) * (s.total - s.draws) / greatest(s.total - 1, 1))"
    lo = f"greatest(0, s.draws - (s.total - q), cast(floor({n} - 10 * {sd}) as bigint) - 10)"
    hi = f"least(q, s.draws, cast(ceil({n} + 10 * {sd}) as bigint) + 10)"
    u = f"(pmod(xxhash64('{salt}', {level}, node, size(s.left)), 9007199254740992) + 0.5) / 9007199254740992"
    # struct(p.*) is not allowed in a lambda, so the parameters are named one by one.
    draw = _DRAW.replace("p.*", "p.good as good, p.draws as draws, p.total as total, p.lo as lo, p.hi as hi, p.u as u")
    one = f"transform(array(struct(q as good, s.draws as draws, s.total as total, {lo} as lo, {hi} as hi, {u} as u)), p -> {draw})[0]"
    step = f"""
    transform(array(if(s.total = 0 or q = 0, cast(0 as bigint), if(s.draws = s.total, q, {one}))), x ->
      struct(s.draws - x as draws, s.total - q as total, concat(s.left, array(x)) as left))[0]
    """
    all_of = "aggregate(quotas, cast(0 as bigint), (t, q) -> t + q)"
    left = F.expr(f"aggregate(quotas, struct(cast(floor({all_of} / 2) as bigint) as draws, {all_of} as total, cast(array() as array<bigint>) as left), (s, q) -> {step}).left")
    kids = nodes.withColumn("left", left).withColumn("right", F.expr("transform(quotas, (q, i) -> q - left[i])"))
    kids = kids.select("node", F.posexplode(F.array("left", "right")).alias("side", "quotas"))
    return kids.select((F.col("node") * 2 + F.col("side")).alias("node"), "quotas")


def shard_draws(draws: DataFrame, levels: int, salt: str = "mix") -> DataFrame:
    """src, nth, shard: the splitting tree over 2^levels shards, unrolled to the draws of each source."""
    quota = draws.groupBy("src").count()
    # A number for each source, in one row.
    nodes = quota.agg(F.sort_array(F.collect_list(F.struct("src", "count"))).alias("all")).select(F.lit(0).cast("long").alias("node"), F.expr("transform(all, x -> x.count)").alias("quotas"), F.expr("transform(all, x -> x.src)").alias("srcs"))
    srcs = nodes.select(F.posexplode("srcs").alias("i", "src"))
    nodes = nodes.select("node", "quotas")
    for level in range(levels):
        nodes = split_quotas(nodes, level, salt)
        if level % 4 == 3:
            nodes = cut(nodes.repartition("node") if level > 8 else nodes)
    q = nodes.select(F.col("node").alias("shard"), F.posexplode("quotas").alias("i", "n")).filter("n > 0")
    w = Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("from", F.coalesce(F.sum("n").over(w), F.lit(0)) + 1).join(srcs, "i")
    return q.select("src", "shard", F.explode(F.expr("sequence(cast(`from` as int), cast(`from` + n - 1 as int))")).alias("nth"))


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, salt: str = "mix") -> tuple[DataFrame, DataFrame]:
    """sized: source, size, h, written. Returns the sources, and the blocks: src, block, draws (shard, h_cut)."""
    sources = cut(source_targets(sized, weights, share, most), 1)
    draws = cut(block_draws(sized, sources))
    total = sources.agg(F.sum("target")).first()[0] or 0
    levels = min(16, max(3, int(total // SHARD_WORDS).bit_length()))
    blocks = draws.join(shard_draws(draws, levels, salt), ["src", "nth"]).groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("nth", "shard", "h_cut"))).alias("draws"))
    return sources, cut(blocks)


def decide(rows: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (with source and _mix_h) and source_size, target, _mix_draws: where each row goes, once for each time."""
    info = _small(sources).select("of_source", F.col("src").alias("_mix_src"), "source_size", "target", F.col("blocks").alias("_mix_n"))
    info = F.broadcast(info) if sources.count() <= BROADCAST_ROWS else info
    x = rows.join(info, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("_mix_block", in_block(F.col("_mix_n"), F.col("_mix_h")))
    b = blocks.select(F.col("src").alias("_mix_src"), F.col("block").alias("_mix_block"), "draws")
    x = x.join(F.broadcast(b) if b.count() <= BROADCAST_ROWS else b, ["_mix_src", "_mix_block"], "left")
    taken = F.expr("filter(draws, d -> d.h_cut is null or _mix_h <= d.h_cut)")
    return x.withColumn("_mix_draws", F.coalesce(taken, F.expr("slice(array(named_struct('nth', 0, 'shard', 0L, 'h_cut', 0L)), 1, 0)"))).drop("_mix_src", "_mix_block", "_mix_n", "draws")


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, salt: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, shards: a row per document, with the words the mix takes of it, repeats
    counted, and the output shard of each time that it is taken.

    docs: doc_id, text, source; other columns are not read. Null and empty texts have size 0. A null source is one, the
    last. Rows with one id are drawn together. An empty table gives an empty result.
    """
    sized = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), unit_hash(salt, F.col("doc_id")).alias("h")))
    sources, blocks = plan_mix(sized, weights, share, most, salt)
    x = decide(sized.withColumnRenamed("h", "_mix_h"), sources, blocks)
    return x.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("_mix_draws")).alias("taken"), F.transform("_mix_draws", lambda d: d["shard"]).alias("shards"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, salt: str = "mix") -> DataFrame:
    """The mixed rows, all columns of docs, each as often as it is drawn; shard after shard, shuffled inside.

    docs: doc_id, text, source and any other columns, as for mix_counts. The text is shuffled once, to its shard.
    """
    h = unit_hash(salt, F.col("doc_id"))
    sized = cut(docs.select("source", words(F.col("text")).alias("size"), h.alias("h")))
    sources, blocks = plan_mix(sized, weights, share, most, salt)
    own = ["source_size", "target"]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row"), F.col("source"), h.alias("_mix_h"))
    x = decide(kept, sources, blocks).drop(*own).withColumn("_mix_draw", F.explode("_mix_draws"))
    x = x.withColumn("_mix_order", F.xxhash64(F.lit(salt), "_mix_h", "_mix_draw.nth"))
    return x.repartition("_mix_draw.shard").sortWithinPartitions("_mix_draw.shard", "_mix_order").select("_mix_row.*")
