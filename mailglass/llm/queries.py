"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass.llm import fill_in_middle, html_extraction, jaccard_join, language_id, lm_scoring, mixing, neighbours, oracles, packing, quality_classifier, quality_rules, resampling, scaled_sketch, secrets
from mailglass.llm.common import crc_rest

#: Of the public tokenizer files, by default from the installed package of that name.
PIECES, WORD_BPE = "piece_bpe_32k.model", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder).select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality_classifier.quality_scores(docs, labels.select("doc_id", F.col("quality").alias("y")), crc_rest(F.col("doc_id"), 4) != 2)
    return scored.select("doc_id", (crc_rest(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_bloom_language_model(spark: SparkSession, folder: str) -> DataFrame:
    rest = crc_rest(F.col("doc_id"), 7)
    return lm_scoring.lm_scores(documents(spark, folder).select("doc_id", "text"), rest != 2).withColumn("held_out", rest == 2)


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    # Shards come from hashes that SQL does not have, so the query, which SQL checks, leaves them out.
    return mixing.mix_counts(documents(spark, folder)).drop("shards")


def op5_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), vocabulary(WORD_BPE))


def op6_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")).drop("html")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(documents(spark, folder).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    show = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in secrets.BASE_RULES)))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(show(base), 256).alias("base_sha256"), show("spans").alias("spans"))


def op8_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    rest = crc_rest(F.col("doc_id"), 4)
    found = language_id.identify_held_out(documents(spark, folder).select("doc_id", "text", "lang"), rest != 2)
    return found.select("doc_id", (rest == 2).alias("held_out"), "lang_pred", "score")


def op9_tokeniser_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, folder).select("doc_id", "text"), vocabulary(PIECES)).drop("text")


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, folder))


def op11_piece_table(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.digests(documents(spark, folder).select("doc_id", "text"))


def op12_scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return scaled_sketch.edit_report(documents(spark, folder))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resampling.resample(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
