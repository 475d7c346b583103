"""The registered queries opN_<name>, their SQL counterparts and the pipeline's query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import (
    decontaminate,
    followups,
    jaccard_join,
    licenses,
    manifest,
    packing,
    pii,
    quality_cnn,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
)
from tracklake.llm.common import crc_fold, table
from tracklake.llm.oracles import SQL as ORACLE_SQL


def word_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The models are fitted on at most so many labelled rows.
TRAINING_ROWS = 4000


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.fit_on(toxicity.training_table(docs, labels, "toxic", 4, 2, TRAINING_ROWS))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_cnn.fit_on(toxicity.training_table(docs, labels, "quality", 3, 1, TRAINING_ROWS), 500)
    scored = quality_cnn.score_documents(docs, model)
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe_path())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return got.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance", "silence")})


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op12_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followups.missing_followups(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.merkle_manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_quality_cnn": op4_quality_cnn,
    "op5_licenses": op5_licenses,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_followups": op12_followups,
    "op13_manifest": op13_manifest,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
