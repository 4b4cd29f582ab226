"""The thin queries over the operators of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, language_model, mixing, quality_knn, quality_rules, sharding, simhash, substring_dedup, token_files, twins
from ._shared import scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


def op2_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_sketch_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    feats = quality_rules.staged_features(docs, "doc_id")
    kept = quality_rules.judge(feats, quality_rules.staged_thresholds(feats))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor, F.lit(-1))


def op4_viterbi_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _remainder("doc_id", 5) == 0)
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model, with_spans=False).select("doc_id", "held_out", "lang_pred", "score")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch(spark, "tokens")
    token_files.write_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), out, end_id=2)
    return token_files.read_tokens(spark, out)


def op7_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _remainder("doc_id", 7) == 2)
    out = language_model.score(docs, docs.where(~F.col("held_out")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "block", "weight", "slot", "seq")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"), width=3, distance=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_latent_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _remainder("doc_id", 5) == 0)
    labels = _read(spark, sf_dir, "labels").where(_remainder("doc_id", 5) != 0)
    out = quality_knn.score(docs, quality_knn.fit(docs.where(~F.col("held_out")), labels))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_decontamination, op2_histogram_sort_shards, op3_sketch_quality_rules, op4_viterbi_language_id, op5_suffix_array_dedup, op6_token_files, op7_bloom_language_model, op8_pfair_mix, op9_simhash_components, op10_latent_neighbour_quality)}

ORACLE: dict[str, str] = {"op1_suffix_array_decontamination": twins.OP1, "op3_sketch_quality_rules": twins.OP3}
