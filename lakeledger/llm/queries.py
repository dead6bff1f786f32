"""One query for each operator, over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, collocations, decontaminate, line_dedup, mixing, near_dedup, packing, quality_model, quality_rules, secrets, substring_dedup, toxicity, warc
from .common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(read(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group_near_duplicates(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure_quality(read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(read(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_order")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(read(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_near_dedup, op3_packing, op4_secrets, op5_decontamination, op6_toxicity, op7_quality_model, op8_quality_rules, op9_warc, op10_substring_dedup, op11_collocations, op12_centroids, op13_mixing)}

ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op2_near_dedup": near_dedup.ORACLE, "op4_secrets": secrets.ORACLE, "op8_quality_rules": quality_rules.ORACLE, "op9_warc": warc.ORACLE, "op10_substring_dedup": substring_dedup.ORACLE, "op11_collocations": collocations.ORACLE, "op12_centroids": centroids.ORACLE, "op13_mixing": mixing.ORACLE}
