"""The opN queries: each applies one operator of this subpackage to its whole table; and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination as _decontamination
from corpusloom.llm import embedding_links as _embeddings
from corpusloom.llm import html_text as _html
from corpusloom.llm import license_scan as _license
from corpusloom.llm import minhash as _minhash
from corpusloom.llm import packing as _packing
from corpusloom.llm import periodic_runs as _runs
from corpusloom.llm import personal_data as _private
from corpusloom.llm import quality as _quality
from corpusloom.llm import substring as _substring
from corpusloom.llm import token_counts as _tokens
from corpusloom.llm import vector_codes as _codes
from corpusloom.llm import warc as _warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _substring.substring_dedup(_table(spark, sf_dir, "documents"))
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x.words)
    return found.select("row.doc_id", F.col("kept_text").alias("text"), words.alias("removed_words"), "removed", "shared", "sources", (F.size("removed") > 0).alias("has_repeats"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _embeddings.embedding_links(_table(spark, sf_dir, "embeddings"))
    return found.select("row.vec_id", "n_links", "component_id", "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.best_fit_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license.license_scan(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _quality.score(docs, _quality.fit(docs, _table(spark, sf_dir, "labels")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash.minhash_classes(_table(spark, sf_dir, "documents")).select("row.doc_id", "class_id", "kept", "class_size")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.html_text(_table(spark, sf_dir, "pages"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _private.report(_private.personal_data(_table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs.report(_runs.periodic_runs(_runs.planted(_table(spark, sf_dir, "documents"), tenth=True)))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_embedding_near_dedup, op3_best_fit_packing, op4_license_scan, op5_warc, op6_token_counts, op7_benchmark_decontamination, op8_quality_classifier, op9_minhash_near_dedup, op10_html_text, op11_pii, op12_vector_codes, op13_periodic_runs)}

ORACLES: dict[str, str] = {"op2_embedding_near_dedup": _embeddings.ORACLE, "op5_warc": _warc.ORACLE, "op7_benchmark_decontamination": _decontamination.ORACLE, "op11_pii": _private.ORACLE, "op12_vector_codes": _codes.ORACLE}
