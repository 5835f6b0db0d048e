"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import formatted, logged, readback
from .common import table
from .decontamination import contaminations
from .fingerprints import fingerprints
from .langid import identified
from .licenses import find_licenses
from .mixing import by_position, mixture
from .neardup import near_duplicates
from .oracle import ORACLES
from .packing import packed_documents
from .pii import find_pii
from .resampling import resampled
from .secret_scan import find_secrets
from .vectors import top_k
from .whitening import whitened

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.round(F.try_element_at("positions", F.lit(k)), 9)
    return by_position(mixture(table(spark, sf_dir, "documents"))).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", at(1).alias("first_position"), at(-1).alias("last_position"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("places")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return readback(formatted(logged(rows)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("lang_spans", lambda s: F.concat_ws(":", s.lang, s.start.cast("string"), s.end.cast("string"))), ",")
    return identified(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", spans.alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_exact_top_k, op3_source_mixing, op4_best_fit_packing, op5_secret_scan, op6_license_scan, op7_chat_formatting, op8_language_id, op9_pii, op10_document_fingerprints, op11_benchmark_decontamination, op12_embedding_whitening, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
