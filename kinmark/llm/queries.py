"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import audio_patches
from .ball_tree import EVERY, top_k, top_k_sql
from .license_scan import license_matches
from .mixing import mix_sources, mixing_sql
from .near_dedup import duplicate_groups
from .packing import pack_documents
from .pii import personal_spans
from .quality import quality_scores
from .secret_scan import secret_spans
from .token_shards import token_shards


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds sound: the UTF-8 bytes of each whole document stand in for an 8 kHz clip of 8-bit samples."""
    return audio_patches(_table(spark, sf_dir, "documents"), audio=F.encode("text", "UTF-8"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(_table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are weighed by the square roots of their tokens, so large ones give way without being levelled."""
    return mix_sources(_table(spark, sf_dir, "documents"), tempered=True)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(_table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    return top_k(_table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % EVERY == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_audio, op2_secret_scan, op3_license_scan, op4_near_dedup, op5_token_shards, op6_packing, op7_quality, op8_mixing, op9_pii, op10_top_k)
}
ORACLE_SQL: dict[str, str] = {"op8_mixing": mixing_sql(), "op10_top_k": top_k_sql()}
