"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again for the next, which cuts lineage; a result that nothing reads any more is deleted.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and columns beside those
of documents (kept as they are); what each does with them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinmark.llm.mixing import keep_mixed
from kinmark.llm.near_dedup import drop_near_duplicates
from kinmark.llm.packing import pack_documents
from kinmark.llm.quality import drop_low_quality
from kinmark.llm.secret_scan import mask_secrets
from kinmark.llm.shared import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects, null, empty and blank texts among them; repeated rows share their fate."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the smallest id, null last. Of repeated rows one stays; texts without words all stay."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and brings n_chars up to date; every document stays, null texts as null."""
    return mask_secrets(docs, count_column="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps half of all token blocks, the sources in equal parts as far as they reach; ties fall differently in each shard.

    Null and empty sources are one source; repeated rows stay or go together; one block alone stays.
    """
    return keep_mixed(docs, even=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents by the lengths of their token ids; one row per sequence. Null and empty texts take no room."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
#: A trained classifier and greedy packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
