"""From raw documents to packed sequences: five stages, each a text operator whose decisions take effect.

Every stage works on all rows its predecessor kept and writes them to the shared folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import jaccard, language, packing, phrases, pii
from tallyfield.llm.common import small_batches, table
from tallyfield.session import scratch_path


#: Near copies share this percentage of their shingles of so many words. The op4 query has its own values, fixed by its contract.
COPY_SHINGLE, COPY_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are far from every language's centroids, or have no letters, go."""
    small_batches(spark)
    return language.accepted(docs, language.fit(docs))


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells rows apart, and its name: the id, written so that text order is id order, then a hash of the text.

    So a decision holds for its own row also where ids are null or used twice. Null ids come last; rows equal in both share a key.
    """
    name = "row_key"
    while name in docs.columns:
        name += "_"
    number = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    shifted = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    id_text = F.coalesce(shifted if number else F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("~"))
    return docs.withColumn(name, F.concat(id_text, F.lit(":"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-")))), name


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays; one row of it, if the row itself is repeated.

    Documents without words are in no group and stay.
    """
    small_batches(spark)
    marked, key = with_key(docs)
    found = jaccard.near_duplicates(marked.select(F.col(key).alias("doc_id"), "text"), size=COPY_SHINGLE, percent=COPY_PERCENT)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    repeated = found.where("n_shingles > 0 and doc_id = component_id").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("rows")).where("rows > 1").select(key)
    kept = marked.join(gone, key, "left_anti")
    return kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key])).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    folder = scratch_path(spark, "phrase-index")
    marked, key = with_key(docs)
    phrases.build_index(marked.select(F.col(key).alias("doc_id"), "text"), folder)
    found = phrases.contamination(spark, folder, table(spark, sf_dir, "benchmark"))
    return marked.join(found.where("contaminated").select(F.col("doc_id").alias(key)), key, "left_anti").select(docs.columns)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span gives way to its kind in angle brackets; n_chars follows the text."""
    small_batches(spark)
    return pii.masked(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("decontamination", decontamination), ("pii_masking", pii_masking), ("packing", packed)]
#: Models, tokens and packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order; every stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
