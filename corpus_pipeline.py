"""Training corpus pipeline: ``documents`` through five operators, each stage written to Parquet and read again.

Every stage works on all rows that its predecessor kept.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.llm import jaccard_join, langid, packing, pii, quality_mil
from routewise.llm.common import table, write_shared
from routewise.llm.queries import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its log probability per n-gram is at most this much (and the slack
#: of short texts) below what the training texts of its language reach.
MOST_MISFIT = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects (score below its threshold)."""
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return (quality_mil.score(model, docs, COLUMNS).where(F.col("score") >= quality_mil.THRESHOLD).select(*COLUMNS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: those without letters, or as
    unlikely as texts in a language or script that was never learned."""
    model = langid.train(docs)
    return (langid.predict(model, docs, COLUMNS, fit="__fit")
            .where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("__fit") >= -MOST_MISFIT)).select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each group of near-duplicates, and one of its rows without an id.

    Groups and the kept row are found by row, not by id, so near copies go under
    whatever id; rows equal in id and text count as one."""
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    docs = docs.select(*COLUMNS).withColumn("__row", row)
    groups = jaccard_join.join(docs.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id").distinct()
    ids = docs.select("__row", F.col("doc_id").alias("__id")).distinct()
    kept = (groups.join(ids, "__row").groupBy("component_id", F.col("__id").isNull().alias("__none"))
            .agg(F.min(F.struct("__id", "__row")).alias("__first")).select(F.col("__first.__row").alias("__row")))
    return docs.join(kept, "__row", "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by format-preserving pseudonyms."""
    return pii.replace(docs, COLUMNS).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into windows of 1024 tokens."""
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality classifier", quality), ("language id", language), ("near duplicates", near_duplicates), ("pii", private_data), ("packing", pack)]

#: Trained and hashed stages are beyond SQL; the tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
