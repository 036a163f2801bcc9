"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of documents. Null texts count as empty in every stage, long texts are read whole,
repeated rows give the same decision each (but for near-duplicates, where one stays), an empty table gives an empty one,
and columns beside doc_id and text are passed on unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, decontam, neardup, quality, secrets
from lexmill.llm.common import materialize, read

#: What a secret's characters become.
MARK = "[SECRET]"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labels."""
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), the first by doc_id and text hash.

    Rows go, not ids: of a doc_id with several texts only those in a group with an earlier text. Repeated rows (same
    doc_id and text) count as copies. A null doc_id stays, and so does a text without words.
    """
    found = materialize(neardup.near_duplicates(docs, words=5, percent=80))
    own = (F.col("doc_id").cast("long") == F.col("in_id")) & (F.xxhash64("text") == F.col("in_key"))
    keys = (F.col("doc_id").alias("in_id"), F.col("tkey").alias("in_key"))
    kept = docs.join(found.where(~F.col("first")).select(*keys).distinct(), own, "left_anti")
    again = found.where(F.col("first") & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy(*keys).count().where("count > 1").drop("count")
    if again.isEmpty():
        return kept
    return kept.join(again, own, "left_anti").unionByName(kept.join(again, own, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.keep(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by MARK, n_chars anew."""
    return secrets.scan(docs, redact=MARK)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_le of each document, and the hash of the text its tokens decode to."""
    return bpe.tokenize(docs).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", neardup_stage),
    ("decontamination", decontam_stage),
    ("secrets", secrets_stage),
    ("tokens", tokens_stage),
]
#: SQL can express neither the learned classifier nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
