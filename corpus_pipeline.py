"""The corpus pipeline: language, quality, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import langid, nearcopies, packing, quality
from lectern.llm.common import shared_folder, small_batches, table

#: A text whose best language scores below this is in none of the learned languages.
LANGUAGE_SCORE = 0.25
TOKENIZER = "word_bpe_49k.json"
#: No SQL: the stages learn classifiers, cluster and solve a linear program.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages that ``docs`` itself is labelled with.

    Rejected: texts without letters and texts that resemble no language. Without any labelled text
    nothing can be learned and only texts without letters go. Repeated rows stay or go alike, other columns are
    carried along and an empty table gives no rows.
    """
    small_batches(spark)
    try:
        model = langid.train(docs)
    except ValueError:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return langid.accepted(docs, model, LANGUAGE_SCORE)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the line classifier, learned from the labels of ``docs``, holds for bad.

    Without labels nothing is dropped. Null and empty texts are judged as one empty line; repeated rows stay or
    go alike, null ids have no label, other columns are carried along and an empty table gives no rows.
    """
    small_batches(spark)
    try:
        model = quality.train(docs, table(spark, sf_dir, "labels"))
    except ValueError:
        return docs
    return quality.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id, once if it is repeated.

    Near copies share 0.8 or more of their five-word shingles. Rows are told apart by id and text. Documents
    without an id come last, so one of them is kept only where its component has no id at all; of several texts
    under one id the least by hash comes first. Other columns are carried along, whatever their names, and an
    empty table gives no rows.
    """
    keep = nearcopies.representatives(docs)
    keyed = docs.select(*nearcopies.row_key(), F.struct("*").alias("row")).join(keep, ["key_a", "key_b"], "left_semi")
    # what is left under a key has one id and text
    once = Window.partitionBy("key_a", "key_b").orderBy(*[F.col("row")[c] for c in docs.columns if c not in ("doc_id", "text")])
    return keyed.withColumn("place", F.row_number().over(once)).where("place = 1").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of 4096 tokens: one row per piece.

    A null text is empty and is packed as its closing token. Repeated rows and rows without an id are packed like
    any others, other columns are not looked at and an empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("quality", quality_filter), ("near_dedup", near_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; stage results are written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
