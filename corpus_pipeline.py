"""A training-data pipeline over ``documents``: quality, near duplicates, personal data, packing.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.llm import pack, pii, quality, simhash
from docwarden.llm.common import free_name, table, written

#: Null: no stage is expressible in SQL as a whole (a fitted model, text fingerprints, tokens).
ORACLE_SQL = None

CAPACITY, END_ID = 2048, 0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject, unchanged. It is fitted on rows of ``labels``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    mark = free_name(docs, "score")
    return quality.score(docs, model, to=mark).where(quality.predicted(mark) == 1).drop(mark)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (3-word shingles, at most 3 bits apart, step by step) the document of smallest id."""
    return simhash.keep_one(docs, shingle=3, most=3)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data gives way to labels, disclosing terms to their class or to nothing."""
    spans = free_name(docs, "spans")
    text = free_name(docs, "clean")
    found = pii.find_personal_data(docs, to=spans).withColumn(text, pii.sanitised("text", spans))
    length = F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col(text), "n_chars": length}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence: ``doc_id``, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id``, ``offset``."""
    packed = pack.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("personal_data", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
