"""Preparation of a training corpus: the stages, each on all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from favora.functions.tables import shared_dir, temporary_tables
from favora.llm import decontaminate, minhash_dedup, pii, quality, sentencepiece_unigram
from favora.llm.shared import read

#: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread.
STAGES = [
    ("quality_classifier", quality.stage),
    ("minhash_dedup", minhash_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("pii", pii.stage),
    ("sentencepiece", sentencepiece_unigram.stage),
]

#: The stages learn models and search by hashing, which SQL can't express; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet to the shared folder and read again.

    What a stage stores on its way is deleted when its result is written.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with temporary_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
