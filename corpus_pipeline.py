"""From documents to packed sequences: toxic documents go, then those of low quality, then near copies; the rest is packed.

Every stage but the last returns whole rows of its input, all columns as they are. Documents with a null or empty text are
scored as no words, fail the base rules of quality and so end there; null ids stay null, are never near copies and are
packed; repeated rows share their fate; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinframe.llm.common import scratch, table
from twinframe.llm.minhash import drop_near_duplicates
from twinframe.llm.packing import pack
from twinframe.llm.quality import keep_quality
from twinframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; without a toxic label to learn from, all."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits of their language and source."""
    return keep_quality(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets of five-word shingles that are 80 % alike or more."""
    return drop_near_duplicates(docs, k=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Workers still hold memory of the stages before, so they keep fewer words than by default."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), most_words=200_000)


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("MinHash near-dedup", near_copies), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the search and the bands have no SQL.
ORACLE_SQL = None
