"""The corpus pipeline: clean, keep one of each group of copies, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``; the last adds ``piece_ids`` and ``n_pieces``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, minhash, mixing, pieces, toxicity
from quarry.llm.common import fresh, read, staged

MODEL = "piece_bpe_32k.model"


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that score as toxic go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without a language, or with no leading one, go."""
    return langid.keep_known(docs, langid.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near copies stays."""
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every document as often as the mix takes it."""
    column = fresh(docs, "mix")
    found = mixing.mix(docs, out=column)
    taken = found.where(F.col(f"{column}.repeats") > 0)
    return taken.withColumn(column, F.explode(F.array_repeat(F.lit(1), F.col(f"{column}.repeats").cast("int")))).drop(column)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the ids of the pieces of each text."""
    return pieces.encode(docs, public_tokenizers.path(MODEL)).withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [("toxicity", clean), ("language", known_language), ("near-dedup", one_of_each), ("mixing", mixed), ("pieces", encoded)]

#: classifiers, signatures and piece encoding are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
