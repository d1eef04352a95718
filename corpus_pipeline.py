"""A training-corpus pipeline in five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of ``docs``; columns beyond those of ``documents`` go through unchanged, whatever their
names.  Stages that drop rows do so in the scan and do not shuffle the texts they keep.

Null ids: such rows are judged like others, row by row, and of copies one with an id
stays before one without.  Repeated ids: rows are told apart by their texts; of rows
equal in id and text one stays.  Null, empty and blank texts pass all stages (they have
no sentences, no words, no windows and no identifiers; null stays null) and end with no
ids.  Texts of any length are judged whole.  Ties between copies go to the smallest id,
then to a hash of the text.  Empty tables give empty tables; without usable labels no
row is toxic, without benchmark items none is a leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, bounded_batches, table
from strandline.llm.decontamination import decontaminate
from strandline.llm.jaccard import keep_one
from strandline.llm.pieces import encode_documents
from strandline.llm.pii import redact
from strandline.llm.toxicity import keep_clean

MODEL = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, similarity 0.8) the document with the smallest id stays."""
    bounded_batches(spark)
    return keep_one(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text."""
    bounded_batches(spark)
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, checked against the library, decoded text and all."""
    bounded_batches(spark)
    return encode_documents(docs, MODEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("pieces", encode),
]

#: Sentence models and shingle classes have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has left is deleted when the next one is through with it."""
    docs, before = table(spark, sf_dir, "documents"), None
    try:
        for _, stage in STAGES:
            now = Scratch(spark)
            docs = now.stored(stage(spark, docs, sf_dir))
            if before:
                before.drop()
            before = now
    except BaseException:
        if before:
            before.drop()
        raise
    return docs
