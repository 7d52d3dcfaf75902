"""A training corpus from raw documents: filter, dedupe twice, mix, encode. Each stage is written as Parquet and read again.

Every stage but the last takes and returns the columns of ``documents``. An empty table passes through as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import bpe, jaccard, mixing, pu, suffix
from leadspark.llm.common import table
from leadspark.llm.queries import TOKENIZER, held_out
from leadspark.operators.staging import staging_folder

# What the near-copy stage compares: words per shingle, and the least Jaccard similarity in per cent.
NEAR_WORDS = 5
NEAR_PERCENT = 80
# Words of a passage that goes if it stands anywhere else too.
PASSAGE_WORDS = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds for good; it learns from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    return pu.accepted(docs, labels)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least id: four fifths of all their runs of five words are shared."""
    return jaccard.one_of_each(docs, length=NEAR_WORDS, near=NEAR_PERCENT)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that occur elsewhere too, whatever white space lies between the words."""
    cut = suffix.dedup(docs, unit=suffix.Unit(PASSAGE_WORDS, words=True))
    text = F.col("kept").cast("string")
    return cut.withColumns({"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by training position.

    A pass that the mix takes less than half of is left out, any other stands with its whole text. Rows are put
    into as many ranges of positions as there are shuffle partitions, and sorted inside.
    """
    return mixing.in_order(docs, mixing.mix(docs.select("doc_id", "source", "text")).drop("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and checksums of the ids of every text and of what they decode to."""
    return bpe.digests(bpe.encode(docs, TOKENIZER))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeated_strings),
          ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]

# A trained model and a hash order decide: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``."""
    folder = f"{staging_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
