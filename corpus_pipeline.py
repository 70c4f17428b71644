"""documents to encoded training text: reject toxic ones, drop near copies, mix sources, encode.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined cases of every stage: a null text counts as an empty one; null and repeated doc_ids, ties and repeated
rows are kept apart as rows; very long texts are read whole; an empty table gives an empty result; extra columns
pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm import mixing, sentencepiece_lattice, simhash, toxicity
from reelframe.llm.common import scratch, ship, table, written
from reelframe.llm.queries import PIECE_MODEL


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't call toxic (score below 0.5); all where no label is known. A null
    or empty text gets the bias's score."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id. Near copies are texts whose sets
    of five-word shingles have a similarity of 0.8 or more; a shorter text is one shingle, empty texts are one
    group. SimHash fingerprints link the closest, checked by their shingles; the sets of shingles find the rest. Several rows of that doc_id, or of none, leave the one whose columns have the smallest XXH64."""
    ship(spark)
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; those that it takes 0 times are gone. Empty texts come once;
    equal rows come as often as all of them together."""
    ship(spark)
    return mixing.repeat_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces of every document copy; an empty text has no ids."""
    ship(spark)
    encoded = sentencepiece_lattice.encode(docs, public_tokenizers.path(PIECE_MODEL))
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: A trained classifier and BPE merges have no form in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return written(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}", keep=True)
