"""A training corpus from ``documents`` in five stages, each written as Parquet and read again.

Low quality goes, then exact copies, then near copies; the rest is put in the order of a mix with
target weights and encoded. All stages but the last return the columns of ``documents``; the last
adds the place in the mix, since the order of files is lost when they are read in splits.

A stage's result goes when the next one is written, and so does what a stage wrote on its way: beside
the input there are at most two copies of the corpus. The last stage is lazy and reads the mixed one,
which ``strataq.storage.sweep`` deletes when the result has been used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import exact_dedup, mixing, ngram_join, pieces, quality_classifier
from strataq.storage import discard, kept, materialize, read_table, scratch


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; labels come from the table ``labels``."""
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def deduplicate_exactly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_distinct(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles with a similarity of 0.8 or more join, the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, ordered so that every prefix of the files holds the sources by their target weights."""
    return mixing.mixed_order(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``documents`` in the order of the mix, with their slot and block_offset, piece ids and what they decode to."""
    docs = mixing.mixed_order(docs, placed=True)
    return pieces.encode_documents(docs, [F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("quality classifier", classify_quality),
    ("exact dedup", deduplicate_exactly),
    ("n-gram Jaccard join", join_ngrams),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: Discriminant scores and piece segmentations have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            done = kept(made, materialize(stage(spark, docs, sf_dir), name.split()[0].lower()))
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
