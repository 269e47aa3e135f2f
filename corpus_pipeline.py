"""A corpus pipeline of five stages; each is written as Parquet and read again for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm.common import staged, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; it learns from the labels of training rows."""
    from hazegrid.llm.toxicity import drop_toxic, fit

    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated windows of three lines; those that lose all lines but blank ones go."""
    from hazegrid.llm.line_dedup import dedup_lines

    # Blank lines always stay, so a text that has lost all others is not empty.
    left = F.col("text").rlike("[^ \\n]")
    return dedup_lines(docs).where((F.col("n_removed") == 0) | left).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 and more."""
    from hazegrid.llm.jaccard_join import keep_one

    return keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    from hazegrid.llm.decontaminate import remove_leaks

    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, the ids with the end id, and the text that they decode to."""
    from hazegrid.llm.sentencepiece_codec import encode_decode

    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_decode(docs.select("doc_id", "source", "lang", "text"), model).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: A fitted model and a tokenizer are no SQL; tests/llm compares the rows with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the last returns."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
