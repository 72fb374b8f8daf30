"""A corpus pipeline of five training-data operators.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All stages but the last return the columns of ``documents``; ``n_chars`` follows the
text. Stages that read
texts in Python get them in small batches, a setting of the session. Every row is judged by its own text, also where rows share an id; rows without an id pass all stages that keep their text. A null or blank
text has no language and goes in the first stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import bpe, decontaminate, jaccard, langid, lines
from rivulet.llm.common import in_small_batches, read, saved


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without one or with a narrow margin go."""
    in_small_batches(spark)
    found = langid.identify(docs, langid.fit(docs))
    return found.where("accepted").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go; a document left without lines stays, with an empty text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, that of the smallest id."""
    in_small_batches(spark)
    return jaccard.keep_one(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    in_small_batches(spark)
    return decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark")).where("size(leaks) = 0").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding gives the text back."""
    in_small_batches(spark)
    ids = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    back = F.col("decoded") == F.coalesce("text", F.lit(""))
    return ids.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), back.alias("round_trip"))


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: Language ID, BM25 retrieval and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``. Stages meet in the cluster's shared folder."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs) if k + 1 < len(STAGES) else docs
    return docs
