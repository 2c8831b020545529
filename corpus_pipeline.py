"""A training-corpus pipeline of five stages over the documents table.

Each stage works on everything its predecessor kept. A stage's result is written as Parquet and read
again before the next one, so a lost executor costs a stage's tasks and never the whole run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import langid, mixing, neardup, pieces, quality
from lociflow.llm.common import drop_since, drop_stored, marker, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio stay. Null, empty and short texts go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts among them), or in no language that could be learned, go."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays; those without words all do."""
    return neardup.keep_one(docs, 0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources' words meet their targets. A null source is one
    source; rows without words come once."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document, with the proof that they decode to its text. Null and empty
    texts have none."""
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), proof=True)
    return coded.select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "lossless")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Fitted filters, MinHash and sampling have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage left in the shared folder goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = marker(spark)
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_since(spark, mark, docs)
        if name != STAGES[0][0]:
            drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)
