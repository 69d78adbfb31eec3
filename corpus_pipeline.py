"""The corpus pipeline: stages that each call one operator on what their predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe_codec import bpe_digests
from tessera.llm.common import cut, joined, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.line_dedup import line_dedup
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.toxicity import toxicity


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents whose doc_id is not rejected, their columns untouched. The rejected are few;
    they are broadcast behind a check of their size. A null doc_id stays."""
    gone = cut(rejected.select(F.col("doc_id").alias("rejected_doc_id")).where("rejected_doc_id IS NOT NULL").distinct())
    return joined(docs, gone, docs["doc_id"] == gone["rejected_doc_id"], "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar rejects go."""
    return _without(docs, toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go, however short, and with them documents of which nothing is
    left. A text that lost lines gets its new length as n_chars."""
    out = line_dedup(docs).where("NOT line_dedup.emptied")
    n_chars = F.when(F.col("line_dedup.n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id."""
    return _without(docs, ngram_jaccard_join(docs.select("doc_id", "text")).where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go: a window of one item is enough."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1).where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens and digests."""
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]
#: Learned scores and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
