"""One query for each operator of this subpackage, over its whole table, with its SQL where SQL
can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import sql
from tessera.llm.bpe_codec import bpe_digests
from tessera.llm.common import table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.embedding_dedup import embedding_dedup
from tessera.llm.hmm_lm import hmm_scores
from tessera.llm.html_text import extract_text
from tessera.llm.line_dedup import line_dedup
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.token_counts import token_counts
from tessera.llm.toxicity import toxicity
from tessera.llm.url_filter import rules_table, url_filter

#: The rules of op3 as (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op6_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_toxicity, op3_url_filter, op4_ngram_join, op5_embedding_dedup,
        op6_hmm_lm, op7_bpe_codec, op8_html_text, op9_decontaminate, op10_line_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": sql.URL_FILTER,
    "op4_ngram_join": sql.NGRAM_JOIN,
    "op5_embedding_dedup": sql.EMBEDDING_DEDUP,
    "op9_decontaminate": sql.DECONTAMINATE,
    "op10_line_dedup": sql.LINE_DEDUP,
}
