"""Corpus pipeline: quality filter, near-duplicate removal, redaction, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes and rereads each stage's rows in the shared folder, so that no stage is computed twice, and
deletes what a stage wrote on its way.

Every stage takes null ids, null, empty and very long texts, repeated rows, empty tables and further columns, which stay.
Without both labels every score is 0.5, so all rows pass the filter; a text scored at the cut passes. Rows with a null
id are no duplicates of any; of a group the smallest id stays, of its repetitions one. A null text has no spans and no tokens.
Rows of a null or unlisted source keep the rate 1; repeated rows are repeated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, minhash, mixing, pii, quality
from fathom.llm.common import scope, table
from fathom.llm.langid import remainder

#: Near duplicates: words in a shingle, and the least similarity (as a fraction).
SHINGLE, LEAST = 5, (80, 100)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score reaches the cut; the classifier learns from the labelled ones."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) == 0)
    name = next(n for i in range(len(docs.columns) + 1) if (n := f"quality_{i}") not in docs.columns)
    return quality.scored(docs, model, name).where(F.col(name) >= quality.CUT).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return minhash.deduplicated(docs, SHINGLE, LEAST)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    clean = pii.redacted(docs)
    changed = F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return clean.withColumn("n_chars", changed).select(docs.columns) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources have their target shares, in random order."""
    return mixing.mixed_sources(docs, mixing.WEIGHTS).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of each document."""
    return bpe.tokenised(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("redaction", redaction),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: SQL expresses neither the trained classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
