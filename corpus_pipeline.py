"""Corpus preparation: five stages over ``documents``, each by one operator of ``spindrift.llm``.

A stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns the columns of documents; the
last one returns the encoded corpus.  Stages hand over Parquet tables in the shared folder.

Null and empty texts are judged as empty and stay through all stages.  Rows with null keys are judged like others, but no stage
that drops by key drops them.  Repeated rows go or stay together; rows of one key but other texts are judged apart in the
near-duplicate stage and together in decontamination.  Columns other than those of documents are left
behind.  An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe_codec, decontaminate, ngram_join, substring_dedup, toxicity
from spindrift.llm.common import Scratch
from spindrift.llm.queries import table, toxicity_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; each row is judged by its own text, where it lies."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs.select(*COLUMNS), "text", model).filter("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the smallest id stays.  Rows of one
    key go or stay by their own text."""
    groups = ngram_join.jaccard_components(docs, "doc_id", "text", n=5, percent=80)
    gone = groups.filter("component_id <> doc_id").select("doc_id", "text_id").distinct()
    return docs.select(*COLUMNS).withColumn("text_id", F.xxhash64("text")).join(gone, ["doc_id", "text_id"], "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences that an earlier document has are cut out; every document stays."""
    out = substring_dedup.dedup(docs.select(*COLUMNS), "doc_id", "text")
    n_chars = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    hits = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return docs.select(*COLUMNS).join(hits.select("doc_id").distinct(), "doc_id", "left_anti")


def encode_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with a digest of the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe_codec.round_trip(docs, "doc_id", "text", path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode_corpus),
]

#: The classifier and the components can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
