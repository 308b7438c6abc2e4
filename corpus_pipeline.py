"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before kept. All but the last
return the columns of documents, extra ones included; the last returns doc_id, n_ids, ids, round_trip.

Null, empty and blank texts fail the quality rules and go there. Null languages and sources are groups of their
own. A null doc_id is matched with nothing by the two dedup stages and is kept by them. Rows with one doc_id go or
stay together. Ties go to the least doc_id. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import line_dedup, mixing, near_dedup, quality, sentencepiece_stream
from quillspark.llm.common import cut
from quillspark.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_later_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, share=0.8)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_stream.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", sentencepiece_stage),
]

#: Sketches, MinHash, raking and piece search are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
