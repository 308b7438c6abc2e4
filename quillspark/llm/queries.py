"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, line_dedup, lm_score, mixing, near_dedup, order_minhash, quality, sentencepiece_stream, token_store, warc
from .common import table


def tokenizer(name: str) -> str:
    """Where a file of the public tokenizers lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def subwords(name: str) -> tuple[str, str]:
    """A tiktoken file of the public tokenizers and its pattern."""
    import public_tokenizers

    return tokenizer(name), public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), subwords("byte_bpe_50k.tiktoken"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], c.schema)
    f = chat.format_conversations(c.union(extra))
    replies = chat.trained_text(chat.examples(f)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("r"))
    loss = replies.select(F.col("conv_id").alias("c"), F.array_join("r.text", "").alias("loss"))
    said = f.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("t")).join(loss, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss_text = F.coalesce("loss", F.lit(""))
    return said.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return token_store.read_digests(spark, store)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, folder, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.probabilities(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_stream.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.with_neighbours(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_lm_scoring, op3_chat_formatting, op4_token_store, op5_warc, op6_mixing, op7_sentencepiece, op8_order_minhash, op9_near_dedup, op10_quality_rules, pipeline)}
