"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import bpe, chat, exact_dedup, fingerprint, html_extract, mixing, ngram_join, quality, toxicity
from fairlead.llm.common import load
from fairlead.llm.labels import held_out


def vocab_path(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary: a file in FAIRLEAD_TOKENIZERS if that is set, else its name, which each worker looks up in public_tokenizers."""
    folder = os.environ.get("FAIRLEAD_TOKENIZERS")
    return os.path.join(folder, name) if folder else name


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(load(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    done = chat.read_back(chat.format_conversations(rows.withColumn("parts", F.array(chat.text_part(F.col("text"))))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(load(spark, sf_dir, "documents"), vocab_path(), with_ids=False)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(load(spark, sf_dir, "documents"), vocab_path())


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(load(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.train_quality(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_ALL = (op1_fingerprints, op2_chat_formatting, op3_toxicity, op4_bpe, op5_ngram_join, op6_mixing, op7_exact_dedup, op8_token_counts, op9_html, op10_quality)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op2_chat_formatting": chat.ORACLE, "op6_mixing": mixing.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE}
