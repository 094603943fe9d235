"""One query for each training-data operator, over its whole table.

The queries derive the columns of their contracts from what the operators
return; texts, spans and files stay with the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from newsflow.llm.chat import ChatTemplate, format_conversations, loss_text, read_back
from newsflow.llm.filter_audit import filter_audit
from newsflow.llm.fim import fim_digests
from newsflow.llm.fingerprints import edited_fingerprints
from newsflow.llm.jaccard import jaccard_components
from newsflow.llm.licenses import license_scan
from newsflow.llm.mixing import mix_sources
from newsflow.llm.ngram_model import score_held_out
from newsflow.llm.oracle import ORACLE  # noqa: F401
from newsflow.llm.packing import pack
from newsflow.llm.quality import quality_rules
from newsflow.llm.suffix_dedup import suffix_dedup
from newsflow.llm.toxicity import toxicity
from newsflow.llm.url_filter import url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like marks, formatted, read
    back and digested."""
    template = ChatTemplate()
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    done = format_conversations(turns.unionByName(more), template)
    back = F.transform(read_back(F.col("formatted"), template),
                       lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    digests = done.select(
        "conv_id", back.alias("turns"), loss_text(F.col("segments")).alias("loss"), "formatted", "valid")
    return digests.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid")


def op2_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a trigram model, with all n-grams, of those not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_held_out(docs, least=1).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 100-byte strings that start earlier."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, length=100).drop("text")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets overlap by 85 %."""
    found = jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.withColumnsRenamed({"doc": "doc_id", "component": "component_id"})


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences in length buckets and batches."""
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    judged = url_filter(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, probability and draw of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix_sources(docs, drop=("text",))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs, drop=("text",)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 6).alias("host_rate"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness."""
    return edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle outputs of all documents, digested and restored."""
    found = fim_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("doc", "doc_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders, by language."""
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, by a model of the labels that aren't held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, _table(spark, sf_dir, "labels"), drop=("text",))
    return found.select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_ngram_score": op2_ngram_score,
    "op3_license_scan": op3_license_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_order_minhash": op10_order_minhash,
    "op11_fim": op11_fim,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity": op13_toxicity,
    "pipeline": corpus_pipeline.run,
}
