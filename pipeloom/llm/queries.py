"""Queries of the text operators over the given tables; each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.llm import chat_tree, lexical_search, line_dedup
from pipeloom.llm.decontaminate import find_contamination
from pipeloom.llm.embedding_dedup import near_vectors
from pipeloom.llm.near_duplicates import near_duplicates
from pipeloom.llm.packing import pack
from pipeloom.llm.pii import KINDS as PII_KINDS
from pipeloom.llm.pii import find_pii
from pipeloom.llm.quality import score_quality, train_quality
from pipeloom.llm.secrets_scan import find_secrets
from pipeloom.llm.spans import listed, number
from pipeloom.llm.substring_dedup import strip_repeats
from pipeloom.llm.token_counts import token_report
from pipeloom.llm.whitening import whiten
from pipeloom.shared import load


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = strip_repeats(load(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = train_quality(docs, labels.filter(~held_out), metadata=("n_chars",))
    scored = score_quality(docs.select("doc_id", "text", "n_chars"), model, metadata=("n_chars",))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=4096, end=2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(load(spark, sf_dir, "documents"), min_lines=3, min_chars=60).select("doc_id", "n_lines", "n_removed", "text")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    base, spans = ["assign", "access", "hex"], F.col("spans")
    return found.select("doc_id", *(number(spans, k).alias(f"n_{k}") for k in base), F.sha2(listed(spans, base), 256).alias("base_sha256"), listed(spans).alias("spans"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = find_pii(load(spark, sf_dir, "documents")), F.col("spans")
    return found.select("doc_id", *(number(spans, k).alias(f"n_{k}") for k in PII_KINDS), F.sha2(listed(spans, PII_KINDS), 256).alias("base_sha256"), listed(spans).alias("spans"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), words=3, percent=85)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(load(spark, sf_dir, "documents")), load(spark, sf_dir, "benchmark"), top=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"), components=4, scale=256)


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats, text = load(spark, sf_dir, "conversations"), "\\### Assistant: </turn> ok"
    kinds = {f.name: f.dataType for f in chats.schema.fields}
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    own = own.select(*(F.col(c).cast(kinds[c]).alias(c) for c in own.columns))
    return chat_tree.digests(chat_tree.chat_tree(chats.select(*own.columns).unionByName(own)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_substring_dedup": op1_substring_dedup, "op2_quality": op2_quality, "op3_decontamination": op3_decontamination, "op4_token_counts": op4_token_counts, "op5_packing": op5_packing, "op6_line_dedup": op6_line_dedup, "op7_secrets": op7_secrets, "op8_embedding_dedup": op8_embedding_dedup, "op9_minhash": op9_minhash, "op10_pii": op10_pii, "op11_lexical_search": op11_lexical_search, "op12_whitening": op12_whitening, "op13_chat_formatting": op13_chat_formatting, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": line_dedup.ORACLE_SQL, "op11_lexical_search": lexical_search.ORACLE_SQL, "op13_chat_formatting": chat_tree.ORACLE_SQL}
