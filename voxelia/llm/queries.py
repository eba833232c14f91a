"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelia.llm import byte_bpe, conversations, decontaminate, html_blocks, licences, line_dedup, lm, parity_join, prefix_trie, quality, repair, secrets, warc
from voxelia.llm.common import shared_dir, table, written


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.join(table(spark, sf_dir, "documents"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    repair.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return repair.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digests(byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs.where(lm.in_training()), order=3, least=1))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_blocks.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.digests(conversations.repair(rows, lost="lost"))


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.payloads(warc.read(spark, path, payload=False)).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(prefix_trie.paths(table(spark, sf_dir, "conversations")), "own-paths")
    return prefix_trie.trie(prefix_trie.rebuilt(own)).drop("id", "parent_id")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_parity_join, op4_licence_scan, op5_decontamination, op6_token_files, op7_secret_scan, op8_byte_bpe, op9_lm_scores, op10_html_text, op11_conversation_repair, op12_warc_archives, op13_prefix_trie)}
SQL: dict[str, str] = {}
