"""Registered queries of the operators, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from llm import alignment, automaton, chat, decontaminate, lexical_search, run_index, url_filter
from llm.block_labeller import extract
from llm.language import predict
from llm.order_minhash import fingerprint_edits
from llm.packing import pack
from llm.shared import table, tokenizer
from llm.simhash import near_duplicates
from llm.token_counts import token_counts


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digests(chat.read_chats(chat.format_chats(turns)))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.digests(run_index.remove_repeats(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.digests(automaton.remove_repeats(table(spark, sf_dir, "documents")))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.alignments(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_chat_formatting": op1_chat_formatting,
    "op2_html_extraction": op2_html_extraction,
    "op3_language_id": op3_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_order_minhash": op8_order_minhash,
    "op9_token_counts": op9_token_counts,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_url_filters": op13_url_filters,
}
SQL: dict[str, str] = {
    "op1_chat_formatting": chat.DIGEST_SQL,
    "op5_decontamination": decontaminate.SQL,
    "op11_ranked_lexical_search": lexical_search.SQL,
    "op13_url_filters": url_filter.SQL,
}
