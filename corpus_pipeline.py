"""A training corpus from ``documents``: language ID, near-dedup, substring dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import automaton, decontaminate, language, near_dedup, packing
from llm.shared import stored, table, tokenizer

#: Least posterior of a document's language.
SURE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or of no clear language, go."""
    path = tokenizer("piece_bpe_32k.model")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))), path)
    found = language.identify(docs, model, path)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return near_dedup.keep_one(docs)


def trimmed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus; n_chars follows the text."""
    done = automaton.remove_repeats(docs, tidy=False)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", distinct),
    ("substring_dedup", trimmed),
    ("benchmark_decontamination", clean),
    ("best_fit_packing", packed),
]

#: The stages need hashes, a language model and a tokenizer that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written as Parquet and read again as the next input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
