"""From raw documents to packed training sequences, stage by stage.

Every stage but the last returns the columns of ``documents``.  Null and empty
texts are rejected by the first stage, as they have no letter; rows with a
null id are kept by the stages that reject.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquad.llm import langid, ngram_join, packing, secrets, toxicity
from orthoquad.llm.common import Scratch, drop_ids, drop_repeats, keep_to_end, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words that packing remembers and bytes that it reads at once, few as workers also serve the other stages.
WORDS, RUN_BYTES = 150_000, 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and those of no clear language.

    A text in a language that was not learned is taken for a learned one and
    nearly always stays.
    """
    return langid.keep(docs.select(COLUMNS), langid.fit(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the texts that ``op1_toxicity`` predicts as toxic."""
    return toxicity.keep(docs.select(COLUMNS), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 or more of their 5-word shingles, keep the smallest id.

    Of rows that repeat an id and its text one stays; other texts of the
    smallest id stay, as do rows with a null id.
    """
    found = ngram_join.join(docs, n=5, percent=80)
    kept = drop_ids(docs.select(COLUMNS), "doc_id", found.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    return drop_repeats(kept, "doc_id", "text")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by marks; ``n_chars`` follows."""
    clean = secrets.redact(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("lang", "source"), capacity=WORDS, run_bytes=RUN_BYTES)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("ngram_join", near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: The trained networks and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again; a stage's table goes when the next is written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    keep_to_end(spark, scratch.root)
    for at, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if at:
            scratch.drop(STAGES[at - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
