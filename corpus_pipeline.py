"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of documents.

Defined cases: a null or empty text is scored as empty and, having no words, is
rejected by the rules at the latest; rows with a null id are judged by the two
filters like others, take no part in near copies and passages, and are packed with
a null id; rows that repeat an id stay or go together where an id decides (near
copies), else each on its own; without labelled rows the classifier scores 0.5 and
keeps all; an empty table gives empty results; columns besides doc_id and text are
carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import gam, packing, rules, similar, substrings
from frameloom.llm.registry import crc_rest, table, tokenizer_path
from frameloom.llm.shared import written
from frameloom.plans.session import ship

#: Words that a passage must share with an earlier document to be cut out.
PASSAGE_WORDS = 50

#: Near copies share this share of their shingles of so many words.
SHINGLE_WORDS, SIMILAR = 5, 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the additive model scores under its threshold."""
    model = gam.fit(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_rest("doc_id", 5) != 0)
    return gam.accepted(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a rule rejects."""
    return rules.kept_only(docs)  # native: nothing to ship


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies (five-word shingles, Jaccard 0.8 or more)."""
    ship(spark)
    return similar.first_of_each(docs, shingle=SHINGLE_WORDS, least=SIMILAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller id has."""
    ship(spark)
    out = substrings.without_repeats(docs, window=PASSAGE_WORDS)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    ship(spark)
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, near-duplicate components, passages and packing are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
