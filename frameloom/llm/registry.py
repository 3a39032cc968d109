"""Queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"), "n_links")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the files are read where they lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_rest(column: str, by: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .automaton import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import language_scores

    return language_scores(table(spark, sf_dir, "documents"), crc_rest("doc_id", 7) != 2)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import OWN, cascade

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), names=names)
    out = judged.select("doc_id", *(F.col(OWN + k).alias(k) for k in names), F.col(OWN + "rejected_by").isNull().alias("kept"))
    return out.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import checked

    return checked(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiindex import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import read_tokens, write_tokens

    manifest = write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return read_tokens(manifest).drop("path")


def op10_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gam import THRESHOLD, fit, scores

    docs = table(spark, sf_dir, "documents")
    rest = crc_rest("doc_id", 5)
    model = fit(docs, table(spark, sf_dir, "labels"), rest != 0)
    score = F.col("score")
    return scores(docs, model).select("doc_id", F.coalesce(rest == 0, F.lit(True)).alias("held_out"), "score", (score >= THRESHOLD).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for f in (op1_token_counts, op2_hmm_scores, op3_packing, op4_rules, op5_substrings, op6_simhash, op7_pieces, op8_multi_index, op9_token_files, op10_gam)}


def oracle_sql() -> dict[str, str]:
    from . import rules, substrings

    return {"op4_rules": rules.QUERY_SQL, "op5_substrings": substrings.QUERY_SQL}
