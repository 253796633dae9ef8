"""Registered queries of the operators, each over its whole table, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import archive, language_id, line_quality, mixing, near_texts, near_vectors, packing, passages, periodic, pseudonyms, repeats, secret_scan, spelling
from .common import pick

#: The key of the registered query, which anyone may know; a deployment passes its own secret.
PSEUDONYM_KEY = "op6 key of the registered query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return secret_scan.find_secrets(docs).select("doc_id", *(f.name for f in secret_scan.FIELDS))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language_id.held_out(pick(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang"))
    model = language_id.train(docs.filter("not held_out and doc_id is not null"))
    return language_id.identify(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return line_quality.clean_lines(docs).drop("text", "clean_text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, _table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(spark, _table(spark, sf_dir, "documents"), with_text=False)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = archive.write_archives(spark, _table(spark, sf_dir, "pages"))
    return archive.read_archives(files)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts.join_near(spark, _table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.links(spark, _table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return periodic.digests(periodic.find_runs(periodic.plant_periods(docs)))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(spark, _table(spark, sf_dir, "documents"), with_text=False).drop("spans")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(_table(spark, sf_dir, "documents"), slip=spelling.SLIP)
    return spelling.group_variants(spark, words)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": line_quality.oracle(),
    "op7_warc": archive.ORACLE,
    "op12_substring_dedup": passages.ORACLE,
}
