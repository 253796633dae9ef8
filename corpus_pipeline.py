"""A corpus from documents to training sequences: five stages, each written and read again.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of
documents. A stage works on all that the stage before kept:

1. language ID: documents whose language is rejected go.
2. n-gram Jaccard join: of each group of near copies one row stays, that with the smallest doc_id; documents
   without a doc_id or without a word have no copies and stay. Different texts under one doc_id are
   documents of their own.
3. secret scans: every span found is replaced by a mark.
4. mixing: documents are taken as often as the mix of the sources asks, copies as repeated rows.
5. packing: (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all rows, copies included.

The language model learns from the documents of the stage's input under the held-out rule of the
operator. An empty table passes through all stages and gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm import language_id, mixing, near_texts, packing, secret_scan
from tabwise.llm.common import Saved

#: Not expressible in SQL: learned weights, MinHash, Newton steps and token ids.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = language_id.held_out(docs.select("doc_id", "text", "lang"))
    model = language_id.train(labelled.filter("not held_out and doc_id is not null"))
    return language_id.identify(docs, model).filter("not rejected").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_texts.drop_near(spark, docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    saved = Saved(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
            saved.drop(before)
    return docs
