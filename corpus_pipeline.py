"""From raw documents to token ids: language ID, exact dedup, near dedup, mixing, encoding.

Each stage takes all that the one before kept, is written as Parquet and read again. run() does that in the shared
folder of spark.checkpoint.dir and returns the last stage's table.

Cases: a null or empty text has no language and goes in the first stage; so do texts without a letter. Rows that repeat an
id and a text count once from the second stage on; rows with one id and different texts are one node of the third, and stay
or go together. A null id stays where its text does. Ties are settled by the ids, as each stage says. A null source is a
source of its own. Empty tables give empty tables. Columns of any other name come through all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import bpe, common, exact_dedup, jaccard, langid, mixing

#: Nearest centroids and byte merges cannot be written in SQL.
ORACLE_SQL = None


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter, or too far from every language, go."""
    model = langid.fit(docs.where(common.fold_of("doc_id", 4) != 2))
    return langid.keep_known(docs, model)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, the one with the largest id stays."""
    return exact_dedup.keep_one_of_each(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: of each component, the smallest id stays."""
    return jaccard.keep_one_of_each(docs, width=5, num=80, den=100)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's rate says."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_table(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", one_of_equal),
    ("jaccard_join", one_of_similar),
    ("mixing", mixed_sources),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each stage's table goes once the next one is written; the last goes when
    the driver ends."""
    docs = common.documents(spark, sf_dir)
    base = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    common.delete_at_end(spark, base)
    before = None
    for name, stage in STAGES:
        with common.Staging(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before is not None:
            common.delete(spark, f"{base}/{before}")
        docs, before = spark.read.parquet(f"{base}/{name}"), name
    return docs
