"""From documents to token ids: language, quality, near copies, mixture, encoding; each stage is written and read again.

Nulls: a null text has no letters and goes in the first stage; a null language, source or id doesn't matter there. A null source is a
source of its own in the mixture. Empty texts go like null ones; very long ones are read whole in every stage. Ties: of a group of
near copies the smallest id stays, documents of equal badness stay or go together. Rows with a null id, and repeated rows of an
id that stays, all stay; a row goes as a near copy if its id does. An empty table passes every stage and gives no row.
Further columns of documents are passed on by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusjobs.llm import language_id, mixing, ngram_jaccard, quality, sentencepiece_bpe
from corpusjobs.llm.common import scratch, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or with an unsure language go."""
    return language_id.keep_identified(docs)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with cutoffs from the labels."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document of the mixture."""
    encoded = sentencepiece_bpe.encode_texts(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_bpe.digests(encoded)


STAGES = [("language ID", identify), ("quality rules", judge), ("n-gram Jaccard join", single), ("mixing sources", mix), ("SentencePiece encoding", encode)]
#: SQL has neither the model of the first stage nor the encoder of the last one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
