"""From raw documents to token ids: language ID, quality rules, near-dedup, source mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vouchgraph.llm import bpe, common, langid, minhash, mixing, quality


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; what language identification rejects goes.

    Null, empty and letterless texts are rejected, repeated rows stay or go together, however long the texts. Where
    no row has a language, all stay. An empty table stays empty; further columns pass through.
    """
    return langid.keep_identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose n-grams are as likely in trusted text as the threshold asks.

    A null or empty text has the score 0, a score of just the threshold stays, repeated rows stay or go together;
    with no trusted label all stay. An empty table stays empty; further columns pass through.
    """
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies.

    That of the least id, nulls last; rows that repeat in id and text are one. Null texts copy nothing and stay,
    empty ones are copies of each other. An empty table stays empty; further columns pass through.
    """
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of equally weighted sources takes; a source under its budget stays whole.

    A null source is one of its own, a null id hashes like the word "null"; null and empty texts have no tokens.
    Rows of one id go together, so ties of hashes do. An empty table stays empty; further columns pass through.
    """
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_words, n_tokens, token_ids and decoded of every document left, and all its columns but the text.

    Null and empty texts, ties, repeated rows and an empty table: see ``bpe.encode``. A column of the documents that
    is named like one of these four gives way to it.
    """
    return bpe.decode(bpe.encode(docs, keep=tuple(c for c in docs.columns if c != "text")))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("minhash_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode_tokens),
]

#: Trained models, signatures and BPE merges aren't SQL; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again.

    An empty table runs through to an empty result; nulls, ties and repeated rows are treated as the
    stages' docstrings say. All columns but text reach the result; n_words, n_tokens, token_ids and decoded are
    the last stage's.
    """
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
