"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embed, langid, lm, minhash, mixing, pages, quality, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.query,
    "op2_html_extraction": pages.query,
    "op3_embedding_dedup": embed.query,
    "op4_lm_scoring": lm.query,
    "op5_chat_formatting": chat.query,
    "op6_minhash_dedup": minhash.query,
    "op7_warc_revisits": warc.query,
    "op8_quality_rules": quality.query,
    "op9_bpe_encoding": bpe.query,
    "op10_source_mixing": mixing.query,
}

SQL: dict[str, str] = {
    "op5_chat_formatting": chat.SQL,
    "op7_warc_revisits": warc.SQL,
    "op8_quality_rules": quality.SQL,
    "op10_source_mixing": mixing.SQL,
}
