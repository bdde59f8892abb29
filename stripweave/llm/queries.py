"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.llm import ann, bpe, chat, gif, licenses, neardup, packing, quality, sharding, topk, toxicity, trie, whitening
from stripweave.llm.common import table


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all rows."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -7, formatted and read back."""
    return chat.digests(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, scored by a model of the labels outside fold 0."""
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a stored picture, read back."""
    return gif.media_report(table(spark, sf_dir, "documents"))


def op5_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, encoded and decoded."""
    return bpe.token_report(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, scanned for licenses."""
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in classes of near copies by 2-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Rule(shingle=2, percent=80))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, scored by a model of the labels outside fold 2."""
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sequence, with its documents' ids, their places and the tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.sequences(docs, packing.pack_documents(docs))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the conversations that begin with turns of their hundred's first."""
    paths = trie.conversation_paths(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.share_beginnings(paths))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors, whitened by the first 16 components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest scores of every vector whose id is divisible by 50, among all rows."""
    rows = topk.sparse_rows(table(spark, sf_dir, "embeddings"), 256.0)
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_multi_index, op2_chat_format, op3_toxicity, op4_gif_media, op5_bpe_tokens, op6_jump_shards, op7_license_scan,
        op8_hyperminhash, op9_quality, op10_best_fit_packing, op11_prefix_trie, op12_whitening, op13_exact_topk,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.ORACLE, "op6_jump_shards": sharding.oracle(8), "op11_prefix_trie": trie.ORACLE, "op13_exact_topk": topk.ORACLE}
