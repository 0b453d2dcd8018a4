"""The numbered queries ``opN_<name>`` over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folio.llm import chat, codes, trie
from folio.llm.ann import nearest
from folio.llm.bpe import bpe_digest
from folio.llm.covertree import near_vectors
from folio.llm.html import extract
from folio.llm.langid import predict_languages
from folio.llm.packing import pack
from folio.llm.pieces import piece_digest
from folio.llm.simhash import simhash_components
from folio.llm.substrings import dedup_substrings
from folio.llm.toxicity import predict_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.preference_pairs(_table(spark, sf_dir, "conversations")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op8_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_digest(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_language_id,
    op2_simhash,
    op3_best_fit_packing,
    op4_html_extraction,
    op5_preference_chat,
    op6_byte_bpe,
    op7_substring_dedup,
    op8_projected_neighbours,
    op9_cover_tree,
    op10_toxicity,
    op11_prefix_trie,
    op12_sentencepiece,
    op13_vector_codes,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op5_preference_chat": chat.ORACLE_SQL, "op11_prefix_trie": trie.ORACLE_SQL, "op13_vector_codes": codes.ORACLE_SQL}
