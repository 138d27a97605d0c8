"""The queries of this subpackage: each operator over the whole of its table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafringe.llm.common import shared_dir
from terrafringe.llm.compact_windows import near_passages
from terrafringe.llm.language_id import fit, held_out, identify
from terrafringe.llm.ngram_join import near_duplicates
from terrafringe.llm.oracles import ORACLE_SQL  # noqa: F401 - read by the entry point
from terrafringe.llm.packing import pack_documents
from terrafringe.llm.quality import judge
from terrafringe.llm.sentencepiece_bpe import encode_documents
from terrafringe.llm.sharding import shard_table
from terrafringe.llm.suffix_dedup import remove_repeats
from terrafringe.llm.url_filter import judge_urls
from terrafringe.llm.vector_join import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(docs.filter("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op3_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents")).drop("text", "lang", "source", "n_chars")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals of documents, compacted; where each document is, with a digest of what is stored."""
    docs = _table(spark, sf_dir, "documents")
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    store = shard_table(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", [docs.filter(F.coalesce(arrival, F.lit(0)) == k) for k in range(4)])
    rows = store.read()
    if rows is None:
        rows = docs.withColumn("shard", F.lit(0)).withColumn("generation", F.lit(0))
    return rows.select("doc_id", "shard", "generation", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "lang", "source", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_vector_join": op3_vector_join,
    "op4_ngram_join": op4_ngram_join,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_compact_windows": op8_compact_windows,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sharding": op10_sharding,
}
