"""A cleaning pipeline over documents: quality, language, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafringe.llm.common import cut, shared_dir
from terrafringe.llm.language_id import fit, held_out, identify
from terrafringe.llm.ngram_join import near_duplicates
from terrafringe.llm.packing import pack_documents
from terrafringe.llm.quality import judge, passed
from terrafringe.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return passed(judge(docs), COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with `lang` as predicted; the model learns from this stage's input."""
    model = fit(docs.filter(~held_out()))
    found = identify(docs.select(*COLUMNS), model).filter("not ambiguous")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates; of rows with the same id, one (the least by its text); all without an id."""
    own = docs.select(*COLUMNS)
    found = cut(near_duplicates(docs).filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("k")))
    once, several = (own.join(found.filter(rule).select("doc_id").hint("merge"), "doc_id", "left_semi") for rule in ("k = 1", "k > 1"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[F.col(c).asc_nulls_last() for c in COLUMNS[1:]]))
    several = several.withColumn("place", place).filter("place = 1")
    return once.select(*COLUMNS).unionByName(several.select(*COLUMNS)).unionByName(own.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that earlier ones hold; a document of which nothing is left goes."""
    rows = docs.select("doc_id", "text", "lang", "source", F.col("text").isNull().alias("no_text"))
    found = remove_repeats(rows, keep_text=True, carry=("lang", "source", "no_text")).filter("n_removed = 0 or length(trim(kept_text)) > 0")
    out = found.withColumn("text", F.when(~F.col("no_text"), F.col("kept_text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicate_join),
    ("suffix-array dedup", repeated_passages),
    ("packing", packing),
]

#: Training, trees and tokenizers are not SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
