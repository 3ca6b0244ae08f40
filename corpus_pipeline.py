"""From documents to token files: five stages, each written and read again before the next.

Defined results, in all stages: rows with a null or empty text, or one without a letter, have no language and go in the
first stage; a null source is a source of its own; rows with a null id are compared with no other document and are kept
otherwise; repeated rows are one document for the Jaccard join, which keeps one of them; different texts under one id are
documents of their own until the last stage, which orders them by their token ids. Ties go to the smaller id. Texts are
taken whole, however long. Other columns pass through the first four stages, whatever their names; the last has its own
columns. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfolio.llm.decontaminate import drop_leaks, index_items
from arborfolio.llm.jaccard_join import one_of_each
from arborfolio.llm.language import keep_identified, learned_fold, train_languages
from arborfolio.llm.mixing import mixed_documents
from arborfolio.llm.shared import discard, keep
from arborfolio.llm.token_files import public_vocabulary, read_token_files, write_token_files


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those of null or empty texts, or without a letter."""
    model = train_languages(learned_fold(docs).select(F.col("doc_id").alias("id"), "text", "lang"))
    return keep_identified(docs, model)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, that with the smallest id. Rows without an id stay."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leaked benchmark item go; items without a word match none."""
    return drop_leaks(docs, index_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated as the sources' targets ask; those without a word are left out or taken whole times."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; a row per document, read back from them."""
    folder = write_token_files(docs, public_vocabulary())
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_files),
]

#: Models, near duplicates and token files can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = keep(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
        if before:
            discard(spark, before)
        before = path
    return docs
