"""The corpus pipeline: quality classifier, n-gram Jaccard join, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. run() writes every stage as Parquet in the shared folder and rereads it as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import chunks, ngram_join, packing, quality, queries, substring_dedup
from cairn.llm.common import persist

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that importance resampling rejects, row by row: ids may be shared or missing."""
    paths, place = chunks.written(docs, spark), ("file", "chunk", "row")
    judged = quality.classify(chunks.rows_of(spark, paths), queries.table(spark, sf_dir, "labels"), queries.good_label(), carry=place)
    return chunks.take(spark, paths, judged.where("kept"), COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group that similarity links connect, row by row: of rows that share an id, or have
    none, the first in the table; an id sorts before none."""
    paths = chunks.written(docs, spark)
    rows = ngram_join.grouped(spark, paths).where(F.col("name") == F.col("first"))
    return chunks.take(spark, paths, chunks.places(rows, chunks.file_numbers(spark, paths)), COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; n_chars follows. A document of which nothing is left stays, empty."""
    left = substring_dedup.remove(spark, docs)
    return left.select("doc_id", "text", "lang", "source", F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, queries.tokenizer(queries.WORD_VOCABULARY), 2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = persist(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
