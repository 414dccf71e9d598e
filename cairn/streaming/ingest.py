"""Segments from a stream: every micro-batch of documents becomes an immutable segment.

A segment holds the batch's documents, tokens and counts, and a manifest with their numbers of rows and checksums; it is
named after the batch's number and written whole, so a batch that is run again replaces itself. Counts don't depend on other
batches: read_segments() scores all segments together, with the mean lengths of all their documents, and gives the index
that a build of the same documents gives. `doc_terms` of a segment are scored with the batch's own means, for a look at it
before the others are read; merge_segments() puts such tables together.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.index import Index, averages, doc_terms, document_frequencies, documents, in_one_row, occurrences, postings, proximity_rows, token_arrays
from cairn.plans.config import IndexConfig
from cairn.sources.store import checksum, read_text, verify, write_text

TABLES = ("docs", "tokens", "occurrences")


def write_segment(batch: DataFrame, number: int, cfg: IndexConfig, path: str) -> None:
    """Tables and manifest of a batch. Texts are tokenised once; what follows reads the written tokens."""
    spark = batch.sparkSession

    def write(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}/segment={number}")
        return spark.read.parquet(f"{path}/{name}/segment={number}")

    batch = batch.persist()
    try:
        held = {"docs": write("docs", documents(batch, cfg)), "tokens": write("tokens", token_arrays(batch, cfg))}
    finally:
        batch.unpersist()
    one_row = in_one_row(held["tokens"], cfg)
    counts = held["occurrences"] = write("occurrences", occurrences(held["tokens"], cfg, one_row))
    n = held["docs"].count()
    pairs = proximity_rows(held["tokens"], cfg) if cfg.expansion_terms_per_doc > 0 else None
    write("doc_terms", doc_terms(counts, pairs, cfg, averages(counts, cfg, n), held["tokens"] if one_row else None))
    write_text(spark, f"{path}/manifest/segment={number}.json", json.dumps({"segment": number, "docs": n, "checksums": {k: checksum(df) for k, df in held.items()}}, sort_keys=True))


def read_segments(spark: SparkSession, path: str, cfg: IndexConfig, numbers: list[int] | None = None, check: bool = False) -> Index:
    """All segments (or those of the given numbers) as one index, scored together. check: tables must have the checksums
    that their manifests say."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    if numbers is not None:
        tables = {name: df.where(df["segment"].isin(numbers)) for name, df in tables.items()}
    if check:
        for (k,) in tables["docs"].select("segment").distinct().collect():  # a row a segment
            said = json.loads(read_text(spark, f"{path}/manifest/segment={k}.json"))
            for name, df in tables.items():
                verify(df.where(df["segment"] == k).drop("segment"), said["checksums"][name])
    tables = {name: df.drop("segment") for name, df in tables.items()}
    n = tables["docs"].count()
    mean = averages(tables["occurrences"], cfg, n)
    pairs = proximity_rows(tables["tokens"], cfg) if cfg.expansion_terms_per_doc > 0 else None
    tables["doc_terms"] = doc_terms(tables["occurrences"], pairs, cfg, mean, tables["tokens"] if in_one_row(tables["tokens"], cfg) else None)
    tables["terms"] = document_frequencies(tables["doc_terms"])
    tables["postings"] = postings(tables["doc_terms"], tables["terms"], n)
    return Index(spark, cfg, n, mean, tables, path)


def stream_segments(docs: DataFrame, cfg: IndexConfig, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream; trigger as for DataStreamWriter.trigger, by default all that is there and then stop."""
    cfg.check(docs.columns)
    writer = docs.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, number: write_segment(batch, number, cfg, path)).start()
