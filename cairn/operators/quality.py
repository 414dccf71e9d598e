"""How good and how fast: ranks of known items, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.readers import unbounded


def ranks_of(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, rank of the first expected document in the results, 0 where it isn't there. found: key, doc, rank; expected: key, doc."""
    hit = found.join(unbounded(expected), [key, "doc"]).groupBy(key).agg(F.min("rank").alias("rank"))
    return expected.select(key).distinct().join(unbounded(hit), key, "left").select(key, F.coalesce("rank", F.lit(0)).alias("rank"))


def label_ranks(found: DataFrame, queries: DataFrame, documents: DataFrame, key: str, label: str) -> DataFrame:
    """key, rank of the first document whose label is the query's own, 0 where there is none: labels are compared on the rows
    found, so that a label that many documents share makes no pairs. queries: key, label; documents: doc, label."""
    wanted = queries.select(key, F.col(label).alias("_wanted"))
    same = found.join(unbounded(documents.select("doc", label)), "doc").join(unbounded(wanted), key).where(F.col(label) == F.col("_wanted"))
    hit = same.groupBy(key).agg(F.min("rank").alias("rank"))
    return queries.select(key).join(unbounded(hit), key, "left").select(key, F.coalesce("rank", F.lit(0)).alias("rank"))


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """n, hit1, hit3, hit10, mrr10."""
    r = F.col("rank")
    hit = lambda k: F.avg(F.when((r > 0) & (r <= k), F.lit(1.0)).otherwise(F.lit(0.0)))
    return ranks.agg(F.count("*").alias("n"), hit(1).alias("hit1"), hit(3).alias("hit3"), hit(10).alias("hit10"), F.avg(F.when((r > 0) & (r <= 10), F.lit(1.0) / r).otherwise(F.lit(0.0))).alias("mrr10"))


def latency_summary(values: DataFrame, column: str, quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """n, mean and nearest-rank quantiles of a column."""
    cols = [F.expr(f"percentile_disc({q}) within group (order by {column})").alias(f"p{round(q * 100)}") for q in quantiles]
    return values.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), *cols)
