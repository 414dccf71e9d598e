"""Sorted copies of the typed columns: a sorted page is read from the front of a copy, as far as it takes.

A replica holds rnk, doc and the typed columns of the documents that have a value, in order of the value and then of the
document, so that statistics of rnk prune row groups. Pages are read in prefixes of ranks, each eight times as long as the
one before; what passes there is exactly the front of the whole result. Documents without a value come after all others:
a page that reaches them is left to the general plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.index import Index
from cairn.sources.readers import unbounded

FIRST = 4096


def replica_of(index: Index, spec: tuple[str, bool] | None) -> DataFrame | None:
    if spec is None:
        return None
    name = spec[0].split("_", 1)[1]
    return index.tables.get(f"replica_{name}_{'desc' if spec[1] else 'asc'}")


def front(index: Index, spec: tuple[str, bool] | None, passes, count: int, hits: DataFrame | None = None, first: int = FIRST) -> tuple[DataFrame, dict] | None:
    """(doc, score, rank from 1 of at least the first `count` documents that pass, what was read); None if there is no such
    replica or it doesn't reach. hits: doc, score that the documents must be among."""
    replica = replica_of(index, spec)
    if replica is None or hits is not None and spec[0].startswith("boolean_"):
        return None
    ranked, limit = replica.agg(F.max("rnk")).first()[0], first  # from the footers' statistics
    if ranked is None:
        return None
    while True:
        rows = replica.where(F.col("rnk") < limit)
        rows = rows if passes is None else rows.where(passes)
        rows = rows.select("rnk", "doc", *(["_value"] if hits is not None else []))
        if hits is not None:
            # equal values go by score, so the last value of a prefix may be cut in two: it isn't counted
            rows = rows.join(unbounded(hits), "doc")
            order = [F.col("_value"), F.desc("score"), F.col("doc")]
            last = replica.where(F.col("rnk") == limit).select("_value").first() if limit <= ranked else None
            rows = rows if last is None else rows.where(F.col("_value") < F.lit(last[0]))
        else:
            rows, order = rows.withColumn("score", F.lit(0).cast("long")), [F.col("rnk")]
        found = rows.orderBy(*order).limit(count).collect()  # a page and those before it
        if len(found) >= count:
            page = [(r["doc"], r["score"], k + 1) for k, r in enumerate(found)]
            return index.spark.createDataFrame(page, "doc long, score long, rank int"), {"lane": "replica", "ranks_read": min(limit, ranked + 1)}
        if limit > ranked:
            return None
        limit *= 8
