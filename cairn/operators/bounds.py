"""Top-k without adding up every hit: bounds say which blocks of documents, or which tiers of impacts, can't matter.

Both ways give exactly the first k of the full ranking (score first, then the smaller document). What they don't know is the
number of hits. Only bounds, of which there are as many as blocks or tiers of the query's terms, are read for the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators.filters import Filters
from cairn.operators.index import Index
from cairn.sources.readers import unbounded

#: Documents a block, as in the table `blocks`.
BLOCK_DOCS = 1024
#: Blocks that are read before the threshold is known.
FIRST = 64


def _ranked(index: Index, postings: DataFrame, base: list[str], filters: Filters, k: int) -> DataFrame:
    from cairn.operators.search import filtered, scores

    return filtered(index, scores(postings, base), filters).orderBy(F.desc("score"), "doc").limit(k)


def _inside(blocks: list[int]):
    """The documents of these blocks as ranges of doc, neighbours joined: what row-group statistics can answer."""
    ranges: list[list[int]] = []
    for b in sorted(blocks):
        if ranges and ranges[-1][1] == b:
            ranges[-1][1] = b + 1
        else:
            ranges.append([b, b + 1])
    doc = F.col("doc")
    return reduce(lambda a, b: a | b, ((doc >= low * BLOCK_DOCS) & (doc < high * BLOCK_DOCS) for low, high in ranges), F.lit(False))


def by_blocks(index: Index, base: list[str], k: int, filters: Filters | None = None, first: int = FIRST) -> tuple[DataFrame, dict]:
    """(doc, score of the best k; what was read): the blocks of the highest bounds give a threshold; of the others only those
    whose bound reaches it are read."""
    from cairn.operators.search import needed

    filters, terms = filters or Filters(), T.expand_terms(base)
    rows = index.blocks.where(F.col("term").isin(terms)).groupBy("block").agg(F.sum("most").alias("bound"), F.count(F.when(F.col("term").isin(base), 1)).alias("have"))
    rows = rows.where(F.col("have") >= needed(base)).select("block", "bound")
    head = [r["block"] for r in rows.orderBy(F.desc("bound"), "block").limit(first).collect()]  # at most `first`
    block = F.floor(F.col("doc") / F.lit(BLOCK_DOCS))
    best = _ranked(index, index.postings.where(_inside(head)), base, filters, k).collect()  # at most k
    rest = rows.where(~F.col("block").isin(head))
    if len(best) == k:
        rest = rest.where(F.col("bound") >= best[-1]["score"])
    more = index.postings.where(F.col("term").isin(terms)).withColumn("block", block).join(rest.select("block"), "block", "left_semi")
    held = index.spark.createDataFrame([tuple(r) for r in best], "doc long, score long")
    both = held.unionByName(_ranked(index, more, base, filters, k))
    return both.orderBy(F.desc("score"), "doc").limit(k), {"lane": "blocks", "first_blocks": len(head), "threshold": best[-1]["score"] if len(best) == k else 0}


def by_tiers(index: Index, base: list[str], k: int, filters: Filters | None = None) -> tuple[DataFrame, dict]:
    """The same by tiers of impacts: documents that a query term's upper tiers name are scored in full; once the k-th of them
    beats what all lower tiers could add up to, no other document can be among the best."""
    filters, terms = filters or Filters(), T.expand_terms(base)
    bounds: dict[int, dict[str, tuple[int, int]]] = {}
    for r in index.tiers.where(F.col("term").isin(terms)).collect():  # a few rows a term
        bounds.setdefault(r["tier"], {})[r["term"]] = (r["least"], r["most"])
    postings = index.postings.where(F.col("term").isin(terms))
    best, levels = [], sorted(bounds)
    for at, level in enumerate(levels):
        least: dict[str, int] = {}
        for lower in levels[: at + 1]:
            least |= {t: low for t, (low, _) in bounds[lower].items()}
        upper = reduce(lambda a, b: a | b, ((F.col("term") == t) & (F.col("impact") >= low) for t, low in least.items()))
        docs = postings.where(upper).select("doc").distinct()
        best = _ranked(index, postings.join(unbounded(docs), "doc", "left_semi"), base, filters, k).collect()  # at most k
        tail = sum(max((bounds[lower][t][1] for lower in levels[at + 1 :] if t in bounds[lower]), default=0) for t in terms)
        if len(best) == k and best[-1]["score"] > tail:
            break
    return index.spark.createDataFrame([tuple(r) for r in best], "doc long, score long"), {"lane": "tiers", "tiers_read": at + 1 if levels else 0, "tiers": len(levels)}
