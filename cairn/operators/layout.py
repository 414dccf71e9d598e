"""Orders and summaries of an index: locality of documents, shards of terms, bounds on impacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.values import half_up, shard_key
from cairn.sources.readers import unbounded


def locality(terms: DataFrame, docs: DataFrame, limit: int = 2, depth: int = 3) -> DataFrame:
    """doc, shard, prime, second, strength: the documents' best base terms, by which their rows lie together when written in
    order of (no terms last, shard, prime, strength down, second, doc)."""
    base = ~F.col("term").contains("_")
    w = Window.partitionBy("doc").orderBy(F.desc("is_base"), F.desc("score"), T.tie_key(F.col("term")))
    rows = terms.withColumn("is_base", base.cast("int")).withColumn("r", F.row_number().over(w)).withColumn("any", F.max("is_base").over(Window.partitionBy("doc")))
    rows = rows.where((F.col("r") <= max(2, limit)) & (F.col("is_base") == F.col("any")))
    best = rows.groupBy("doc").agg(F.max(F.when(F.col("r") == 1, F.col("term"))).alias("prime"), F.max(F.when((F.col("r") == 2) & (F.lit(limit) >= 2), F.col("term"))).alias("second"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("strength"))
    out = docs.select("doc").join(unbounded(best), "doc", "left")
    return out.select("doc", F.when(F.col("prime").isNotNull(), shard_key(F.col("prime"), depth)).otherwise(F.lit("")).alias("shard"), F.coalesce("prime", F.lit("")).alias("prime"), F.coalesce("second", F.lit("")).alias("second"), F.coalesce("strength", F.lit(0)).cast("long").alias("strength"))


#: The order of placed().
PLACE = ["unplaced", "shard", "prime", "weaker", "second", "doc"]


def placed(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs with the columns of PLACE: documents of the same best terms, the strongest first, lie together in that order."""
    places = locality(terms, docs).withColumn("unplaced", F.col("prime") == "").withColumn("weaker", -F.col("strength")).drop("strength")
    return docs.join(unbounded(places), "doc")


def term_shards(frequencies: DataFrame, base: int = 3, deepest: int = 5, target: int = 30_000) -> DataFrame:
    """term, df, shard: prefixes lengthened while a shard holds more than `target` postings. Sizes are sums by prefix, added up
    before they are shuffled, so a prefix of very many terms is no task of its own."""
    out = frequencies.select("term", "df").withColumn("depth", F.lit(base))
    for depth in range(base, deepest):
        key = shard_key(F.col("term"), depth)
        sizes = frequencies.groupBy(key.alias("prefix")).agg(F.sum("df").alias("size")).where(F.col("size") > target)
        out = out.withColumn("prefix", key).join(sizes, "prefix", "left").withColumn("depth", F.when((F.col("depth") == depth) & F.col("size").isNotNull(), F.lit(depth + 1)).otherwise(F.col("depth"))).drop("prefix", "size")
    shard = shard_key(F.col("term"), base)
    for depth in range(base + 1, deepest + 1):
        shard = F.when(F.col("depth") == depth, shard_key(F.col("term"), depth)).otherwise(shard)
    return out.select("term", "df", shard.alias("shard"))


def block_bounds(postings: DataFrame, docs_per_block: int = 1024) -> DataFrame:
    """term, block, most, first_doc, n, rest: the largest impact of each block of documents, and of it and all after it."""
    block = F.floor(F.col("doc") / F.lit(docs_per_block)).alias("block")
    blocks = postings.groupBy("term", block).agg(F.max("impact").alias("most"), F.min("doc").alias("first_doc"), F.count("*").alias("n"))
    # from the last block backwards: a frame up to the end is added up anew for each row, one from the start is carried on
    after = Window.partitionBy("term").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("rest", F.max("most").over(after))


def impact_tiers(postings: DataFrame, tiers: int = 4) -> DataFrame:
    """term, tier, n, least, most: postings by impact relative to the term's largest."""
    each = postings.groupBy("term", "impact").agg(F.count("*").alias("n"))  # impacts are whole numbers: no more rows a term than there are values
    rows = each.withColumn("top", F.max("impact").over(Window.partitionBy("term")))
    tier = F.least(F.lit(tiers - 1), F.floor((F.lit(1.0) - F.col("impact") / F.col("top")) * F.lit(tiers))).cast("int")
    return rows.groupBy("term", tier.alias("tier")).agg(F.sum("n").alias("n"), F.min("impact").alias("least"), F.max("impact").alias("most"))


def column_summaries(docs: DataFrame, column: str, rows_per_chunk: int = 1024) -> DataFrame:
    """chunk, least, most, n, nulls of a typed column, by ranges of documents: what a zone map holds."""
    chunk = F.floor(F.col("doc") / F.lit(rows_per_chunk)).alias("chunk")
    c = F.col(column)
    return docs.groupBy(chunk).agg(F.min(c).alias("least"), F.max(c).alias("most"), F.count(c).alias("n"), F.count(F.when(c.isNull(), 1)).alias("nulls"))


def quantised(bound, top, bits: int = 8):
    """A bound in 2**bits steps, never below the true one."""
    steps = (1 << bits) - 1
    return F.ceil(bound * F.lit(float(steps)) / top) * top / F.lit(float(steps))


def rounded(x, digits: int = 3):
    scale = F.lit(float(10**digits))
    return half_up(x * scale) / scale
