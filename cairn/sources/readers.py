"""Sources: JSON lines with dense ordinals, XML page dumps, HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def with_ordinals(df: DataFrame, name: str = "doc", order: list[str] | None = None) -> DataFrame:
    """Adds dense numbers from 0 in the order of the given columns (the order of the rows as they come if there are none).

    Two passes and no single-partition window: rows are range-partitioned and sorted, the sizes of the partitions are
    counted, and each row gets its partition's offset plus its place in it."""
    from .store import fresh_path

    spark = df.sparkSession
    path = fresh_path(spark, "ordered")  # partition numbers must not change between the two passes
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.parquet(path)
    sizes = held.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("low")).withColumn("base", F.sum("n").over(Window.orderBy("_part")) - F.col("n"))
    out = held.join(F.broadcast(sizes.select("_part", "low", "base")), "_part")  # a row a partition
    return out.withColumn(name, F.col("base") + F.col("_row") - F.col("low")).drop("_part", "_row", "low", "base")


#: Rows of a source that one task takes, about.
TASK_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores if they come in fewer partitions that hold any (one row group is one task), and over more if a
    partition would have very many; else as they are. The count reads no column."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = [n for _, n in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]  # a row a partition
    if len(sizes) >= cores and max(sizes, default=0) <= 2 * TASK_ROWS:
        return df
    return df.repartition(max(cores, -(-sum(sizes) // TASK_ROWS)))


def unbounded(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus. Spark takes a table for small by its compressed bytes, of which a sorted
    table of millions of rows may have few, and would build a broadcast of it in the driver; this keeps it from that."""
    return df.hint("merge")


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType | None = None, limit: int | None = None, fail_fast: bool = True) -> DataFrame:
    """Documents of JSON-lines files, one a non-blank line, numbered from 0 in the order of files and lines. limit: only the
    first lines. Lines are parsed and numbered in the JVM."""
    mode = {"mode": "FAILFAST" if fail_fast else "PERMISSIVE"}
    if schema is None:
        schema = spark.read.options(**mode).json(path).schema
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    lines = lines.withColumn("_line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    order = ["_file", "_at", "_line"]
    if limit is not None:
        lines = lines.orderBy(*order).limit(limit)
    numbered = with_ordinals(lines, "doc", order)
    return numbered.select("doc", F.from_json("value", schema, mode).alias("d")).select("doc", "d.*")


def write_json_lines_prefix(spark: SparkSession, source: str, target: str, n: int) -> None:
    """The first n non-blank lines as a file of their own."""
    spark.read.text(source).where(F.trim("value") != "").limit(n).coalesce(1).write.mode("overwrite").text(target)


_OPEN, _CLOSE, _INNER = r"\[\[", r"\]\]", r"[^\]]+"
_SPACED = ("<ref\\b.*?</ref>", "<ref\\b[^/]*/>", "<!--.*?-->", "\\{\\{.{0,2000}?\\}\\}", "\\{\\|.*?\\|\\}", f"{_OPEN}(?:Image|Fichier|Cat[eé]gorie):{_INNER}{_CLOSE}")
_KEPT = (f"{_OPEN}[^|\\]]+\\|({_INNER}){_CLOSE}", f"{_OPEN}({_INNER}){_CLOSE}", "\\[https?://[^\\]\\s]+\\s*([^\\]]*)\\]")
#: References, comments, templates, tables, files and categories go; links keep what they show; then quotes, headings, tags.
_MARKUP = (*((f"(?isu){x}", " ") for x in _SPACED), *((f"(?iu){x}", "$1") for x in _KEPT), ("''+", ""), ("==+\\s*([^=]+?)\\s*==+", " $1 "), ("<[^>]+>", " "), ("[|\\[\\]{}]", " "), ("\\s+", " "))


def strip_wikitext(text: Column) -> Column:
    """Plain text of wiki markup."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in _MARKUP:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def strip_html(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags go, the usual entities are read."""
    out = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "head"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.replace(F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("&amp;"), F.lit("&"))


def read_pages_dump(spark: SparkSession, path: str, body_chars: int = 6000, least: int = 80) -> DataFrame:
    """Articles of an XML page dump: main namespace, no redirects, bodies of at least `least` characters."""
    schema = "id string, ns string, title string, redirect struct<_title:string>, revision struct<timestamp:string, text:string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    raw = F.col("revision.text")
    body = strip_wikitext(raw)
    body = F.substring(body, 1, body_chars) if body_chars else body
    names = F.transform(F.regexp_extract_all(raw, F.lit(r"(?iu)\[\[(?:Catégorie|Category):([^\]|]+)"), 1), F.trim)
    rows = pages.where((F.coalesce("ns", F.lit("0")) == "0") & F.col("redirect").isNull() & (F.trim("title") != "")).select(
        F.trim("id").alias("id"), F.trim("title").alias("title"), body.alias("body"), F.slice(F.array_distinct(names), 1, 8).alias("category_list"),
        F.to_date(F.try_to_timestamp(F.col("revision.timestamp"))).cast("string").alias("revision_date"),
    )
    return rows.where(F.length("body") >= least).withColumns({"categories": F.array_join("category_list", " "), "category": F.coalesce(F.try_element_at("category_list", F.lit(1)), F.lit("")), "category_count": F.size("category_list"), "has_categories": F.size("category_list") > 0})
