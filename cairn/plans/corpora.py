"""The corpora that the registered queries run over, and their indexes, each built once a session and folder. All of them are
indexed from whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.index import Index, build
from cairn.plans.config import Authority, Boolean, Display, Facet, IndexConfig, Number, TextField
from cairn.sources.readers import html_title, strip_html, with_ordinals

DOCUMENTS = IndexConfig(
    text=(TextField("body", "text"),), facets=(Facet("lang"), Facet("source")), numbers=(Number("n_chars", type="long"),), booleans=(Boolean("quality"), Boolean("toxic")),
    display=(Display("lang"), Display("source"), Display("snippet", "text", 40)), id_path="doc_id", body_chars=0,
)
PARTS = IndexConfig(
    text=(TextField("title", "p_name", weight=4.5, b=0.55, phrase=True), TextField("kind", "p_type", weight=1.4, b=0.0)), facets=(Facet("p_brand"), Facet("p_type")),
    numbers=(Number("p_size", type="int"), Number("p_retailprice", type="double")), authority=(Authority("name", "p_name"),), display=(Display("title", "p_name"), Display("p_brand")),
    id_path="p_partkey", bundles=True, bundle_field_tokens=0, sort_replicas=(("p_retailprice", "desc"),),
)
TURNS = IndexConfig(text=(TextField("body", "text", proximity=True, max_proximity_tokens=0),), facets=(Facet("role"),), expansion_terms_per_doc=8, id_path="doc", body_chars=0)
PAGES = IndexConfig(text=(TextField("title", weight=4.5, b=0.55, phrase=True), TextField("body")), authority=(Authority("title"),), display=(Display("title"), Display("url")), id_path="doc", body_chars=0)
ORDERS = IndexConfig(text=(TextField("priority", "o_orderpriority"),), facets=(Facet("o_orderstatus"), Facet("o_orderpriority")), numbers=(Number("o_orderdate", type="date"), Number("o_totalprice", type="double")), id_path="o_orderkey")

_built: dict[tuple, Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("doc", F.col("doc_id"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("doc", F.col("p_partkey"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ordinals(table(spark, sf_dir, "conversations"), "doc", ["conv_id", "turn"])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), "url", html_title(F.col("html")).alias("title"), strip_html(F.col("html")).alias("body"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("doc", F.col("o_orderkey"))


CORPORA = {"documents": (documents, DOCUMENTS), "parts": (parts, PARTS), "turns": (turns, TURNS), "pages": (pages, PAGES), "orders": (orders, ORDERS)}


def corpus(spark: SparkSession, sf_dir: str, name: str) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        read, cfg = CORPORA[name]
        _built[key] = build(read(spark, sf_dir), cfg, source=f"{sf_dir}/{name}")
    return _built[key]
