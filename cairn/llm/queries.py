"""The registered queries of the training-data operators, with their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PIECE_MODEL, BYTE_VOCABULARY, WORD_VOCABULARY = "piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .ann import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, query_rows=True)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import digests

    return digests(spark, f"{sf_dir}/documents.parquet", 20)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(table(spark, sf_dir, "documents"), shards=24, slots=8192)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar

    return similar(spark, f"{sf_dir}/documents.parquet")


def good_label():
    from pyspark.sql import functions as F

    return F.col("quality") == 1


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), good_label())


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import store_and_describe

    return store_and_describe(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .lm_score import lm_score

    return lm_score(table(spark, sf_dir, "documents"), F.col("lang") == "en")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sp_codec import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer(PIECE_MODEL))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer(BYTE_VOCABULARY), 512)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer(WORD_VOCABULARY), 2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = "list_filter(string_split_regex(coalesce({}, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"

OP2 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format('text')} AS a FROM documents),
win AS (SELECT doc_id, i, a[i : i + 19] AS k FROM (SELECT doc_id, a, unnest(range(1, len(a) - 18)) AS i FROM w WHERE len(a) >= 20)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
each AS (SELECT doc_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(a)::BIGINT AS n_words, (len(a) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS a FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(a) < 2 THEN a ELSE [a[i] || ' ' || a[i + 1] FOR i IN range(1, len(a))] END)) AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (SELECT l.doc_id AS a, r.doc_id AS b FROM e l JOIN e r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY l.doc_id, r.doc_id, l.n, r.n HAVING 160 * count(*) >= 60 * (l.n + r.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(many.n, 0)::BIGINT AS n_similar, component_id, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS class_id
FROM s JOIN low ON low.a = doc_id LEFT JOIN many ON many.a = doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others are held against brute force, their libraries or exact round trips in the tests."""
    return {"op2_substring_dedup": OP2.strip(), "op4_ngram_join": OP4.strip()}
