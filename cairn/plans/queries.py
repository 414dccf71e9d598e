"""The registered queries of the search engine and, for each that SQL can express, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import fuzzy as Z
from cairn.functions import text as T
from cairn.functions import values as V
from cairn.operators import bounds, layout, quality, search as S, typo
from cairn.operators.index import rank_map
from cairn.plans import oracle as O
from cairn.plans.corpora import CORPORA, DOCUMENTS, PARTS, TURNS, corpus, table
from cairn.sources.store import fresh_path
from cairn.streaming.ingest import read_segments, write_segment

Query = Callable[[SparkSession, str], DataFrame]
TWO, FIVE = "anea erin", "anea attion erin thanea thanedble"
PHRASE = "red widget"

D = O.index(DOCUMENTS, "documents", "doc_id", {"body": "text"})
P = O.index(PARTS, "part", "p_partkey", {"title": "p_name", "kind": "p_type"})
NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc FROM conversations)"
C = O.index(TURNS, "numbered", "doc", {"body": "text"}).replace("WITH src", f"WITH {NUMBERED}, src", 1)
LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _terms(q: str) -> tuple[list[str], list[str], int]:
    base = T.tokenize_text(q)
    return base, T.expand_terms(base), S.needed(base)


def _hits(q: str) -> str:
    return O.hits(*_terms(q))


def _page(spark: SparkSession, sf_dir: str, name: str, q: str = "", columns=("doc", "score", "rank"), **options) -> DataFrame:
    options.setdefault("authority", False)
    rows = S.search(corpus(spark, sf_dir, name), q, **options).rows
    return rows.select(*(F.col(c).cast("int") if c == "rank" else F.col(c) for c in columns))


def _search(name: str, corpus_name: str, with_clause: str, q: str, sql_join: str = "", order: str = "score DESC, doc", size: int = 10, page: int = 1, **options) -> None:
    """Registers a text search and its SQL; sql_join: what follows FROM hits."""
    source = f"(SELECT hits.* FROM hits {sql_join})" if sql_join else "hits"
    sql = f"{with_clause}, {_hits(q)}) {O.page(order, size, (page - 1) * size, source)}"
    register(name, sql)(lambda spark, sf_dir: _page(spark, sf_dir, corpus_name, q, size=size, page=page, rerank=False, **options))


# -- tables of the index ------------------------------------------------------


@register("corpus_measure", D + " SELECT (SELECT count(*) FROM documents) AS n, CAST(sum(tf0) AS BIGINT) AS tokens, greatest(1e0, sum(tf0)::DOUBLE / greatest(1, (SELECT count(*) FROM documents))) AS mean_tokens FROM occ")
def corpus_measure(spark, sf_dir):
    ix = corpus(spark, sf_dir, "documents")
    return ix.occurrences.agg(F.lit(ix.n).cast("long").alias("n"), F.sum("tf0").alias("tokens"), F.greatest(F.lit(1.0), F.sum("tf0").cast("double") / F.lit(max(1, ix.n))).alias("mean_tokens"))


register("term_counts", D + " SELECT doc, term, tf0 AS tf FROM occ")(lambda s, d: corpus(s, d, "documents").occurrences.select("doc", "term", F.col("tf0").alias("tf")))
register("doc_terms", D + " SELECT doc, term, score FROM doc_terms")(lambda s, d: corpus(s, d, "documents").doc_terms)
register("term_df", D + " SELECT term, df FROM df")(lambda s, d: corpus(s, d, "documents").terms)
register("postings", D + " SELECT term, doc, impact FROM postings")(lambda s, d: corpus(s, d, "documents").postings)
register("part_postings", P + " SELECT term, doc, impact FROM postings")(lambda s, d: corpus(s, d, "parts").postings)
register("proximity_postings", C + " SELECT term, doc, impact FROM postings")(lambda s, d: corpus(s, d, "turns").postings)


@register("merge_segments", D + " SELECT term, doc, score FROM doc_terms")
def merged(spark, sf_dir):
    """Three segments, written apart as a stream writes them and read as one index: the terms of a build of all documents."""
    docs, path = CORPORA["documents"][0](spark, sf_dir), fresh_path(spark, "segments")
    for k in range(3):
        write_segment(docs.where(F.pmod("doc", F.lit(3)) == k), k, DOCUMENTS, path)
    return read_segments(spark, path, DOCUMENTS).doc_terms.select("term", "doc", "score")


@register("facet_values", " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, {f} AS label, count(*) AS n, count(*) AS n_docs FROM documents WHERE {f} <> '' GROUP BY {f}" for f in ("lang", "source")))
def facet_values(spark, sf_dir):
    return corpus(spark, sf_dir, "documents").facets


@register(
    "typed_columns",
    f"SELECT doc_id AS doc, CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS title, lang, CASE WHEN length(text) > 40 THEN rtrim(substr(text, 1, 40), ' ') ELSE text END AS snippet, n_chars, CASE WHEN quality IS NULL THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS quality_code FROM {LABELLED}",
)
def typed_columns(spark, sf_dir):
    return corpus(spark, sf_dir, "documents").docs.select("doc", "id", "title", "lang", "snippet", F.col("number_n_chars").alias("n_chars"), V.boolean_code(F.col("boolean_quality")).alias("quality_code"))


# -- text search --------------------------------------------------------------

_search("search_and", "documents", D, TWO)
_search("search_most_of_five", "documents", D, FIVE)
_search("search_second_page", "documents", D, "er", page=2, size=25)
_search("search_exact_fan_out", "documents", D, TWO, fan_out=True)
_search("search_phrase", "parts", P, PHRASE)
_search("search_facet", "documents", D, TWO, "JOIN documents ON doc = doc_id WHERE lang IN ('en', 'fr') AND source IN ('src0', 'src1', 'src2', 'src3')", filters={"facets": {"lang": ["en", "fr"], "source": ["src0", "src1", "src2", "src3"]}})
_search("search_number_range", "documents", D, TWO, "JOIN documents ON doc = doc_id WHERE n_chars BETWEEN 1000 AND 3000", filters={"numbers": {"n_chars": {"min": 1000, "max": 3000}}})
_search("search_boolean", "documents", D, "er", f"JOIN {LABELLED} d ON doc = d.doc_id WHERE quality = 1 AND toxic = 0", filters={"booleans": {"quality": True, "toxic": False}})
_search("search_unknown_facet", "documents", D, TWO, "WHERE false", filters={"facets": {"lang": ["xx"]}})
_search("search_unknown_number", "documents", D, TWO, "WHERE false", filters={"numbers": {"nothing": {"min": 1}}})
register("search_sorted", f"{D}, {_hits(TWO)}) {O.page('n_chars DESC NULLS LAST, score DESC, doc', 10, 0, '(SELECT * FROM hits JOIN documents ON doc = doc_id)')}")(lambda s, d: _page(s, d, "documents", TWO, sort="-n_chars"))
register("search_sorted_nulls_last", f"{D}, {_hits('er')}) {O.page('toxic ASC NULLS LAST, score DESC, doc', 100, 0, f'(SELECT hits.*, toxic FROM hits JOIN {LABELLED} d ON doc = d.doc_id)')}")(lambda s, d: _page(s, d, "documents", "er", sort={"field": "toxic", "order": "asc"}, size=100))
register("search_number_and_sort", f"{P}, {_hits('widget')}) {O.page('p_retailprice ASC NULLS LAST, score DESC, doc', 20, 0, '(SELECT * FROM hits JOIN part ON doc = p_partkey WHERE p_size >= 10)')}")(
    lambda s, d: _page(s, d, "parts", "widget", filters={"numbers": {"p_size": {"min": 10}}}, sort="p_retailprice", size=20)
)


@register("search_totals", " UNION ALL ".join(f"SELECT * FROM ({D}, {_hits(q)}) SELECT '{q}' AS q, count(*) AS total FROM hits)" for q in (TWO, FIVE)))
def search_totals(spark, sf_dir):
    rows = [(q, S.search(corpus(spark, sf_dir, "documents"), q, authority=False).total) for q in (TWO, FIVE)]
    return spark.createDataFrame(rows, "q string, total long")


@register("search_minimum_match", f"{D} SELECT doc, CAST(sum(impact) AS BIGINT) AS score, count(*) FILTER (term IN ({O.quoted(_terms(FIVE)[0])})) AS hits FROM postings WHERE term IN ({O.quoted(_terms(FIVE)[1])}) GROUP BY doc")
def minimum_match(spark, sf_dir):
    base, terms, _ = _terms(FIVE)
    rows = corpus(spark, sf_dir, "documents").postings.where(F.col("term").isin(terms))
    return rows.groupBy("doc").agg(F.sum("impact").alias("score"), F.count(F.when(F.col("term").isin(base), 1)).alias("hits"))


@register("search_hydrated", f"{D}, {_hits(TWO)}) SELECT doc, score, rank, lang, source, snippet FROM (SELECT hits.*, lang, source, CASE WHEN length(text) > 40 THEN rtrim(substr(text, 1, 40), ' ') ELSE text END AS snippet, CAST(row_number() OVER (ORDER BY score DESC, doc) AS INTEGER) AS rank FROM hits JOIN documents ON doc = doc_id) WHERE rank <= 10")
def hydrated(spark, sf_dir):
    return _page(spark, sf_dir, "documents", TWO, ("doc", "score", "rank", "lang", "source", "snippet"))


_BATCH = f"""
{D}, asked AS (SELECT item_id AS doc, 0 AS f, text FROM benchmark),{O.tokens('qt', 'asked')},
qbase AS (SELECT doc AS q, term, min(pos) AS pos FROM qt GROUP BY doc, term),
qseq AS (SELECT q, term, row_number() OVER (PARTITION BY q ORDER BY pos) AS pos, count(*) OVER (PARTITION BY q) AS nb FROM qbase),
qterms AS (SELECT q, nb, term, 1 AS is_base FROM qseq
 UNION ALL SELECT a.q, a.nb, a.term || '_' || b.term, 0 FROM qseq a JOIN qseq b ON a.q = b.q AND b.pos = a.pos + 1
 UNION ALL SELECT a.q, a.nb, a.term || '_' || b.term || '_' || c.term, 0 FROM qseq a JOIN qseq b ON a.q = b.q AND b.pos = a.pos + 1 JOIN qseq c ON a.q = c.q AND c.pos = a.pos + 2)"""


@register("batch_any_term", _BATCH + " SELECT q AS item_id, doc, CAST(sum(impact) AS BIGINT) AS score, CAST(sum(is_base) AS BIGINT) AS hits FROM qterms JOIN postings USING (term) GROUP BY q, doc")
def batch_any(spark, sf_dir):
    """Every benchmark passage against all documents: scores of all that share a term."""
    ix = corpus(spark, sf_dir, "documents")
    base = T.terms(F.col("text"), unique=True)
    q = table(spark, sf_dir, "benchmark").select("item_id", base.alias("base"))
    each = q.select("item_id", F.explode(T.expanded(F.col("base"))).alias("term"), "base").select("item_id", "term", F.array_contains("base", F.col("term")).cast("int").alias("is_base"))
    return each.join(ix.postings, "term").groupBy("item_id", "doc").agg(F.sum("impact").alias("score"), F.sum("is_base").alias("hits"))


@register(
    "batch_top",
    f"{P}, asked AS (SELECT p_partkey AS doc, 0 AS f, p_name AS text FROM part),{O.tokens('qt', 'asked')}" + _BATCH.split(O.tokens("qt", "asked"))[1] + ", hit AS (SELECT q, doc, sum(impact) AS score FROM qterms JOIN postings USING (term) GROUP BY q, doc, nb HAVING sum(is_base) >= CASE WHEN nb <= 4 THEN nb ELSE nb - 1 END)"
    " SELECT q AS p_partkey, doc, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM hit) WHERE rank <= 10",
)
def batch_top(spark, sf_dir):
    """Every part's name as a query, ten best parts each."""
    return S.batch(corpus(spark, sf_dir, "parts"), table(spark, sf_dir, "part"), "p_partkey", "p_name", 10).withColumn("rank", F.col("rank").cast("int"))


# -- browsing -----------------------------------------------------------------

_DOCS = f"(SELECT doc_id AS doc, CAST(0 AS BIGINT) AS score, * FROM {LABELLED})"
register("browse", O.page("doc", 20, 20, _DOCS))(lambda s, d: _page(s, d, "documents", page=2, size=20))
register("browse_filtered", O.page("doc", 50, 0, f"(SELECT * FROM {_DOCS} WHERE lang = 'de' AND n_chars >= 500)"))(lambda s, d: _page(s, d, "documents", filters={"facets": {"lang": ["de"]}, "numbers": {"n_chars": {"min": 500}}}, size=50))
register("browse_sorted", O.page("n_chars ASC NULLS LAST, doc", 50, 0, _DOCS))(lambda s, d: _page(s, d, "documents", sort="n_chars", size=50))
register("browse_sorted_nulls_last", O.page("quality DESC NULLS LAST, doc", 100, 0, _DOCS))(lambda s, d: _page(s, d, "documents", sort="-quality", size=100))
_ORDERS = "(SELECT o_orderkey AS doc, CAST(0 AS BIGINT) AS score, * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))"
register("browse_dates", O.page("o_orderdate DESC NULLS LAST, doc", 30, 0, _ORDERS))(
    lambda s, d: _page(s, d, "orders", filters={"numbers": {"o_orderdate": {"min": "1997-01-01", "max": "1997-12-31"}}, "facets": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}}, sort="-o_orderdate", size=30)
)

# -- labels, bundles, replicas --------------------------------------------------

_KEYS = f"""labels_of AS (SELECT p_partkey AS doc, p_name AS v FROM part WHERE p_name <> ''),
label_src AS (SELECT doc, 0 AS f, v AS text FROM labels_of),{O.tokens('lt', 'label_src')},
label_keys AS (SELECT doc, 'r|' || trim(regexp_replace(lower(v), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key, 2000000 AS score FROM labels_of
 UNION ALL SELECT doc, 'x|' || trim(regexp_replace({O.fold('v')}, '[^a-z0-9]+', ' ', 'g')), 1000000 FROM labels_of
 UNION ALL SELECT doc, 't|' || string_agg(term, ' ' ORDER BY pos), 800000 FROM lt GROUP BY doc),
label_rows AS (SELECT key, doc, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, doc) AS INTEGER) AS rnk, count(*) OVER (PARTITION BY key) AS total FROM label_keys WHERE length(key) > 2)"""
register("authority", f"WITH {_KEYS} SELECT key, doc, score, rnk, total FROM label_rows WHERE rnk <= 16")(lambda s, d: corpus(s, d, "parts").authority)
register(
    "search_authority",
    f"{P}, {_KEYS}, {_hits('widget red')}), first AS (SELECT doc, score FROM hits ORDER BY score DESC, doc LIMIT 10), named AS (SELECT doc, score FROM label_rows WHERE rnk <= 16 AND key = 'r|widget red'),"
    " both_rows AS (SELECT doc, sum(score)::DOUBLE AS score FROM (SELECT * FROM first UNION ALL SELECT * FROM named) GROUP BY doc) " + O.page("score DESC, doc", 10, 0, "both_rows"),
)(lambda s, d: _page(s, d, "parts", "widget red", authority=True).withColumn("score", F.col("score").cast("double")))

_SEEDS = f"""seq AS (SELECT doc, f, term, pos, lead(term, 1) OVER w AS t1, lead(term, 2) OVER w AS t2 FROM tok WINDOW w AS (PARTITION BY doc, f ORDER BY pos)),
windows AS (SELECT doc, [term, t1] AS base FROM seq WHERE t1 IS NOT NULL UNION SELECT doc, [term, t1, t2] FROM seq WHERE t2 IS NOT NULL
 UNION SELECT doc, string_split(term, '_') FROM doc_terms WHERE contains(term, '_') AND len(string_split(term, '_')) BETWEEN 2 AND 3),
picked AS (SELECT doc, list(term) AS has FROM doc_terms GROUP BY doc),
seeds AS (SELECT base, count(*) AS docs FROM windows JOIN picked USING (doc) WHERE len(list_distinct(base)) = len(base) AND list_has_all(has, base) GROUP BY base HAVING count(*) >= 2)"""
_BUNDLES = f"""{_SEEDS}, seed_terms AS (SELECT base, unnest(list_distinct(base || CASE WHEN len(base) = 3 THEN [base[1] || '_' || base[2], base[2] || '_' || base[3], base[1] || '_' || base[2] || '_' || base[3]] ELSE [base[1] || '_' || base[2]] END)) AS term FROM seeds),
bundle_hits AS (SELECT base, doc, sum(impact) AS score, count(*) FILTER (list_contains(base, term)) AS have FROM seed_terms JOIN postings USING (term) GROUP BY base, doc),
bundle_rows AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY score DESC, doc) AS rnk, count(*) OVER (PARTITION BY base) AS total, lead(score) OVER (PARTITION BY base ORDER BY score DESC, doc) AS ns FROM bundle_hits WHERE have = len(base))"""
register("bundle_seeds", f"{P}, {_SEEDS} SELECT '{T.BUNDLE_PREFIX}' || array_to_string(base, ' ') AS key, docs FROM seeds")(lambda s, d: corpus(s, d, "parts").seeds.select("key", "docs"))
register(
    "bundles",
    f"{P}, {_BUNDLES} SELECT '{T.BUNDLE_PREFIX}' || array_to_string(base, ' ') AS key, doc, CAST(score AS BIGINT) AS score, CAST(rnk AS INTEGER) AS rnk, total, CAST(coalesce(max(CASE WHEN rnk = 64 THEN ns END) OVER (PARTITION BY base), 0) AS BIGINT) AS next_score FROM bundle_rows WHERE rnk <= 64",
)(lambda s, d: corpus(s, d, "parts").bundles.select("key", "doc", "score", "rnk", "total", "next_score"))


@register("search_bundle", f"{P}, {_hits(PHRASE)}) {O.page('score DESC, doc', 10)}")
def search_bundle(spark, sf_dir):
    """Two terms whose best documents are at hand."""
    return _page(spark, sf_dir, "parts", PHRASE)


register("search_bundle_filtered", f"{P}, {_hits(PHRASE)}) {O.page('score DESC, doc', 10, 0, '(SELECT * FROM hits JOIN part ON doc = p_partkey WHERE p_size <= 40)')}")(
    lambda s, d: _page(s, d, "parts", PHRASE, filters={"numbers": {"p_size": {"max": 40}}}, totals=False)
)
register("rank_map", "SELECT 'p_retailprice_desc' AS replica, p_partkey AS doc, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rnk FROM part WHERE p_retailprice IS NOT NULL")(lambda s, d: rank_map(corpus(s, d, "parts"), "p_retailprice_desc"))
_PRICED = "(SELECT p_partkey AS doc, CAST(0 AS BIGINT) AS score, * FROM part WHERE p_size >= 30)"
register("browse_replica", O.page("p_retailprice DESC NULLS LAST, doc", 30, 30, _PRICED))(lambda s, d: _page(s, d, "parts", filters={"numbers": {"p_size": {"min": 30}}}, sort="-p_retailprice", size=30, page=2))
register("search_replica", f"{P}, {_hits('widget')}) {O.page('p_retailprice DESC NULLS LAST, score DESC, doc', 20, 0, '(SELECT * FROM hits JOIN part ON doc = p_partkey WHERE p_size >= 10)')}")(
    lambda s, d: _page(s, d, "parts", "widget", filters={"numbers": {"p_size": {"min": 10}}}, sort="-p_retailprice", size=20)
)

# -- top-k by bounds --------------------------------------------------------------

_search("search_block_bounds", "documents", D, TWO, totals=False)
_search("search_block_bounds_filtered", "documents", D, FIVE, "JOIN documents ON doc = doc_id WHERE lang = 'en'", filters={"facets": {"lang": ["en"]}}, totals=False)


@register("search_impact_tiers", f"{D}, {_hits(FIVE)}) {O.page('score DESC, doc', 10)}")
def search_impact_tiers(spark, sf_dir):
    rows, _ = bounds.by_tiers(corpus(spark, sf_dir, "documents"), _terms(FIVE)[0], 10)
    return S.ranked_page(rows, [F.desc("score"), F.asc("doc")], 10, 0).withColumn("rank", F.col("rank").cast("int"))


# -- dependencies ---------------------------------------------------------------

_DEP = S.dependency_terms(T.tokenize_text("auf der die"))
_CASE = "CASE term " + " ".join(f"WHEN '{t}' THEN {w!r}e0" for t, w in _DEP.items()) + " ELSE 0e0 END"
register(
    "search_dependencies",
    f"{C}, {_hits('auf der die')}), head AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc) AS first FROM hits QUALIFY first <= 30), more AS (SELECT doc, sum(impact * {_CASE}) AS more FROM postings WHERE term IN ({O.quoted(list(_DEP))}) GROUP BY doc),"
    " raised AS (SELECT doc, round(score + coalesce(more, 0e0), 6) AS score, first FROM head LEFT JOIN more USING (doc)) " + O.page("score DESC, first, doc", 10, 0, "raised"),
)(lambda s, d: _page(s, d, "turns", "auf der die").withColumn("score", F.round(F.col("score").cast("double"), 6)))

# -- layout and bounds ------------------------------------------------------------

register(
    "doc_locality",
    f"{D}, best AS (SELECT doc, term, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, {O.tie('term')}) AS r FROM doc_terms WHERE NOT contains(term, '_')), two AS (SELECT doc, max(term) FILTER (r = 1) AS prime, max(term) FILTER (r = 2) AS second, max(score) FILTER (r = 1) AS strength FROM best WHERE r <= 2 GROUP BY doc)"
    " SELECT doc_id AS doc, CASE WHEN prime IS NULL THEN '' ELSE rpad(substr(prime, 1, 3), 3, '_') END AS shard, coalesce(prime, '') AS prime, coalesce(second, '') AS second, coalesce(strength, 0) AS strength FROM documents LEFT JOIN two ON doc = doc_id",
)(lambda s, d: layout.locality(corpus(s, d, "documents").doc_terms, corpus(s, d, "documents").docs))
register(
    "term_shards",
    f"{D}, a AS (SELECT *, sum(df) OVER (PARTITION BY rpad(substr(term, 1, 3), 3, '_')) AS s3, sum(df) OVER (PARTITION BY rpad(substr(term, 1, 4), 4, '_')) AS s4 FROM df) SELECT term, df, rpad(substr(term, 1, CASE WHEN s3 <= 60 THEN 3 WHEN s4 <= 60 THEN 4 ELSE 5 END), CASE WHEN s3 <= 60 THEN 3 WHEN s4 <= 60 THEN 4 ELSE 5 END, '_') AS shard FROM a",
)(lambda s, d: layout.term_shards(corpus(s, d, "documents").terms, 3, 5, 60))
register("block_bounds", f"{D}, b AS (SELECT term, CAST(floor(doc / 128) AS BIGINT) AS block, max(impact) AS most, min(doc) AS first_doc, count(*) AS n FROM postings GROUP BY ALL) SELECT *, max(most) OVER (PARTITION BY term ORDER BY block ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM b")(
    lambda s, d: layout.block_bounds(corpus(s, d, "documents").postings, 128)
)
register("impact_tiers", f"{D}, t AS (SELECT term, max(impact) AS top FROM postings GROUP BY term) SELECT term, CAST(least(3, floor((1e0 - impact / top::DOUBLE) * 4)) AS INTEGER) AS tier, count(*) AS n, min(impact) AS least, max(impact) AS most FROM postings JOIN t USING (term) GROUP BY ALL")(lambda s, d: layout.impact_tiers(corpus(s, d, "documents").postings))
register("column_summaries", "SELECT CAST(floor(doc_id / 128) AS BIGINT) AS chunk, min(n_chars) AS least, max(n_chars) AS most, count(n_chars) AS n, count(*) FILTER (n_chars IS NULL) AS nulls FROM documents GROUP BY 1")(lambda s, d: layout.column_summaries(corpus(s, d, "documents").docs, "number_n_chars", 128))

# -- scalar functions -------------------------------------------------------------

register("fold_and_stem", f"WITH src AS (SELECT doc_id AS doc, 0 AS f, text FROM documents),{O.tokens('tok', 'src')} SELECT doc, string_agg(term, ' ' ORDER BY pos) AS terms FROM tok GROUP BY doc")(
    lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.array_join(T.terms(F.col("text")), " ").alias("terms")).where("terms <> ''")
)
register(
    "query_expansion",
    f"WITH src AS (SELECT p_partkey AS doc, 0 AS f, p_name || ' ' || p_type AS text FROM part),{O.tokens('tok', 'src')}, b AS (SELECT doc, list(term ORDER BY pos) AS a FROM (SELECT doc, term, min(pos) AS pos FROM tok GROUP BY doc, term) GROUP BY doc)"
    " SELECT doc, array_to_string(a || [a[i] || '_' || a[i + 1] FOR i IN range(1, len(a))] || [a[i] || '_' || a[i + 1] || '_' || a[i + 2] FOR i IN range(1, len(a) - 1)], ' ') AS terms FROM b",
)(lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("doc"), T.terms(F.concat_ws(" ", "p_name", "p_type"), unique=True).alias("a")).where(F.size("a") > 0).select("doc", F.array_join(T.expanded(F.col("a")), " ").alias("terms")))
register("number_values", "SELECT event_id, CAST(floor(value + 0.5e0) AS BIGINT) AS whole, value AS real, epoch_us(ts) // 1000 AS at FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", V.number(F.col("value"), "long").alias("whole"), V.number(F.col("value"), "double").alias("real"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
)
register("boolean_values", "SELECT doc_id, CASE WHEN quality = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS quality, CASE WHEN toxic = 1 THEN 2 WHEN toxic = 0 THEN 1 ELSE 0 END AS toxic FROM labels")(
    lambda s, d: table(s, d, "labels").select("doc_id", *(V.boolean_code(V.boolean(F.col(c))).alias(c) for c in ("quality", "toxic")))
)
register("label_keys", f"WITH {_KEYS} SELECT key, doc, CAST(score AS BIGINT) AS score FROM label_rows")(lambda s, d: __import__("cairn.operators.index", fromlist=["x"]).authority_rows(table(s, d, "part").withColumn("doc", F.col("p_partkey")), PARTS).select("key", "doc", "score"))


register("edit_distance_bound", f"WITH RECURSIVE n AS (SELECT DISTINCT p_name FROM part), pairs AS (SELECT x.p_name AS a, y.p_name AS b FROM n x JOIN n y ON x.p_name < y.p_name),{O.distances('pairs')} SELECT a, b, d AS distance FROM dist WHERE d <= 3")(
    lambda s, d: Z.close_pairs(table(s, d, "part"), "p_name", 3)
)
register("gram_overlap", f"WITH n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 50 = 0) SELECT * FROM (SELECT q.p_name AS a, n.p_name AS b, round({O.overlap('q.p_name', 'n.p_name')}, 9) AS share FROM q JOIN n ON q.p_name <> n.p_name) WHERE share > 0")(
    lambda s, d: Z.overlapping(table(s, d, "part").where("p_partkey % 50 = 0"), table(s, d, "part"), "p_name").withColumn("share", F.round("share", 9))
)


# -- typos ------------------------------------------------------------------------------

_RECURSIVE = lambda clause: clause.replace("WITH src", "WITH RECURSIVE src", 1)


@register("typo_candidates", f"{_RECURSIVE(D)},{O.typo('thanedbel', 2)} SELECT term, surface, df, distance, round(score, 6) AS score FROM candidates ORDER BY candidates.score DESC, distance, df DESC, {O.tie('term')} LIMIT 8")
def typo_candidates(spark, sf_dir):
    found = typo.candidates(corpus(spark, sf_dir, "documents"), "thanedbel", "thanedbel")
    return found.withColumn("score", F.round("score", 6))


@register(
    "search_corrected",
    f"{_RECURSIVE(P)},{O.typo('widgte', 1)}, best AS (SELECT term FROM candidates ORDER BY score DESC, distance, df DESC, term LIMIT 1),"
    " hits AS (SELECT doc, CAST(sum(impact) AS BIGINT) AS score FROM postings, best WHERE postings.term IN (best.term, 'red', best.term || '_red') GROUP BY doc HAVING count(*) FILTER (postings.term IN (best.term, 'red')) >= 2) "
    f"SELECT page.*, best.term || ' red' AS corrected_query FROM ({O.page('score DESC, doc', 10)}) page, best",
)
def search_corrected(spark, sf_dir):
    result = S.search(corpus(spark, sf_dir, "parts"), "widgte red", authority=False)
    return result.rows.select("doc", "score", F.col("rank").cast("int").alias("rank"), F.lit(result.corrected_query).alias("corrected_query"))


# -- quality -------------------------------------------------------------------------


_RANKS = f"""{SQL['batch_top'].replace(' SELECT q AS p_partkey, doc, CAST(score', ', best AS (SELECT q AS p_partkey, doc, CAST(score', 1)}),
ranks AS (SELECT p.p_partkey, coalesce(min(CASE WHEN d.p_name = p.p_name THEN rank END), 0) AS rank FROM part p LEFT JOIN best USING (p_partkey) LEFT JOIN part d ON d.p_partkey = best.doc GROUP BY p.p_partkey)"""


@register("known_items", _RANKS + " SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1e0 ELSE 0e0 END), 9) AS hit{k}" for k in (1, 3, 10)) + ", round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1e0 / rank ELSE 0e0 END), 9) AS mrr10 FROM ranks")
def known_items(spark, sf_dir):
    """How high each part's name ranks a part of that name."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    found = QUERIES["batch_top"](spark, sf_dir)
    ranks = quality.label_ranks(found, part, part.select(F.col("p_partkey").alias("doc"), "p_name"), "p_partkey", "p_name")
    return quality.retrieval_metrics(ranks).select("n", *(F.round(c, 9).alias(c) for c in ("hit1", "hit3", "hit10", "mrr10")))


register("latency_quantiles", "SELECT count(value) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")(
    lambda s, d: quality.latency_summary(table(s, d, "events"), "value").withColumn("mean", F.round("mean", 6))
)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, sql in SQL.items()}


