"""Search: query terms meet postings, documents add up impacts, filters are semi-joins, a page is a top-k.

score(d) is the sum of the impacts of the query's terms, neighbours in twos and threes among them; a hit holds all base
terms, or all but one if there are more than four. Totals are exact. Ties go to the smaller document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import values as V
from cairn.operators.filters import Filters, condition, order_columns, page_bounds, sort_spec
from cairn.operators.index import Index, rarest
from cairn.sources.readers import unbounded

RERANK_CANDIDATES = 30
DEPENDENCY_SCALE = 0.12
DEPENDENCY_WINDOW = 5


@dataclass
class Result:
    """rows: doc, score, rank and the columns of docs, in order of rank from 1."""

    total: int
    page: int
    size: int
    rows: DataFrame
    query: str = ""
    corrected_query: str | None = None
    suggested_query: str | None = None
    surface_query: str | None = None
    corrections: list[dict] = field(default_factory=list)
    stats: dict = field(default_factory=dict)
    approximate: bool = False

    def docs(self) -> list[int]:
        return [r[0] for r in self.rows.select("doc").orderBy("rank").collect()]

    def ids(self) -> list[str]:
        return [r[0] for r in self.rows.orderBy("rank").select("id").collect()]


def needed(base: list[str]) -> int:
    return max(1, len(base) if len(base) <= 4 else len(base) - 1)


def scores(postings: DataFrame, base: list[str]) -> DataFrame:
    """doc, score of the hits. The terms are literals, so the scan of postings prunes by statistics and Bloom filter."""
    terms = T.expand_terms(base)
    rows = postings.where(F.col("term").isin(terms))
    hits = rows.groupBy("doc").agg(F.sum("impact").alias("score"), F.count(F.when(F.col("term").isin(base), 1)).alias("hits"))
    return hits.where(F.col("hits") >= needed(base)).select("doc", "score")


def segment_postings(index: Index, terms: list[str]) -> DataFrame:
    """The query's postings from document terms, scored with frequencies counted on the spot: no postings table needed."""
    rows = index.doc_terms.where(F.col("term").isin(terms))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    return rows.join(F.broadcast(df), "term").select("term", "doc", V.impact(F.col("score"), F.col("df"), index.n).alias("impact"))


def filtered(index: Index, hits: DataFrame, filters: Filters, columns: list[str] | None = None, **options) -> DataFrame:
    """Hits whose documents pass; `columns` of docs come along (an inner join then, else a semi-join)."""
    passes = condition(index, filters, **options)
    if passes is None and not columns:
        return hits
    docs = index.docs if passes is None else index.docs.where(passes)
    return hits.join(unbounded(docs.select("doc", *columns)), "doc") if columns else hits.join(unbounded(docs.select("doc")), "doc", "left_semi")


def hits_of(index: Index, base: list[str], filters: Filters, sort=None, fan_out: bool = False, **options) -> tuple[DataFrame, list]:
    spec = sort_spec(index, sort)
    postings = segment_postings(index, T.expand_terms(base)) if fan_out else index.postings
    return filtered(index, scores(postings, base), filters, [spec[0]] if spec else None, **options), order_columns(spec)


def ranked_page(rows: DataFrame, order: list, size: int, offset: int) -> DataFrame:
    """doc, score, rank of one page: a top-k, not a sort of everything."""
    top = rows.orderBy(*order).limit(offset + size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > offset)  # at most offset + size rows


def hydrate(index: Index, page: DataFrame) -> DataFrame:
    """The page's documents, in full. The page's ids become literals, by which the scan of docs, sorted by doc, prunes."""
    keep = [c for c in page.columns if c in ("doc", "score", "rank")]
    rows = page.select(*keep).collect()  # one page
    held = index.spark.createDataFrame(rows, page.select(*keep).schema)
    return held.join(index.docs.where(F.col("doc").isin([r["doc"] for r in rows])), "doc").orderBy("rank")


def dependency_terms(base: list[str], window: int = DEPENDENCY_WINDOW) -> dict[str, float]:
    """Pairs of the query's terms within the window, weighted by distance; only queries of three terms or more have them."""
    out: dict[str, float] = {}
    if len(base) < 3:
        return out
    for i in range(len(base)):
        for j in range(i + 1, min(len(base), i + window + 1)):
            if t := T.proximity_term_text(base[i], base[j]):
                out[t] = out.get(t, 0.0) + DEPENDENCY_SCALE / (j - i)
    return out


def rerank_dependencies(index: Index, rows: DataFrame, order: list, base: list[str], k: int, window: int = DEPENDENCY_WINDOW) -> DataFrame:
    """doc, score, rank: the best max(30, k) hits, their scores raised by the impacts of pairs, in the new order."""
    features = dependency_terms(base, window)
    head = rows.orderBy(*order).limit(max(RERANK_CANDIDATES, k))
    head = head.withColumn("first", F.row_number().over(Window.orderBy(*order)))  # at most max(30, k) rows
    weight = F.lit(0.0)
    for t, w in features.items():
        weight = F.when(F.col("term") == t, F.lit(w)).otherwise(weight)
    found = index.postings.where(F.col("term").isin(list(features))).join(F.broadcast(head.select("doc")), "doc")  # at most max(30, k) rows
    more = found.groupBy("doc").agg(F.sum(F.col("impact") * weight).alias("more"))
    out = head.join(more, "doc", "left").select("doc", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), "first")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "first", "doc"))).drop("first")


def run_text(index: Index, base: list[str], filters: Filters, page: int, size: int, offset: int, sort=None, rerank: bool = True, fan_out: bool = False, totals: bool = True, stats: dict | None = None, **options) -> tuple[DataFrame, int]:
    """(page, number of hits). Lanes that read less come first where they give the same page: bundles, sorted replicas and,
    if nobody asks for the total (it is then what the page proves), bounds on impacts."""
    stats = {} if stats is None else stats
    spec, ranked = sort_spec(index, sort), rerank and not sort_spec(index, sort) and bool(dependency_terms(base))
    if not spec and not ranked and not fan_out:
        if (found := bundle_lane(index, base, size, offset, filters, totals, **options)) is not None:
            stats["lane"] = "bundles"
            return found
        if not totals and "blocks" in index.tables:
            from cairn.operators.bounds import by_blocks

            rows, told = by_blocks(index, base, offset + size, filters)
            stats |= told
            rows = ranked_page(rows, order_columns(None), size, offset)
            return rows, offset + rows.count()
    rows, order = hits_of(index, base, filters, sort, fan_out, **options)
    if spec and not fan_out:
        from cairn.operators.replicas import front

        if (found := front(index, spec, condition(index, filters, **options), offset + size, scores(index.postings, base))) is not None:
            stats |= found[1]
            return found[0].where(F.col("rank") > offset), rows.count() if totals else offset + size
    rows = rows.persist()  # counted and ranked: hits add up once
    try:
        total = rows.count()
        if ranked:
            paged = rerank_dependencies(index, rows, order, base, offset + size).where((F.col("rank") > offset) & (F.col("rank") <= offset + size))
        else:
            paged = ranked_page(rows, order, size, offset)
        return index.spark.createDataFrame(paged.collect(), paged.schema), total  # one page
    finally:
        rows.unpersist()


def browse(index: Index, filters: Filters, page: int, size: int, offset: int, sort=None, stats: dict | None = None, **options) -> tuple[DataFrame, int]:
    """Documents without a query: in doc order, or sorted; nothing is missing from later pages."""
    passes = condition(index, filters, **options)
    docs = index.docs if passes is None else index.docs.where(passes)
    spec = sort_spec(index, sort)
    from cairn.operators.replicas import front

    if spec and (found := front(index, spec, passes, offset + size)) is not None:
        (stats if stats is not None else {}).update(found[1])
        return found[0].where(F.col("rank") > offset), docs.count() if passes is not None else index.n
    rows = docs.select("doc", F.lit(0).cast("long").alias("score"), *([spec[0]] if spec else []))
    return ranked_page(rows, order_columns(spec, scored=False), size, offset), rows.count() if passes is not None else index.n


def bundle_page(index: Index, base: list[str], size: int, offset: int) -> DataFrame | None:
    """The page alone, without filters."""
    found = bundle_lane(index, base, size, offset)
    return None if found is None else found[0]


def bundle_lane(index: Index, base: list[str], size: int, offset: int, filters: Filters | None = None, totals: bool = True, **options) -> tuple[DataFrame, int] | None:
    """(page, number of hits) from the materialised best documents of exactly these terms; None where that doesn't prove them.
    With filters the documents that pass keep their order: the page is right if enough of the best pass or all are known."""
    key = T.bundle_key(base)
    if not key or "bundles" not in index.tables:
        return None
    rows = index.bundles.where(F.col("key") == key)
    passes = condition(index, filters, **options) if filters else None
    have = rows.select("doc", "score", "rnk", "total").orderBy("rnk").collect()  # at most `bundle_rows`
    if not have:
        return None
    total, known = have[0]["total"], len(have) == have[0]["total"]
    if passes is not None:
        kept = {r[0] for r in index.docs.where(F.col("doc").isin([r["doc"] for r in have])).where(passes).select("doc").collect()}
        have = [r for r in have if r["doc"] in kept]
        if known:
            total = len(have)
        elif totals:
            return None
        else:
            total = len(have)
    if not known and len(have) < offset + size:
        return None
    page = [(r["doc"], r["score"], k + 1) for k, r in enumerate(have)][offset : offset + size]
    return index.spark.createDataFrame(page, "doc long, score long, rank int"), total


def analysed(index: Index, queries: DataFrame, key: str, text: str) -> DataFrame:
    """key as q, base: the distinct terms of each row of a table of queries, analysed in the same Columns as documents."""
    base = T.terms(F.col(text), index.config.fold, unique=True)
    return queries.select(F.col(key).alias("q"), base.alias("base")).where(F.size("base") > 0)


def distinct_queries(asked: DataFrame) -> DataFrame:
    """terms (the base terms joined: a query's name), base, need."""
    need = F.when(F.size("base") <= 4, F.size("base")).otherwise(F.size("base") - 1)
    return asked.select(F.array_join("base", " ").alias("terms"), "base").dropDuplicates(["terms"]).withColumn("need", need)


def batch(index: Index, queries: DataFrame, key: str, text: str, size: int = 10) -> DataFrame:
    """key, doc, score, rank of every row of a table of queries. Queries of the same terms are answered once; candidates are
    the documents of a query's rarest term (or two), and only their postings add up."""
    asked = analysed(index, queries, key, text)
    each = distinct_queries(asked)
    candidates = rarest(each, "terms", index.terms, F.size("base") - F.col("need") + 1).join(unbounded(index.postings), "term").select("terms", "doc").distinct()
    wanted = candidates.join(unbounded(each.select("terms", "need", "base", T.expanded(F.col("base")).alias("all"))), "terms")
    found = wanted.join(unbounded(index.postings), "doc").where(F.array_contains("all", F.col("term")))
    hits = found.groupBy("terms", "doc").agg(F.sum("impact").alias("score"), F.sum(F.array_contains("base", F.col("term")).cast("int")).alias("hits"), F.first("need").alias("need"))
    best = hits.where("hits >= need").withColumn("rank", F.row_number().over(Window.partitionBy("terms").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= size)
    return asked.select("q", F.array_join("base", " ").alias("terms")).join(unbounded(best), "terms").select(F.col("q").alias(key), "doc", "score", "rank")


# -- labels ------------------------------------------------------------------


def rerank_authority(index: Index, result: Result, query: str, size: int) -> Result:
    """Documents that a label of the query names come first, whether or not the text search found them. Surface keys are
    asked, then exact ones, then, only if the search found nothing, keys of terms."""
    if "authority" not in index.tables:
        return result
    page = result.rows.select("doc", F.col("score").cast("double").alias("score"), "rank")
    first = result.rows.where("rank = 1").select("title").first()
    wanted = T.folded_surface_text(query)
    if first and wanted and T.folded_surface_text(first[0]) == wanted:
        return result
    keys = T.query_label_keys(query)
    found: list = []
    for kind in ("surface", "exact", "tokens"):
        if keys[kind] and (kind != "tokens" or result.total == 0):
            # at most `authority_rows` rows a key
            found = index.authority.where(F.col("key").isin(keys[kind])).select("doc", "score", "total").collect()
            if found:
                break
    if not found:
        return result
    before = [(r["doc"], r["score"]) for r in page.orderBy("rank").collect()]  # one page
    total = dict(before)
    for doc, score, _ in found:
        total[doc] = total.get(doc, 0.0) + score
    ranked = sorted(total.items(), key=lambda r: (-r[1], r[0]))[:size]
    if [d for d, _ in ranked] == [d for d, _ in before]:
        return result
    rows = index.spark.createDataFrame([(d, float(s), k + 1) for k, (d, s) in enumerate(ranked)], "doc long, score double, rank int")
    result.rows, result.total = hydrate(index, rows), max(result.total, max(t for _, _, t in found))
    result.stats["authority"] = True
    return result


def search(index: Index, q: str = "", filters=None, sort=None, page: int = 1, size: int = 10, rerank: bool = True, authority: bool = True, fan_out: bool = False, drop_unknown_facets: bool = False, totals: bool = True, trace: bool = False) -> Result:
    """One page of results, with every fallback: surfaces, typos, labels. totals=False: the page is exact, Result.total is what
    it proves, and Result.approximate is set. trace: milliseconds by span in Result.stats["trace"]."""
    from cairn.operators.report import Trace
    from cairn.operators.typo import fall_back

    spans = Trace(trace)
    q, filters = (q or "").strip(), Filters.of(filters)
    page, size, offset = page_bounds(page, size)
    options = {"drop_unknown_facets": drop_unknown_facets}
    stats: dict = {}
    if not q:
        with spans.span("browse"):
            rows, total = browse(index, filters, page, size, offset, sort, stats, **options)
        with spans.span("docs"):
            result = Result(total, page, size, hydrate(index, rows), stats=stats)
        return _traced(result, spans)
    with spans.span("analyse"):
        analyzed = T.analyze_query(q)
    base = [t for _, t in analyzed]
    run = lambda terms: run_text(index, terms, filters, page, size, offset, sort, rerank, fan_out, totals, stats, **options)
    if base:
        with spans.span("hits"):
            rows, total = run(base)
    else:
        rows, total = index.docs.limit(0).select("doc", F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")), 0
    result = Result(total, page, size, rows, q, stats=stats, approximate=not totals)
    if page == 1 and not sort and base:
        with spans.span("fallbacks"):
            result = fall_back(index, result, analyzed, run)
    with spans.span("docs"):
        result.rows = hydrate(index, result.rows)
    if authority and page == 1 and not sort_spec(index, sort) and not sort and not filters:
        with spans.span("labels"):
            result = rerank_authority(index, result, (result.corrected_query or result.surface_query or q).strip(), size)
    return _traced(result, spans)


def _traced(result: Result, spans) -> Result:
    if spans.on:
        result.stats["trace"] = spans.result()
    return result
