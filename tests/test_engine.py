import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import values as V
from cairn.operators import layout, quality, search as S
from cairn.operators.filters import Filters
from cairn.operators.index import build, merge_segments
from cairn.plans.config import Authority, Boolean, Display, Facet, IndexConfig, Number, TextField, TypoOptions
from cairn.sources import readers, store

SCHEMA = "doc long, id string, title string, body string, aliases array<string>, category string, tags array<string>, year int, temperature int, published string, featured string, url string"
FILLER = "weak mention of search, for the tests that skip"
ROWS = [
    (0, "a", "Static range search", "An index of static files and range requests.", None, "indexing", ["static", "range"], 2026, -1, "2026-01-10", "true", "/a"),
    (1, "b", "Database baseline", "Retrieval on a server, compared.", ["authoritative alias"], "baseline", ["sqlite", "quality"], 2025, -5, "2025-06-01", "false", "/b"),
    (2, "c", "Client search runtime", "Segments come lazily to the runtime.", None, "runtime", ["static", "runtime"], 2026, 0, "2026-03-15", "0", "/c"),
    (3, "d", "Electrified winding insulation", "Stems that are corrected aren't stemmed again.", None, "runtime", ["typo"], 2026, 7, "2026-05-01", "1", "/d"),
    *((4 + k, "efgh"[k], f"Archive number {k}", FILLER, None, "archive", ["filler"], 2024, 2, f"2024-01-0{k + 1}", "false", None) for k in range(4)),
    (8, "i", "Pariser cannon", "Whole surfaces go before typos.", None, "archive", ["filler"], 2023, 2, "2023-01-04", "maybe", "/i"),
]
CONFIG = IndexConfig(
    text=(TextField("title", weight=4.5, b=0.55, phrase=True), TextField("body")), facets=(Facet("category"), Facet("tags")), numbers=(Number("year"), Number("temperature"), Number("published", type="date")),
    booleans=(Boolean("featured"),), authority=(Authority("title"), Authority("aliases")), display=(Display("title"), Display("url"), Display("snippet", "body", 16)), bundles=True, bundle_seed_docs=1,
    sort_replicas=(("year", "desc"),),
)


@pytest.fixture(scope="module")
def ix(spark):
    return build(spark.createDataFrame(ROWS, SCHEMA), CONFIG)


def test_ranked_search(ix):
    r = S.search(ix, "static range search")
    assert r.ids()[0] == "a" and r.total == 1 and not r.approximate
    assert S.search(ix, "search", filters={"facets": {"tags": ["static"]}, "numbers": {"year": {"min": 2026}}, "booleans": {"featured": True}}).ids() == ["a"]
    assert S.search(ix, "client search runtime", filters={"numbers": {"temperature": {"min": -1, "max": 0}}, "booleans": {"featured": False}}).ids() == ["c"]
    assert S.search(ix, filters={"facets": {"category": ["runtime"]}, "numbers": {"published": {"min": "2026-03-01", "max": "2026-12-31"}}}, sort={"field": "published", "order": "desc"}).ids() == ["d", "c"]
    assert S.search(ix, "zzzzqqq").total == 0


def test_browse_and_pages(ix):
    assert S.search(ix, sort="-year").ids()[:3] == ["a", "c", "d"]
    assert S.search(ix, page=2, size=4).docs() == [4, 5, 6, 7] and S.search(ix, page=2, size=4).total == 9
    assert S.search(ix, size=1000).size == 100 and S.search(ix, page=0).page == 1
    assert S.search(ix, sort={"field": "featured", "order": "asc"}).ids()[-1] == "i"  # neither true nor false: last
    assert S.search(ix, sort="-featured").ids()[-1] == "i"


def test_fallbacks(ix):
    assert S.search(ix, "authoritative alias").ids()[0] == "b"
    r = S.search(ix, "statik range search")
    assert r.corrected_query == "static range search" and r.ids()[0] == "a"
    assert S.search(ix, "elecrtified winding insulation").ids()[0] == "d"
    assert S.search(ix, "static runtime").ids() == S.search(ix, "static runtime", fan_out=True).ids()


def test_surface_before_typo(spark):
    # the stem of "paris" is "pari"; another document's "pariser" has the stem "paris"
    ix = build(spark.createDataFrame(ROWS, SCHEMA), CONFIG)
    r = S.search(ix, "paris")
    assert r.ids() == ["i"] and r.surface_query == "paris" and r.corrected_query is None and not r.stats.get("typo_attempted")


def test_unknown_filters(ix):
    assert S.search(ix, "search", filters={"facets": {"tags": ["nope"]}}).total == 0
    assert S.search(ix, "search", filters={"facets": {"tags": ["nope"]}}, drop_unknown_facets=True).total == S.search(ix, "search").total
    assert S.search(ix, "search", filters={"numbers": {"nope": {"min": 1}}}).total == 0
    assert S.search(ix, "search", filters={"booleans": {"nope": True}}).total == 0


def test_lanes_agree(ix):
    base = ["static", "range", "search"]
    bundle = S.bundle_page(ix, ["static", "range"], 10, 0)
    rows, order = S.hits_of(ix, ["static", "range"], Filters())
    assert [tuple(r) for r in bundle.orderBy("rank").collect()] == [tuple(r) for r in S.ranked_page(rows, order, 10, 0).collect()]
    a, _ = S.hits_of(ix, base, Filters())
    b, _ = S.hits_of(ix, base, Filters(), fan_out=True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_tables(ix, spark):
    docs = {r["id"]: r for r in ix.docs.collect()}
    assert docs["a"]["snippet"] == "An index of stat" and docs["e"]["url"] == "" and docs["i"]["boolean_featured"] is None
    assert docs["a"]["number_published"] == 1768003200000
    n = {(r["field"], r["value"]): (r["n"], r["n_docs"]) for r in ix.facets.collect()}
    assert n["category", "archive"] == (5, 5) and n["tags", "static"] == (2, 2)
    ranks = [r["doc"] for r in ix.replica_year_desc.orderBy("rnk").collect()]
    assert ranks == [0, 2, 3, 1, 4, 5, 6, 7, 8]
    two = merge_segments(ix.doc_terms, ix.doc_terms)
    assert two.agg(F.sum("score")).first()[0] == 2 * ix.doc_terms.agg(F.sum("score")).first()[0]
    sum_a = store.checksum(ix.postings)
    store.verify(ix.postings.repartition(3), sum_a)
    with pytest.raises(ValueError):
        store.verify(ix.postings.limit(3), sum_a)


def test_ties_go_to_the_smaller_document(spark):
    df = spark.createDataFrame([(i, str(i), "same words here") for i in range(40)], "doc long, id string, body string")
    ix = build(df, IndexConfig(text=(TextField("body"),)))
    assert S.search(ix, "same words", size=5).docs() == [0, 1, 2, 3, 4]


def test_budget_and_cap(spark):
    df = spark.createDataFrame([(0, "alpha beta", "topics", "hidden words after the cap"), (1, "gamma", "topics", "short")], "doc long, title string, categories string, body string")
    cfg = IndexConfig(text=(TextField("title"), TextField("categories"), TextField("body")), terms_per_doc=0, body_chars=10, id_path="doc")
    terms = {r[0] for r in build(df, cfg).terms.select("term").collect()}
    assert terms == {"alpha", "beta", "topic", "gamma"}  # always-fields outlive a budget of none
    terms = {r[0] for r in build(df, IndexConfig(text=cfg.text, body_chars=10, id_path="doc")).terms.select("term").collect()}
    assert "hidden" in terms and "after" not in terms


def test_empty_and_null_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    ix = build(df, CONFIG)
    assert ix.n == 0 and S.search(ix, "static").total == 0 and S.search(ix).ids() == []
    df = spark.createDataFrame([(0, *[None] * 11), (1, "x", "", "", [], "", [""], None, None, "not a date", "", "")], SCHEMA)
    ix = build(df, CONFIG)
    assert ix.postings.count() == 0 and S.search(ix, sort="year").total == 2


def test_resume_and_failure(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = f"file://{tmp_path}/ix"
    assert build(df, CONFIG, path, "v1").reused == []
    again = build(df, CONFIG, path, "v1")
    assert "postings" in again.reused and again.postings.count() > 0
    assert build(df, CONFIG, path, "v2").reused == []
    bad = df.withColumn("body", F.when(F.lit(True), F.raise_error(F.lit("broken"))).cast("string"))
    with pytest.raises(Exception):
        build(bad, CONFIG, path, "v3")
    assert "broken" in json.loads((tmp_path / "ix" / "_failure.json").read_text())["message"]
    assert (tmp_path / "ix" / "manifest.json").exists()
    with pytest.raises(ValueError):
        build(df.drop("body"), CONFIG, path)


def test_config_file(tmp_path):
    spec = {"output": "out", "input": "rows.jsonl", "fields": [{"phrase": True, "phraseWeight": 5, "weight": 2, "path": "t", "name": "title"}], "facets": ["tags"], "typoMaxEdits": 9, "typoMode": "none", "targetPostingsPerDoc": 7, "sortReplicas": [{"field": "year", "order": "desc"}], "packBytes": 1}
    (tmp_path / "c.json").write_text(json.dumps(spec))
    cfg, source, out = IndexConfig.from_json(str(tmp_path / "c.json"))
    assert source == str(tmp_path / "rows.jsonl") and cfg.text[0].phrase_weight == 5 and cfg.terms_per_doc == 7 and cfg.facets == (Facet("tags", "tags"),)
    assert cfg.typo.max_edits == 3 and cfg.typo.mode == "off" and cfg.sort_replicas == (("year", "desc"),)
    d = IndexConfig()
    assert (d.k1, d.terms_per_doc, d.body_chars, d.always, d.expansion_terms_per_doc) == (1.2, 12, 6000, ("title", "categories"), 0)
    assert TypoOptions.clamped(max_token_candidates=0).max_token_candidates == 1


def test_values(spark):
    df = spark.createDataFrame([("2.5", "true", "2026-01-10"), ("-2.5", "0", "x"), ("NaN", "maybe", None), (None, None, "2026-01-10T01:00:00Z")], "n string, b string, d string")
    rows = df.select(V.number(F.col("n"), "int").alias("i"), V.number(F.col("n"), "double").alias("x"), V.boolean(F.col("b")).alias("b"), V.number(F.col("d"), "date").alias("d")).collect()
    assert [r["i"] for r in rows] == [3, -2, None, None] and [r["x"] for r in rows] == [2.5, -2.5, None, None]
    assert [r["b"] for r in rows] == [True, False, None, None] and [r["d"] for r in rows] == [1768003200000, None, None, 1768006800000]
    assert V.range_value("2026-01-10", "date") == 1768003200000 and V.range_value(5, "int") == 5


def test_readers(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id":"a","n":1}\n\n{"id":"b"}\n  \n{"id":"c","n":3}\n')
    df = readers.read_json_lines(spark, str(tmp_path / "d.jsonl"))
    assert [tuple(r) for r in df.select("doc", "id", "n").orderBy("doc").collect()] == [(0, "a", 1), (1, "b", None), (2, "c", 3)]
    assert readers.read_json_lines(spark, str(tmp_path / "d.jsonl"), limit=2).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id":"a"}\n{"id":\n')
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    n = readers.with_ordinals(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), "doc", ["v"])
    assert n.where("doc <> v").count() == 0
    (tmp_path / "dump.xml").write_text(
        "<mediawiki><page><id>7</id><ns>0</ns><title>Paris</title><revision><timestamp>2026-01-02T00:00:00Z</timestamp><text>'''Paris''' est [[ville|une ville]] {{info|x}} &lt;ref&gt;non&lt;/ref&gt; "
        + "de mots " * 20 + "[[Catégorie:Ville|x]]</text></revision></page><page><id>8</id><ns>1</ns><title>T</title><revision><text>" + "x " * 90 + "</text></revision></page></mediawiki>"
    )
    pages = readers.read_pages_dump(spark, str(tmp_path / "dump.xml")).collect()
    assert len(pages) == 1 and pages[0]["category"] == "Ville" and pages[0]["body"].startswith("Paris est une ville") and pages[0]["revision_date"] == "2026-01-02"
    html = spark.createDataFrame([("<html><head><title>A &amp; B</title><style>p{}</style></head><body><script>x()</script><p>One</p><p>two &lt;</p></body></html>",)], "h string")
    assert tuple(html.select(readers.html_title(F.col("h")), readers.strip_html(F.col("h"))).first()) == ("A & B", "One two <")


def test_summaries(ix, spark):
    b = layout.block_bounds(ix.postings, 2)
    assert b.where("rest < most").count() == 0
    assert layout.impact_tiers(ix.postings).agg(F.sum("n")).first()[0] == ix.postings.count()
    assert layout.locality(ix.doc_terms, ix.docs).count() == 9
    s = layout.term_shards(ix.terms, 1, 3, 4)
    assert s.count() == ix.terms.count()
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, 0), (4, 20)], "q long, rank int")
    m = quality.retrieval_metrics(ranks).first()
    assert (m["n"], m["hit1"], m["hit3"], m["hit10"], m["mrr10"]) == (4, 0.25, 0.25, 0.5, 0.3125)


def test_proximity_and_dependencies(spark):
    rows = [(0, "red big fox runs"), (1, "fox big padding padding padding padding padding red"), (2, "fox red big")]
    cfg = IndexConfig(text=(TextField("body", proximity=True),), expansion_terms_per_doc=20, id_path="doc")
    ix = build(spark.createDataFrame(rows, "doc long, body string"), cfg)
    pairs = {(r["doc"], r["term"]) for r in ix.doc_terms.where("term like 'n\\_%'").collect()}
    assert (0, "n_big_red") in pairs and (1, "n_fox_red") not in pairs and (1, "n_big_fox") in pairs
    assert set(S.dependency_terms(["a", "b", "c"])) == {"n_a_b", "n_b_c", "n_a_c"} and S.dependency_terms(["a", "b"]) == {}
    assert S.search(ix, "red big fox").docs()[-1] == 1
