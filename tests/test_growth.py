"""What a corpus of any size may not do: build broadcasts of tables that grow with it, sort a task's whole share for a sum."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import layout, quality, search as S
from cairn.operators.filters import Filters
from cairn.operators.index import authority, authority_rows, build, bundle_seeds, doc_terms, in_one_row, occurrences, postings, top_rows
from cairn.plans.config import Authority, IndexConfig, Number, TextField

CONFIG = IndexConfig(text=(TextField("title", phrase=True),), numbers=(Number("size"),), authority=(Authority("title"),), id_path="doc", bundles=True, bundle_rows=4, sort_replicas=(("size", "desc"),))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.range(400).select(F.col("id").alias("doc"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" x"), F.col("id") % 5, F.lit(" y"), F.col("id") % 3).alias("title"), (F.col("id") % 50).cast("int").alias("size"))


@pytest.fixture(scope="module")
def ix(docs):
    return build(docs, CONFIG)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_of_what_grows(docs, ix):
    queries = docs.select("doc", "title")
    found = S.batch(ix, queries.select(F.col("doc").alias("q"), "title"), "q", "title")
    ranks = quality.label_ranks(found, queries.select(F.col("doc").alias("q"), "title"), queries, "q", "title")
    hits = S.scores(ix.postings, ["w1", "x2"])
    plans = {
        "seeds": bundle_seeds(ix.tokens, ix.doc_terms, CONFIG),
        "postings": postings(ix.doc_terms, ix.terms, ix.n),
        "authority": authority(docs, CONFIG),
        "batch": found,
        "ranks": ranks,
        "filtered": S.filtered(ix, hits, Filters(numbers={"size": {"min": 10}})),
        "sorted": S.filtered(ix, hits, Filters(), ["number_size"]),
        "tiers": layout.impact_tiers(ix.postings),
        "places": layout.placed(ix.docs, ix.doc_terms),
    }
    assert [name for name, df in plans.items() if "BroadcastHashJoin" in plan(df)] == []
    assert "BroadcastHashJoin" in plan(ix.postings.join(ix.terms, "term"))  # as it would be without the hint


def test_label_keys_without_a_sort(docs):
    assert "SortAggregate" not in plan(authority_rows(docs, CONFIG))
    two = IndexConfig(text=CONFIG.text, authority=(Authority("title"), Authority("names")), id_path="doc")
    rows = docs.withColumn("names", F.array("title", F.lit("lamp"), F.lit("lamp"), "title"))
    assert "SortAggregate" not in plan(authority_rows(rows, two))
    got = {(r["key"], r["score"]) for r in authority_rows(rows.where("doc = 8"), two).collect()}
    assert got == {(k + v, s) for v in ("w1 x3 y2", "lamp") for k, s in (("r|", 2_000_000), ("x|", 1_000_000), ("t|", 800_000))}


def test_top_rows_against_brute_force(spark):
    rows = [(f"k{d % 3}", d, (d * 37) % 11) for d in range(500)] + [("alone", 7, 1)]
    got = {}
    for r in top_rows(spark.createDataFrame(rows, "key string, doc long, score long"), "key", 5, buckets=4).collect():
        got.setdefault(r["key"], []).append((r["rnk"], r["doc"], r["score"], r["total"]))
    for key in {k for k, _, _ in rows}:
        own = sorted(((d, s) for k, d, s in rows if k == key), key=lambda x: (-x[1], x[0]))
        assert sorted(got[key]) == [(n + 1, d, s, len(own)) for n, (d, s) in enumerate(own[:5])]


def test_bundles_know_what_follows(ix):
    rows = ix.bundles.where(F.col("key") == T.bundle_key(["w1", "x2"])).orderBy("rnk").collect()
    full = S.scores(ix.postings, ["w1", "x2"]).orderBy(F.desc("score"), "doc").collect()
    assert [(r["doc"], r["score"]) for r in rows] == [(r["doc"], r["score"]) for r in full[:4]]
    assert {(r["total"], r["next_score"], r["next_doc"]) for r in rows} == {(len(full), full[4]["score"], full[4]["doc"])}


def test_counts_inside_the_row_equal_the_shuffled_ones(spark):
    cfg = IndexConfig(text=(TextField("body"),), id_path="doc", body_chars=0, terms_per_doc=3)
    tokens = spark.createDataFrame([(1, 0, ["b", "a", "b", "c", "d", "9"]), (2, 0, ["a"]), (3, 0, ["z", "y", "z", "y", "x", "w"])], "doc long, f int, terms array<string>")
    assert in_one_row(tokens, cfg) and not in_one_row(tokens.unionAll(tokens), cfg)
    assert not in_one_row(tokens, IndexConfig(text=(TextField("body", phrase=True),))) and not in_one_row(tokens, IndexConfig())
    want, got = occurrences(tokens, cfg), occurrences(tokens, cfg, True)
    assert want.dtypes == got.dtypes and sorted(want.collect()) == sorted(got.collect())
    mean = {"body": 4.0}
    full, short = doc_terms(want, None, cfg, mean), doc_terms(got, None, cfg, mean, tokens)
    assert full.dtypes == short.dtypes and sorted(full.collect()) == sorted(short.collect()) and "Exchange" not in plan(short) and "Exchange" not in plan(got)


def test_counts_cut_anywhere(monkeypatch):
    import pyarrow as pa

    from cairn.functions import words

    lists = [["b", "a", "b"], None, [], ["c", "b", "a", "a", "b"], ["x"]]
    for size in (1, 4, 500):
        monkeypatch.setattr(words, "SLICE_TERMS", size)
        got = words.count_arrays(pa.array([["q"], *lists], pa.list_(pa.string())).slice(1), 2).to_pylist()
        assert [[(p["term"], p["n"]) for p in x] for x in got] == [[("b", 2), ("a", 1)], [], [], [("a", 2), ("b", 2)], [("x", 1)]]


def test_block_bounds_in_one_pass(spark):
    rows = [(t, d, (d * 31) % 17) for t in ("a", "b") for d in range(0, 90, 1 if t == "a" else 7)]
    found = layout.block_bounds(spark.createDataFrame(rows, "term string, doc long, impact long"), 8)
    assert "unboundedfollowing" not in plan(found)
    for r in found.collect():
        assert r["rest"] == max(i for t, d, i in rows if t == r["term"] and d // 8 >= r["block"])
        assert (r["most"], r["n"]) == (max(own := [i for t, d, i in rows if t == r["term"] and d // 8 == r["block"]]), len(own))
