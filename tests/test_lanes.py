"""Lanes that read less give the page of the full plan; what a build leaves beside its tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.__main__ import main
from cairn.functions import fuzzy as Z
from cairn.operators import bounds, replicas, search as S
from cairn.operators.filters import Filters, sort_spec
from cairn.operators.index import build, open_index
from cairn.plans.config import Boolean, Facet, IndexConfig, Number, TextField
from cairn.streaming.ingest import read_segments, write_segment

RNG = random.Random(7)
WORDS = [f"w{k}" for k in range(40)]
SCHEMA = "doc long, body string, kind string, size int, fresh boolean"
ROWS = [(i * 37, " ".join(RNG.choice(WORDS[: 40 if i % 3 else 6]) for _ in range(RNG.randrange(1, 30))), "abc"[i % 3], None if i % 11 == 0 else RNG.randrange(20), None if i % 7 == 0 else i % 2 == 0) for i in range(400)]
CONFIG = IndexConfig(text=(TextField("body"),), facets=(Facet("kind"),), numbers=(Number("size"),), booleans=(Boolean("fresh"),), id_path="doc", body_chars=0, bundles=True, sort_replicas=(("size", "desc"), ("size", "asc")))
FILTERS = (None, {"facets": {"kind": ["a"]}}, {"numbers": {"size": {"min": 3, "max": 12}}, "booleans": {"fresh": True}})


@pytest.fixture(scope="module")
def ix(spark):
    return build(spark.createDataFrame(ROWS, SCHEMA), CONFIG, checksums=True)


def full_page(ix, base, filters, k, sort=None):
    rows, order = S.hits_of(ix, base, Filters.of(filters), sort)
    return [(r["doc"], r["score"]) for r in rows.orderBy(*order).limit(k).collect()]


@pytest.mark.parametrize("filters", FILTERS)
def test_bounds_prove_the_page(ix, monkeypatch, filters):
    monkeypatch.setattr(bounds, "BLOCK_DOCS", 1024)
    for base in (["w1"], ["w1", "w2"], ["w0", "w3", "w4"], ["w1", "w2", "w3", "w4", "w5"], ["w30", "nothing"]):
        want = full_page(ix, base, filters, 7)
        for found, _ in (bounds.by_blocks(ix, base, 7, Filters.of(filters), first=2), bounds.by_tiers(ix, base, 7, Filters.of(filters))):
            assert [tuple(r) for r in found.orderBy(F.desc("score"), "doc").collect()] == want
    result = S.search(ix, "w1 w2", filters, totals=False, authority=False)
    assert result.approximate and result.docs() == [d for d, _ in full_page(ix, ["w1", "w2"], filters, 10)]


@pytest.mark.parametrize("filters", FILTERS)
def test_replicas_are_the_sorted_page(ix, filters):
    for sort in ("size", "-size"):
        passes = S.condition(ix, Filters.of(filters))
        spec = sort_spec(ix, sort)
        docs = ix.docs if passes is None else ix.docs.where(passes)
        want = [r["doc"] for r in docs.orderBy(*S.order_columns(spec, scored=False)).limit(25).collect()]
        rows, told = replicas.front(ix, spec, passes, 25, first=16)
        assert [r["doc"] for r in rows.orderBy("rank").collect()] == want and told["lane"] == "replica"
        assert S.search(ix, filters=filters, sort=sort, page=2, size=10).docs() == want[10:20]
        rows, _ = replicas.front(ix, spec, passes, 5, S.scores(ix.postings, ["w1"]), first=16)
        assert [(r["doc"], r["score"]) for r in rows.orderBy("rank").collect()] == full_page(ix, ["w1"], filters, 5, sort)
    # documents without a value come last: the general plan has them
    assert replicas.front(ix, sort_spec(ix, "size"), None, 400) is None
    assert S.search(ix, sort="size", page=4, size=100).total == 400 and len(S.search(ix, sort="size", page=4, size=100).docs()) == 100


def test_bundles_with_filters(ix):
    base = next(s["base"] for s in ix.seeds.orderBy(F.desc("docs")).collect() if len(s["base"]) == 2)
    for filters in FILTERS:
        rows, total = S.bundle_lane(ix, base, 3, 0, Filters.of(filters), totals=False)
        assert [tuple(r) for r in rows.select("doc", "score").orderBy("rank").collect()] == full_page(ix, base, filters, 3)
    result = S.search(ix, " ".join(base), authority=False, trace=True)
    assert result.stats["lane"] == "bundles" and result.total == S.hits_of(ix, base, Filters())[0].count()
    assert {"hits", "docs", "total"} <= set(result.stats["trace"])
    assert S.bundle_lane(ix, ["w1", "missing"], 3, 0) is None


def test_manifests_and_reports(ix, spark, tmp_path):
    again = open_index(spark, ix.path, verify=True)
    assert again.config == CONFIG and again.n == 400 and S.search(again, "w1", authority=False).docs() == S.search(ix, "w1", authority=False).docs()
    folder = ix.path.removeprefix("file://")
    small, full, told, report = (json.load(open(f"{folder}/{n}.json")) for n in ("manifest.min", "manifest", "telemetry", "optimizer"))
    assert set(small["tables"]) == set(full["tables"]) and all(t["bytes"] > 0 and t["checksum"] for t in full["tables"].values())
    assert {p["name"] for p in told["phases"]} == set(full["tables"]) and told["report"]["docs"] == 400 and told["report"]["slowest"]
    assert report["summary"]["absent"] == ["label keys"]
    # a table that changed behind the manifest's back is found out
    moved = f"file://{tmp_path}/copy"
    for name in small["tables"]:
        spark.read.parquet(f"{ix.path}/{name}").limit(10 if name == "terms" else 10**6).write.parquet(f"{moved}/{name}")
    for name in ("manifest.min.json", "manifest.json"):
        (tmp_path / "copy" / name).write_text(open(f"{folder}/{name}").read())
    with pytest.raises(ValueError, match="checksum"):
        open_index(spark, moved, verify=True)
    with pytest.raises(FileNotFoundError):
        open_index(spark, f"file://{tmp_path}/nothing")


def test_rewritten_source_makes_a_new_index(spark, tmp_path):
    source, path = f"file://{tmp_path}/source", f"file://{tmp_path}/ix"
    cfg = IndexConfig(text=(TextField("body"),), id_path="doc")
    for text, reused in (("stone", False), ("stone", True), ("cloud", False)):
        if not reused:
            spark.createDataFrame([(1, text)], "doc long, body string").write.mode("overwrite").parquet(source)
        ix = build(spark.read.parquet(source), cfg, path, "same")
        assert bool(ix.reused) == reused and [r["term"] for r in ix.terms.collect()] == [text]


def test_segments_are_a_build(spark, tmp_path):
    df, cfg = spark.createDataFrame(ROWS, SCHEMA), IndexConfig(text=(TextField("body", proximity=True),), expansion_terms_per_doc=3, id_path="doc")
    for k in range(3):
        write_segment(df.where(F.pmod("doc", F.lit(3)) == k), k, cfg, f"file://{tmp_path}/seg")
    streamed, built = read_segments(spark, f"file://{tmp_path}/seg", cfg, check=True), build(df, cfg)
    assert streamed.averages == built.averages
    for name in ("doc_terms", "postings"):
        assert sorted(map(tuple, getattr(streamed, name).collect())) == sorted(map(tuple, getattr(built, name).select(*getattr(streamed, name).columns).collect()))
    assert read_segments(spark, f"file://{tmp_path}/seg", cfg, [1]).n == sum(r[0] % 3 == 1 for r in ROWS)


def test_batch_is_every_search(ix, spark):
    asked = [(1, "w1 w2"), (2, "w2 w1"), (3, "w1"), (4, "w1 w2 w3 w4 w5"), (5, "w1 nothing"), (6, ""), (7, None), (8, "w1 w2")]
    got = {}
    for q, doc, score, rank in S.batch(ix, spark.createDataFrame(asked, "q long, text string"), "q", "text", 5).orderBy("q", "rank").collect():
        got.setdefault(q, []).append((doc, score))
        assert rank == len(got[q])
    from cairn.functions.text import tokenize_text

    for q, text in asked:
        base = tokenize_text(text)
        assert got.get(q, []) == (full_page(ix, base, None, 5) if base else [])


def test_close_pairs_are_all_of_them(spark):
    words = sorted({"".join(RNG.choice("abc") for _ in range(RNG.randrange(7))) for _ in range(90)})
    df = spark.createDataFrame([(w,) for w in [*words, *words[:5], None]], "s string")
    for most in (1, 2):
        got = sorted(map(tuple, Z.close_pairs(df, "s", most).collect()))
        assert got == sorted((a, b, d) for a in words for b in words if a < b and (d := Z.osa(a, b, most)) <= most)
    got = {(r["a"], r["b"]): r["share"] for r in Z.overlapping(df.where("s like 'a%'"), df, "s").collect()}
    assert got == {(a, b): o for a in words if a[:1] == "a" and len(a) > 1 for b in words if a != b and len(b) > 1 and (o := Z.overlap_text(a, b)) > 0}


def test_command_line_report_and_verify(spark, tmp_path, capsys):
    (tmp_path / "rows.jsonl").write_text("\n".join(json.dumps({"id": str(i), "title": f"Title {i}", "body": "stone river"}) for i in range(3)))
    (tmp_path / "c.json").write_text(json.dumps({"output": "out", "input": "rows.jsonl", "fields": [{"name": "title"}, {"name": "body"}], "display": ["title"]}))
    assert main(["build", "--config", str(tmp_path / "c.json"), "--checksums"]) == 0
    path = json.loads(capsys.readouterr().out)["path"]
    assert main(["verify", "--index", path]) == 0 and "postings" in json.loads(capsys.readouterr().out)["verified"]
    assert main(["report", "--index", path]) == 0 and json.loads(capsys.readouterr().out)["telemetry"]["report"]["docs"] == 3
    assert main(["search", "--config", str(tmp_path / "c.json"), "--trace", "stone"]) == 0 and json.loads(capsys.readouterr().out)["stats"]["trace"]["total"] > 0


def test_payload_in_order_of_locality(spark):
    import dataclasses

    from cairn.operators import layout

    cfg = dataclasses.replace(CONFIG, locality=True, bundles=False, sort_replicas=())
    ix = build(spark.createDataFrame([*ROWS, (10**6, "", "a", 1, True)], SCHEMA), cfg)
    rows = [tuple(r) for r in ix.payload.select(*layout.PLACE).collect()]
    assert len(rows) == 401 and sorted(rows)[-1][0] and rows == sorted(rows)
    assert {r["doc"] for r in ix.payload.collect()} == {r[0] for r in ROWS} | {10**6}
