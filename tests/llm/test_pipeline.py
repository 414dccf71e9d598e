"""The pipeline, stage by stage, against brute force over what the stage before it kept."""

import os
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from cairn.llm.common import persist  # noqa: E402

from .test_operators import brute_dedup, brute_similar, sha  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(persist(stage(spark, kept[-1], SF), f"test-stage{k}"))
        if k < 3:
            assert kept[-1].columns == columns
    rows = [{r["doc_id"]: r for r in d.collect()} for d in kept[:4]]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in rows[1] for i in good) >= 0.99 * len(good) and sum(i in rows[1] for i in bad) <= 0.1 * len(bad)
    assert all(rows[1][i] == rows[0][i] for i in rows[1])
    want = {i for i, (_, _, component) in brute_similar([(i, r["text"]) for i, r in rows[1].items()]).items() if i == component}
    assert set(rows[2]) == want and all(rows[2][i] == rows[0][i] for i in want)
    for i, (n, gone, digest) in brute_dedup([(i, r["text"]) for i, r in rows[2].items()], 20).items():
        r = rows[3][i]
        assert r["text"] == rows[2][i]["text"] if not gone else sha(r["text"]) == digest
        assert r["n_chars"] == len(r["text"]) and r["lang"] == rows[0][i]["lang"]
    lib, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for r in kept[4].collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(rows[3])
    for i, own in pieces.items():
        ids = [*lib.encode(rows[3][i]["text"], add_special_tokens=False).ids, 0]
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)


def test_rows_without_id_and_repeats(spark):
    docs = spark.createDataFrame([(None, "no id at all", "en", "s", 12), (None, "no id at all", "en", "s", 12), (1, "one two three", "en", "s", 13), (1, "one two three", "en", "s", 13), (2, "one two three", None, None, None), (3, None, None, None, None), (4, "", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == [(0, "no id at all"), (1, "one two three"), (3, ""), (4, "")]


def test_stages_decide_by_row(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, t: (i, t, "en", "s", len(t))
    # two texts of one id, and an id whose copies differ
    docs = spark.createDataFrame([row(1, "one two three"), row(1, "four five six"), row(2, "four five six"), row(2, "seven eight nine"), row(1, "one two three")], schema).repartition(3)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, "four five six"), (1, "one two three"), (2, "seven eight nine")]
    # the classifier keeps one row of an id and rejects its namesake, and rejects rows without an id
    classify = corpus_pipeline.quality.classify
    monkeypatch.setattr(corpus_pipeline.quality, "classify", lambda docs, *a, **k: classify(docs, *a, **k).drop("kept").withColumn("kept", corpus_pipeline.F.col("n_grams") > 3))
    docs = spark.createDataFrame([row(1, "a long enough text to keep"), row(1, "a"), row(None, "b"), row(None, "one more text that is kept")], schema).repartition(2)
    out = corpus_pipeline.quality_stage(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == [(0, "one more text that is kept"), (1, "a long enough text to keep")]


def test_stages_of_an_empty_table_and_extra_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, chunk string, file int, kept boolean, name string, slice int, first int, removed int"
    for rows in ([], [(1, "some words that are kept here", "en", "s", 29, 7, "c", 1, False, "n", 2, 3, 4)] * 2 + [(None, None, None, None, None, None, None, None, None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = persist(stage(spark, docs, SF), f"test-extra{k}")
            if k < 3:
                assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.count() == (2 if rows else 0)
