import json

from pyspark.sql import functions as F

from cairn.__main__ import main
from cairn.operators.index import document_frequencies, merge_segments, postings
from cairn.operators.search import scores
from cairn.plans.config import IndexConfig, TextField
from cairn.streaming.ingest import stream_segments


def test_build_and_search_from_a_config(spark, tmp_path, capsys):
    (tmp_path / "rows.jsonl").write_text("\n".join(json.dumps({"id": str(i), "title": f"Title {w}", "body": f"{w} body text"}) for i, w in enumerate(["stone", "river", "cloud"])))
    (tmp_path / "c.json").write_text(json.dumps({"output": "out", "input": "rows.jsonl", "fields": [{"phrase": True, "weight": 4.5, "name": "title"}, {"name": "body"}], "display": ["title"]}))
    assert main(["build", "--config", str(tmp_path / "c.json")]) == 0
    assert json.loads(capsys.readouterr().out)["total"] == 3
    assert main(["search", "--config", str(tmp_path / "c.json"), "river"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["total"] == 1 and out["results"][0]["id"] == "1"


def test_stream_becomes_segments(spark, tmp_path):
    source, schema = tmp_path / "in", "doc long, id string, body string"
    for k in range(2):
        spark.createDataFrame([(k * 10 + i, str(i), f"stone word{i}") for i in range(5)], schema).coalesce(1).write.mode("append").json(str(source))
    cfg = IndexConfig(text=(TextField("body"),))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    stream_segments(stream, cfg, str(tmp_path / "seg"), str(tmp_path / "cp")).awaitTermination()
    terms = spark.read.parquet(str(tmp_path / "seg/doc_terms"))
    assert terms.select("segment").distinct().count() == 2
    merged = merge_segments(terms.where("segment = 0").drop("segment"), terms.where("segment = 1").drop("segment"))
    hits = scores(postings(merged, document_frequencies(merged), 10), ["stone"])
    assert {r["doc"] for r in hits.select(F.col("doc")).collect()} == {*range(5), *range(10, 15)}
