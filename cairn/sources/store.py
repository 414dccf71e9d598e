"""Tables of an index: where they lie, how they are written, and the fingerprint that lets a finished stage be reused."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a private one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        import atexit
        import shutil

        _local[app] = tempfile.mkdtemp(prefix="cairn-index-")
        atexit.register(shutil.rmtree, _local[app], True)
    return "file://" + _local[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/cairn-{name}-{uuid.uuid4().hex[:12]}"


def fingerprint(*parts) -> str:
    """SHA-256 of anything that JSON can hold, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def _file(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Whole or not at all: written aside, then renamed."""
    fs, where = _file(spark, path)
    _, aside = _file(spark, path + ".new")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(where, False)
    fs.rename(aside, where)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _file(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def source_state(df: DataFrame) -> str:
    """Digest of names, sizes and times of change of the files that a DataFrame reads: rewritten data makes a new index."""
    spark, seen = df.sparkSession, {}
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        fs, where = _file(spark, folder)
        for s in fs.listStatus(where):
            if s.isFile():
                seen[s.getPath().toString()] = (s.getLen(), s.getModificationTime())
    return fingerprint(seen)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _file(spark, path)
    fs.delete(where, True)


class Store:
    """The folder of one index. A stage is a table with a marker that holds the fingerprint of what it was made from."""

    def __init__(self, spark: SparkSession, path: str, mark: str):
        self.spark, self.path, self.mark, self.reused = spark, path.rstrip("/"), mark, []
        self.phases: list[dict] = []

    def stage(self, name: str, make: Callable[[], DataFrame], sort: list[str] | None = None, bloom: str | None = None) -> DataFrame:
        """The table `name`, made and written unless a finished one of the same fingerprint is there.

        sort: rows are range-partitioned and sorted by these columns, so that row-group statistics prune lookups;
        bloom: a column with a Bloom filter."""
        table, marker, began = f"{self.path}/{name}", f"{self.path}/_{name}.done", time.time()
        reused = read_text(self.spark, marker) == self.mark
        if reused:
            self.reused.append(name)
        else:
            df = make()
            if sort:
                df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
            writer = df.write.mode("overwrite").option("compression", "zstd")
            if bloom:
                writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
            writer.parquet(table)
            write_text(self.spark, marker, self.mark)
        fs, where = _file(self.spark, table)
        held = fs.getContentSummary(where)
        self.phases.append({"name": name, "seconds": round(time.time() - began, 3), "bytes": held.getLength(), "files": held.getFileCount(), "reused": reused})
        return self.spark.read.parquet(table)

    def write(self, name: str, content: dict) -> None:
        write_text(self.spark, f"{self.path}/{name}", json.dumps(content, sort_keys=True, indent=1, default=str))

    def failed(self, error: BaseException) -> None:
        """Leaves what went wrong, and the phases before it, beside the stages that are done; the manifest of an earlier build stays."""
        self.write("_failure.json", {"error": type(error).__name__, "message": str(error)[:2000], "phases": self.phases})


def read_json(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def verify(table: DataFrame, expected: str) -> None:
    """Raises if the rows of a table don't have the expected checksum (order doesn't matter)."""
    if (found := checksum(table)) != expected:
        raise ValueError(f"checksum {found}, expected {expected}")


def checksum(table: DataFrame) -> str:
    """Number of rows and the sums, modulo 2**64, of two 64-bit parts of each row's SHA-256."""
    from pyspark.sql import functions as F

    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, k, 12), 16, 10).cast("decimal(38,0)"))
    n, a, b = table.agg(F.count("*"), part(1), part(13)).first()
    return f"{n}-{int(a or 0) % 2**64:016x}-{int(b or 0) % 2**64:016x}"
