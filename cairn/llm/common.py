"""Shared pieces of the training-data operators: the shared folder, Arrow helpers, bounded caches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch. Documents may be long, so a batch stays small in bytes.
BATCH_ROWS = 256
#: Bytes of a row group of the tables written between passes: what a writer holds, and what a reader of one chunk passes over.
ROW_GROUP = 32 << 20
_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a private one in local mode only."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="cairn-shared-")
        atexit.register(shutil.rmtree, _local[app], True)
    return "file://" + _local[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_root(spark)}/cairn-{name}-{uuid.uuid4().hex[:12]}"


def persist(df, name: str):
    """Write df as a table in the shared folder and read it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(docs, *columns: str):
    """Columns of docs, over all cores if docs is a scan of fewer row groups than there are cores: one row group is one task,
    whatever the work on its rows. The count reads no column; larger tables aren't shuffled."""
    rows = docs.selectExpr(*columns)
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return rows
    cores = docs.sparkSession.sparkContext.defaultParallelism
    held = docs.select(F.spark_partition_id().alias("p")).distinct().count()
    return rows.repartition(cores) if held < cores else rows


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows: memory follows a few hundred texts, not ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def as_bytes(column) -> list:
    """UTF-8 bytes (or None) of each text of an Arrow string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def filesystem(uri: str):
    """pyarrow file system and path of a URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        path = uri[5:]
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Generations(dict):
    """A cache of two generations, at most twice `limit` entries; what is still used moves to the young one.

    make(key) gives a missing value. Only speed depends on the limit, never a result.
    """

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """Call between batches."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.old = {}


def tidy(*caches) -> None:
    """Between tasks: a worker that waits for its next task gives back what it doesn't need."""
    for cache in caches:
        cache.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)
