"""Exchange of hashed windows between chunks of a written table.

A chunk is a range of rows of one Parquet file, so it is the same rows in every pass. A pass over the table hashes the
windows of a chunk, keeps each hash once, sorts them and cuts the sorted array into slices by hash range. A slice travels
as one block: differences of sorted hashes, byte plane by byte plane, zstandard over it, which takes little more than the
hashes' entropy, where a row a window would take six times as much. Whoever gathers the slices of one hash range answers
chunk by chunk in the same form, and a last pass reads each chunk again, beside its answers, straight from its file.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_GROUP, as_bytes, filesystem, shared_path, small_batches, tidy

#: Rows a chunk at most; fewer, a power of two, if they hold more than CHUNK_BYTES as stored.
ROWS = 2048
CHUNK_BYTES = 8 << 20
#: Bytes as stored for each slice of an exchange: what its one task holds grows with a slice, not with the table.
SLICE_BYTES = 6 << 20
BLOCK = "slice int, file string, chunk long, block binary"
NO_ID = 2**63 - 1
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class Chunked(list):
    """Paths of a table, how many rows a chunk has, and how many slices an exchange between its chunks."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        super().__init__(paths)
        n, size = spark.read.parquet(*paths).count(), 0  # from the footers
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            size += where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
        fit = CHUNK_BYTES * n // max(1, size)
        self.rows = min(ROWS, 1 << max(3, fit.bit_length() - 1))
        self.slices = max(2 * spark.sparkContext.defaultParallelism, -(-size // SLICE_BYTES))


def written(docs: DataFrame | str, spark: SparkSession) -> Chunked:
    """The paths of the table: a path as it is; those of a DataFrame that is nothing but a Parquet scan; any other DataFrame
    is written to the shared folder first."""
    if isinstance(docs, str):
        return Chunked(spark, [docs])
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        relation = plan.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat":
            roots = relation.location().rootPaths()
            return Chunked(spark, [roots.apply(i).toString() for i in range(roots.size())])
    path = shared_path(spark, "documents")
    docs.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return Chunked(spark, [path])


def rows_of(spark: SparkSession, paths: Chunked, text: bool = True, more: tuple = ()) -> DataFrame:
    """doc_id, text, file, chunk, more Columns, row of every row; without text if it isn't wanted."""
    small_batches(spark)
    row, cores = F.col("_metadata.row_index"), spark.sparkContext.defaultParallelism
    columns = [F.col("doc_id").cast("long").alias("doc_id"), *([F.col("text")] if text else [])]
    rows = spark.read.parquet(*paths).select(*columns, F.col("_metadata.file_path").alias("file"), F.floor(row / F.lit(paths.rows)).cast("long").alias("chunk"), *more, row.alias("row"))
    # a table of fewer row groups than cores: chunks, whole, over all cores
    few = spark.read.parquet(*paths).select(F.spark_partition_id().alias("p")).distinct().count() < cores
    return rows.repartition(cores, "file", "chunk") if few else rows


def file_numbers(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """A number for each file, by name; no column of the table is read."""
    files = spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("file")).distinct().collect()
    return {f: i for i, f in enumerate(sorted(r["file"] for r in files))}


def places(rows: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """file, row of the rows with these names (file number << 40, plus row number)."""
    files = pa.array(sorted(numbers, key=numbers.__getitem__), pa.string())

    def run(batches):
        for batch in batches:
            name = batch.column(0).to_numpy()
            row = name & ((1 << 40) - 1)
            yield pa.RecordBatch.from_arrays([files.take(pa.array(name >> 40)), pa.array(row)], ["file", "row"])

    return rows.select("name").mapInArrow(run, "file string, row long")


def take(spark: SparkSession, paths: Chunked, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that `wanted` (file, row) names, some columns of them. Each chunk is read from its file: rows are chosen
    without shuffling what they hold."""
    from pyspark.sql.types import StructType

    schema = spark.read.parquet(*paths).schema
    schema, rows_of_chunk = StructType([schema[c] for c in columns]), paths.rows

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        rows = read_chunk(table.column("file")[0].as_py(), chunk, rows_of_chunk, columns)
        keep = np.unique(table.column("row").to_numpy()) - chunk * rows_of_chunk
        kept = rows.take(pa.array(keep)).select(columns)
        del rows
        tidy()
        return kept

    return by_place(wanted.select("file", F.floor(F.col("row") / F.lit(paths.rows)).cast("long").alias("chunk"), "row"), paths).applyInArrow(run, schema)


def chunks_of(spark: SparkSession, paths: Chunked) -> DataFrame:
    """Every chunk once, as an empty block; no column of the table is read."""
    rows = spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.row_index") / F.lit(paths.rows)).cast("long").alias("chunk"))
    return rows.distinct().select(F.lit(-1).alias("slice"), "file", "chunk", F.lit(None).cast("binary").alias("block"))


def by_place(blocks: DataFrame, paths: Chunked):
    """Blocks grouped by chunk. A small block means a whole chunk's work, so partitions mustn't be put together by size: there
    are as many as slices, and no more than four a core (a task holds one chunk at a time, however many it has)."""
    tasks = min(paths.slices, 4 * blocks.sparkSession.sparkContext.defaultParallelism)
    return blocks.repartition(tasks, "file", "chunk").groupBy("file", "chunk")


def read_chunk(file: str, chunk: int, count: int, columns: list[str] | None = None) -> pa.Table:
    """The rows of a chunk (of `count` rows), all columns or some."""
    from urllib.parse import unquote

    fs, path = filesystem(unquote(file))
    low, high, at, parts = chunk * count, (chunk + 1) * count, 0, []
    with fs.open_input_file(path) as f:
        table = pq.ParquetFile(f, buffer_size=1 << 20, pre_buffer=False)  # pages as they come, not a row group's columns at once
        for g in range(table.metadata.num_row_groups):
            n = table.metadata.row_group(g).num_rows
            if at < high and at + n > low:
                seen = at
                for batch in table.iter_batches(batch_size=min(count, 256), row_groups=[g], columns=columns):
                    a, b = max(low, seen) - seen, min(high, seen + len(batch)) - seen
                    if b > a:
                        parts.append(batch.slice(a, b - a))
                    seen += len(batch)
                    if seen >= high:
                        break
            at += n
        schema = table.schema_arrow
    if columns is not None:
        schema = pa.schema([schema.field(c) for c in schema.names if c in columns])
    return pa.Table.from_batches(parts, parts[0].schema if parts else schema)


def ids_and_texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids, null as NO_ID, and texts, null as none."""
    ids = table.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
    texts = [x or b"" for c in table.column("text").chunks for x in as_bytes(c)]
    return ids, texts


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(x: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of all windows of `width` values; by doubling, in log(width) steps."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, out, power, size = 0, None, x, 1
    while True:
        if width & size:
            # `out` covers the first `done` values of a window, `power` the `size` values after them
            if out is None:
                out = power[:n].copy() if len(power) > n else power.copy()
            else:
                out = out * np.uint64(pow(int(base), size, 1 << 64)) + power[done : done + n]
            done += size
        if done == width:
            return mix(out[:n])
        m = len(power) - size
        power = power[:m] * np.uint64(pow(int(base), size, 1 << 64)) + power[size : size + m]
        size *= 2


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length, the first sorted uint64."""
    import zstandard

    n = len(columns[0])
    parts = []
    for k, c in enumerate(columns):
        if k == 0:
            c = np.diff(c, prepend=c.dtype.type(0))
        parts.append(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes() if n else b"")
    return struct.pack("<I", n) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(block: bytes, dtypes: list) -> list[np.ndarray]:
    import zstandard

    (n,) = struct.unpack_from("<I", block)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[4:]), np.uint8)
    out, at = [], 0
    for k, t in enumerate(map(np.dtype, dtypes)):
        c = np.ascontiguousarray(data[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).ravel()
        out.append(np.cumsum(c, dtype=t) if k == 0 else c)
        at += n * t.itemsize
    return out


def squeeze(values: np.ndarray) -> bytes:
    """An array whose order the receiver knows."""
    import zstandard

    data = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=3).compress(data.view(np.uint8).reshape(len(data), -1).T.tobytes() if len(data) else b"")


def loosen(block: bytes, dtype) -> np.ndarray:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(data.reshape(size, -1).T).view(dtype).ravel()


def slices(sorted_hashes: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Bounds of the slices of a sorted array by hash range."""
    edges = np.array([(i << bits) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def slice_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def by_chunk(batches, flush):
    """Calls flush(file, chunk, ids, texts), with the rows' numbers if batches have them, for each run of rows of one chunk,
    and yields what it yields."""
    key, ids, texts, more = None, [], [], []
    for batch in batches:
        files, chunk = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        extra = [c.to_pylist() for c in batch.columns[4:]]
        for i, (k, doc, text) in enumerate(zip(zip(files, chunk, strict=True), batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)):
            if k != key:
                if ids:
                    yield from flush(*key, ids, texts, *more)
                key, ids, texts, more = k, [], [], [[] for _ in extra]
            for c, values in zip(more, extra, strict=True):
                c.append(values[i])
            ids.append(NO_ID if doc is None else doc)
            texts.append(text or b"")
    if ids:
        yield from flush(*key, ids, texts, *more)
    del ids, texts, more
    tidy()


def block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["slice", "file", "chunk", "block"])

