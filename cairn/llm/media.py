"""Operator 6, media columns: payloads stored in archives and read back by a Spark data source.

Writing: every task packs its payloads into one archive, each payload as a grey PNG image of 8-bit samples (lossless),
and puts the archive in place by renaming, so that a task run again replaces its own archive with the same content. An
archive is a row of members, (magic, id, length, checksum, bytes) each, and an index of offsets at its end.

Reading: the data source `cairn_media` lists a directory and plans partitions of byte ranges; a partition owns the
members that start in its range. Payloads leave it in Arrow batches of bounded size. A member that can't be read or whose
checksum fails is tried again by itself, from a newly opened file at its own offset, before the task fails.

Defined results: null and empty texts are one padded row; repeated rows repeat; equal texts give equal values; null ids
stay null; an empty table gives an empty result; columns besides doc_id and text are ignored; a very
long text is one member, held whole by the task that writes or reads it.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import as_bytes, filesystem, shared_path, small_batches

ROW = 576
MAGIC = b"CMEM"
HEAD = struct.Struct("<4sBqIII")  # magic, id is null, id, unpadded bytes, stored bytes, crc of the stored bytes
TAIL = struct.Struct("<QQ4s")  # members, offset of the index, magic
MEMBER = "doc_id long, n_bytes long, media binary"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: bytes, unit: int = ROW) -> bytes:
    return text + b"\xff" * (max(unit, -(-len(text) // unit) * unit) - len(text))


def _block(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = ROW) -> bytes:
    """A grey 8-bit image, `width` samples a row, no row filter."""
    height = len(payload) // width
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)
    return b"\x89PNG\r\n\x1a\n" + _block(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + _block(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _block(b"IEND", b"")


def from_png(image: bytes) -> np.ndarray:
    """The samples, (height, width)."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a block of the image is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    width, height = size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("row filters aren't used here")
    return rows[:, 1:]


class ArchiveWriter:
    """Writes one archive under a temporary name and renames it when it is whole."""

    def __init__(self, folder: str, name: str, attempt: str):
        self.fs, path = filesystem(folder)
        self.path, self.temporary = f"{path}/{name}", f"{path}/_{name}.{attempt}"
        self.file, self.at, self.offsets = self.fs.open_output_stream(self.temporary), 0, []

    def add(self, doc_id: int | None, n_bytes: int, stored: bytes) -> None:
        self.offsets.append(self.at)
        head = HEAD.pack(MAGIC, doc_id is None, doc_id or 0, n_bytes, len(stored), zlib.crc32(stored))
        self.file.write(head)
        self.file.write(stored)
        self.at += len(head) + len(stored)

    def close(self) -> None:
        index = np.array(self.offsets, "<u8").tobytes()
        self.file.write(index)
        self.file.write(TAIL.pack(len(self.offsets), self.at, MAGIC))
        self.file.close()
        self.fs.move(self.temporary, self.path)


def write_archives(docs: DataFrame, folder: str) -> None:
    """One archive a task."""
    small_batches(docs.sparkSession)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        writer = None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                writer = writer or ArchiveWriter(folder, f"part-{task.partitionId():06d}.cmem", str(task.taskAttemptId()))
                writer.add(doc, len(text or b""), to_png(padded(text or b"")))
        if writer:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([len(writer.offsets) if writer else 0], pa.int64())], ["members"])

    docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "members long").agg({"members": "sum"}).collect()


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def read_member(fs, path: str, offset: int, tries: int = 3, pause: float = 0.2) -> tuple[int | None, int, bytes]:
    """(id, unpadded bytes, stored bytes) of the member at an offset; tries again by itself."""
    for left in reversed(range(tries)):
        try:
            with fs.open_input_file(path) as f:
                return _member(f, offset)
        except (OSError, ValueError):
            if not left:
                raise
            time.sleep(pause)
    raise AssertionError


def _member(f, offset: int) -> tuple[int | None, int, bytes]:
    f.seek(offset)
    head = f.read(HEAD.size)
    if len(head) < HEAD.size:
        raise ValueError(f"the archive ends in the head of a member at {offset}")
    magic, null, doc, n_bytes, size, crc = HEAD.unpack(head)
    stored = f.read(size)
    if magic != MAGIC or len(stored) != size or zlib.crc32(stored) != crc:
        raise ValueError(f"the member at {offset} is damaged")
    return None if null else doc, n_bytes, stored


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 16 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, path = filesystem(self.folder)
        out = []
        for info in fs.get_file_info(FileSelector(path)):
            if info.type == FileType.File and info.base_name.endswith(".cmem") and not info.base_name.startswith("_"):
                out += [Range(info.path, low, low + self.range_bytes) for low in range(0, info.size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = filesystem(self.folder)
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        with fs.open_input_file(partition.path) as f:
            size = f.size()
            f.seek(size - TAIL.size)
            count, index, magic = TAIL.unpack(f.read(TAIL.size))
            if magic != MAGIC:
                raise ValueError(f"{partition.path} is not an archive")
            f.seek(index)
            offsets = np.frombuffer(f.read(8 * count), "<u8")
            own = offsets[(offsets >= partition.low) & (offsets < partition.high)].tolist()
            rows, held = [], 0
            for offset in own:
                try:
                    row = _member(f, offset)
                except (OSError, ValueError):
                    row = read_member(fs, partition.path, offset, self.tries)
                rows.append(row)
                held += len(row[2])
                if held >= self.batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class MediaSource(DataSource):
    """spark.read.format("cairn_media").load(folder): doc_id, n_bytes, media."""

    @classmethod
    def name(cls):
        return "cairn_media"

    def schema(self):
        return MEMBER

    def reader(self, schema):
        return MediaReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("cairn_media").options(**options).load(folder)


def feature(samples: np.ndarray) -> str:
    """Whole numbers only: size, sum, sum of squares, extremes, absolute steps along rows, counts in 16 classes of value."""
    flat = samples.ravel()
    wide = flat.astype(np.int64)
    counts = np.bincount(flat >> 4, minlength=16)
    steps = int(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum(dtype=np.int64))
    return f"{samples.shape[1]}x{samples.shape[0]};sum={wide.sum()};sq={(wide * wide).sum()};min={flat.min()};max={flat.max()};steps={steps};hist=" + ",".join(map(str, counts.tolist()))


def describe(members: DataFrame) -> DataFrame:
    """Decodes stored members and computes their digests and features."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                samples = from_png(media)
                payload = samples.tobytes()
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return members.mapInArrow(run, RESULT)


def store_and_describe(docs: DataFrame, folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "media")
    write_archives(docs, folder)
    return describe(read_archives(spark, folder))
