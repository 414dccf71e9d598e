"""Operator 2, substring dedup by Rabin-Karp hashes of fixed-length token windows.

Every window of `width` consecutive words of every text is hashed (64 + 8 bits, two independent polynomials over 64-bit
word hashes). Hashes are kept once a chunk, with the smallest document that holds them, and exchanged by hash range; the
chunk that holds the first occurrence keeps it, every other chunk that holds the hash is told. Each chunk then reads its
texts again: a window whose hash it was told of, or that isn't the chunk's first of its hash, starts earlier somewhere;
overlapping removed windows merge into maximal intervals and their words go.

No hash gathers more rows than there are chunks, however often a passage repeats. No text is shuffled.

Defined results: a null or empty text has no words; a text with fewer words than a window keeps all; a null id sorts last;
rows that share an id (or have none) are one after the other in table order, files by name; an empty table gives an empty result; extra columns are
ignored by the digests and kept by remove(); a very long text is held whole, with its words, in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import chunks as C
from .common import tidy

WIDTH = 20
DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"
ENTRY = [np.uint64, np.uint8, np.int64]


class Windows:
    """Hashes of all windows of a chunk's documents, documents by ascending id."""

    def __init__(self, ids, texts: list[bytes], width: int):
        self.ids = np.asarray(ids, np.int64)
        self.order = np.argsort(self.ids, kind="stable")
        words = [t.split() for t in texts]
        self.words = words
        self.n = np.array([len(w) for w in words], np.int64)[self.order] if len(words) else np.empty(0, np.int64)
        x = C.word_hashes([w for i in self.order.tolist() for w in words[i]])
        ends = np.cumsum(self.n)
        self.starts = ends - self.n
        h, e = C.rolling(x, width, C.BASE[0]), (C.rolling(x, width, C.BASE[1]) >> np.uint64(56)).astype(np.uint8)
        count = np.maximum(self.n - width + 1, 0)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count) + self.starts[self.doc]
        self.h, self.e = h[self.at], e[self.at]

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the first window of each hash by ascending hash, flag of every window: it is the first)."""
        order = np.argsort(self.h, kind="stable")
        h, e = self.h[order], self.e[order]
        first = np.ones(len(order), bool)
        first[1:] = h[1:] != h[:-1]
        odd = np.flatnonzero(~first & (np.r_[e[:1], e[:-1]] != e)) if len(e) else []
        if len(odd):  # two hashes agree in 64 bits and not in the rest: sort those by both
            order = np.lexsort((np.arange(len(self.h)), self.e, self.h))
            h, e = self.h[order], self.e[order]
            first[1:] = (h[1:] != h[:-1]) | (e[1:] != e[:-1])
        flag = np.zeros(len(order), bool)
        flag[order[first]] = True
        return order[first], flag


def _emit(width: int, parts: int):
    def flush(file, chunk, ids, texts):
        w = Windows(ids, texts, width)
        at, _ = w.firsts()
        h, e, doc = w.h[at], w.e[at], w.ids[w.order][w.doc[at]]
        bounds = C.slices(h, parts)
        rows = []
        for p in range(parts):
            a, b = bounds[p], bounds[p + 1]
            if b > a:
                local, which = np.unique(doc[a:b], return_inverse=True)
                rows.append((p, file, chunk, _pack_entries(h[a:b], e[a:b], local, which)))
        for i in range(0, len(rows), 64):
            yield C.block_batch(rows[i : i + 64])

    return lambda batches: C.by_chunk(batches, flush)


def _pack_entries(h, e, local, which) -> bytes:
    ids = C.pack([local.view(np.uint64)])
    return len(ids).to_bytes(4, "little") + ids + C.pack([h, e, which.astype(np.uint16)])


def _unpack_entries(block: bytes):
    n = int.from_bytes(block[:4], "little")
    (local,) = C.unpack(block[4 : 4 + n], [np.uint64])
    h, e, which = C.unpack(block[4 + n :], [np.uint64, np.uint8, np.uint16])
    return h, e, local.view(np.int64)[which]


def _answer(table: pa.Table) -> pa.Table:
    """Of one slice: for each chunk the hashes that occur earlier in another chunk."""
    files, chunk, blocks = (table.column(i).to_pylist() for i in (1, 2, 3))
    keys = sorted(set(zip(files, chunk, strict=True)))  # table order, the same in every slice: it breaks ties between ids
    number = {k: i for i, k in enumerate(keys)}
    parts = [_unpack_entries(b) for b in blocks]
    h = np.concatenate([p[0] for p in parts])
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = hs[1:] == hs[:-1]
    shared = np.zeros(len(hs), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    h = h[order]
    e = np.concatenate([p[1] for p in parts])[order]
    doc = np.concatenate([p[2] for p in parts])[order]
    who = np.repeat([number[k] for k in zip(files, chunk, strict=True)], [len(p[0]) for p in parts])[order]
    order = np.lexsort((who, doc, e, h))
    h, e, doc, who = h[order], e[order], doc[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (e[1:] != e[:-1])
    owner = who[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else who
    told = who != owner
    h, e, who = h[told], e[told], who[told]
    order = np.lexsort((e, h, who))
    h, e, who = h[order], e[order], who[order]
    bounds = np.searchsorted(who, np.arange(len(keys) + 1))
    tidy()
    rows = [(0, *keys[k], C.pack([h[a:b], e[a:b]])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    return pa.Table.from_batches([C.block_batch(rows)])


def removed_words(ids, texts: list[bytes], told: list[bytes], width: int) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """For each text its words and a flag for each: it goes. told: the answers to the chunk."""
    w = Windows(ids, texts, width)
    _, first = w.firsts()
    gone = ~first
    if told and len(w.h):
        parts = [C.unpack(b, [np.uint64, np.uint8]) for b in told]
        h, e = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((e, h))
        h, e = h[order], e[order]
        at = np.searchsorted(h, w.h)
        while True:  # nearly always one step: entries that agree in 64 bits follow each other
            inside = at < len(h)
            hit = inside & (h[np.minimum(at, len(h) - 1)] == w.h)
            match = hit & (e[np.minimum(at, len(h) - 1)] == w.e)
            gone |= match
            at = np.where(hit & ~match, at + 1, len(h))
            if not (hit & ~match).any():
                break
    cover = np.zeros(int(w.n.sum()) + 1, np.int64)
    np.add.at(cover, w.at[gone], 1)
    np.add.at(cover, w.at[gone] + width, -1)
    flags = np.cumsum(cover)[:-1] > 0
    out: list[np.ndarray] = [np.empty(0, bool)] * len(texts)
    for k, i in enumerate(w.order.tolist()):
        out[i] = flags[w.starts[k] : w.starts[k] + w.n[k]]
    return w.words, out


def _blocks(spark: SparkSession, paths: C.Chunked, width: int) -> DataFrame:
    rows = C.rows_of(spark, paths).drop("row")
    sent = rows.mapInArrow(_emit(width, paths.slices), C.BLOCK)
    return C.chunks_of(spark, paths).unionByName(sent.groupBy("slice").applyInArrow(_answer, C.BLOCK))


def _kept(words: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)


def _chunk(table: pa.Table, count: int, width: int, columns: list[str] | None = None):
    told = [b for b in table.column(3).to_pylist() if b]
    rows = C.read_chunk(table.column(1)[0].as_py(), table.column(2)[0].as_py(), count, columns)
    ids, texts = C.ids_and_texts(rows)
    return rows, *removed_words(ids, texts, told, width)


def digests(spark: SparkSession, docs: DataFrame | str, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of a table (path) or DataFrame."""
    paths = C.written(docs, spark)
    count = paths.rows

    def run(table: pa.Table) -> pa.Table:
        tidy()
        rows, words, gone = _chunk(table, count, width, ["doc_id", "text"])
        return pa.table(
            {
                "doc_id": rows.column("doc_id").cast(pa.int64()),
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "n_removed": pa.array([int(g.sum()) for g in gone], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(_kept(w, g)).hexdigest() for w, g in zip(words, gone, strict=True)], pa.string()),
            }
        )

    return C.by_place(_blocks(spark, paths, width), paths).applyInArrow(run, DIGESTS)


def remove(spark: SparkSession, docs: DataFrame | str, width: int = WIDTH) -> DataFrame:
    """The documents with the kept words as text, all other columns as they are, and `removed`: word intervals [from, to); a
    column of that name gives way."""
    paths = C.written(docs, spark)
    count = paths.rows
    schema = spark.read.parquet(*paths).schema
    from pyspark.sql.types import ArrayType, LongType, StructType

    result = StructType([f for f in schema.fields if f.name != "removed"]).add("removed", ArrayType(ArrayType(LongType())))

    def run(table: pa.Table) -> pa.Table:
        tidy()
        rows, words, gone = _chunk(table, count, width)
        rows = rows.drop_columns(["removed"]) if "removed" in rows.column_names else rows
        spans = []
        for g in gone:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
            spans.append(edge.reshape(-1, 2).tolist())
        old = rows.column("text").to_pylist()
        texts = [_kept(w, g).decode("utf-8") if g.any() else o for w, g, o in zip(words, gone, old, strict=True)]
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        return rows.append_column("removed", pa.array(spans, pa.list_(pa.list_(pa.int64()))))

    return C.by_place(_blocks(spark, paths, width), paths).applyInArrow(run, result)
