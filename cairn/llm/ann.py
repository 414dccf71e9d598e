"""Operator 1, approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors are written once, each row with a number of its own, and hashed by that number into shards of bounded bytes, so no id
or vector, however often it repeats, makes a shard large. A shard's graph is built in one task over its distinct vectors (a
node lists the rows that hold it) and saved in the shared folder as flat arrays: for each level the nodes on it and a matrix
of neighbours. Nodes enter in batches: a batch searches the graph so far by beam search, all its members a step at a time,
sees its own members too, and keeps diverse neighbours; links are made both ways and pruned by the same rule. For largest
inner products the graph lives in one dimension more, in which all vectors have one length; a query has 0 there, so that
nearest and largest product agree. Queries are saved in blocks; a task takes one block through several shards and keeps the
best of them, and what several tasks found for a query is merged. Scores are inner products of the original vectors in double
precision.

Defined results: vectors that are null, zero, or hold null or non-finite components, rows without id, and vectors of another
length than the most common one take no part; ties go to the smaller id; a query's own row is left out, by its number, so that
a repeat of it counts; rows that repeat a query's id and vector are answered once, rows of one id with different vectors each
(query_rows=True tells them apart); an empty table gives an empty result; other columns are ignored; wide vectors make more shards.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, persist, shared_path

M = 16  # links a node on upper levels, twice as many on the ground
BUILD_BEAM = 48
SEARCH_BEAM = 96
#: Bytes of a shard's arrays, whatever the width of a vector; a table is cut into MIN_SHARDS at least.
SHARD_BYTES = 128 << 20
MIN_SHARDS = 8
QUERY_BLOCK = 1024
RESULT = "query_id long, rank int, vec_id long, score double"


def put(fs, path: str, content: io.BytesIO) -> None:
    """Writes aside, then renames: a file is whole or not there."""
    temporary = f"{path}.{np.random.default_rng().integers(1 << 60):x}"
    with fs.open_output_stream(temporary) as f:
        f.write(content.getbuffer())
    fs.move(temporary, path)


class Graph:
    """Flat arrays: distinct vectors, the rows (ids and numbers) that hold each, and by level the member nodes and their
    neighbours (-1 where there are fewer)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        rows = np.arange(len(ids)) if rows is None else rows
        vectors = np.ascontiguousarray(vectors + 0.0)  # one zero
        order = np.lexsort((rows, ids))
        ids, vectors, rows = ids[order], vectors[order], rows[order]
        whole = vectors.view([("", f"V{vectors.itemsize * vectors.shape[1]}")]).ravel() if len(vectors) else np.empty(0, "V8")
        _, first, which = np.unique(whole, return_index=True, return_inverse=True)
        node = np.argsort(first, kind="stable")  # nodes in order of their smallest id, whatever the bytes
        place = np.empty(len(node), np.int64)
        place[node] = np.arange(len(node))
        held = np.argsort(place[which], kind="stable")  # members of a node stay in order of id
        self.ids, self.rows = ids[held], rows[held]
        self.count = np.bincount(place[which], minlength=len(node)) if len(node) else np.empty(0, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.vectors = vectors[np.sort(first)]
        norm = np.einsum("ij,ij->i", self.vectors, self.vectors)
        extra = np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))
        self.space = np.hstack([self.vectors, extra[:, None]]).astype(np.float32)
        n = len(self.vectors)
        # levels from a fixed stream, so that a rebuilt shard is the same
        draw = np.random.default_rng(n).random(n)
        self.height = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(M)).astype(np.int64), 8)
        self.links: list[np.ndarray] = []

    # -- building ---------------------------------------------------------

    def build(self) -> Graph:
        n = len(self.vectors)
        top = int(self.height.max(initial=0))
        # the highest nodes first: every level is then complete below its entry
        order = np.argsort(-self.height, kind="stable")
        self.first, self.count, self.vectors, self.space, self.height = (x[order] for x in (self.first, self.count, self.vectors, self.space, self.height))
        self.links = []
        for level in range(top + 1):
            members = int((self.height >= level).sum())  # nodes 0 .. members - 1
            self.links.append(np.full((members, 2 * M if level == 0 else M), -1, np.int32))
        done = 0
        while done < n:
            size = min(n - done, max(64, min(done // 2, 1024)))
            self._insert(done, done + size)
            done += size
        return self

    def _insert(self, low: int, high: int) -> None:
        new = np.arange(low, high)
        top = len(self.links) - 1
        entry = np.zeros((len(new), 1), np.int32)
        for level in range(top, -1, -1):
            members = min(len(self.links[level]), high)
            mine = new[new < members]
            if low:
                grounded = min(low, len(self.links[level]))
                beam = BUILD_BEAM if len(mine) else 4
                found, _ = self._beam(self.space[new], level, entry, beam, grounded)
                entry = found[:, : min(8, found.shape[1])]
            if not len(mine):
                continue
            near = np.full((len(mine), 0), -1, np.int32) if not low else found[: len(mine)]
            own = -self._distance(self.space[mine], self.space[mine])
            np.fill_diagonal(own, -np.inf)
            k = min(len(mine) - 1, 2 * M)
            if k:
                best = np.argpartition(-own, k - 1, axis=1)[:, :k]
                near = np.hstack([near, (mine[best]).astype(np.int32)])
            links = self.links[level]
            if near.shape[1]:
                links[mine] = self._select(mine, near, links.shape[1])
                self._back(mine, level)

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * a @ b.T

    def _select(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Diverse neighbours: a candidate nearer to one already taken than to the node waits; the nearest waiting fill up."""
        out = np.full((len(nodes), most), -1, np.int32)
        for at in range(0, len(nodes), 256):
            c = candidates[at : at + 256]
            x = self.space[nodes[at : at + 256]]
            rows = len(c)
            near = self.space[np.maximum(c, 0)]
            d = ((near - x[:, None]) ** 2).sum(2)
            d[(c < 0) | (c == nodes[at : at + 256, None])] = np.inf
            order = np.argsort(d, axis=1, kind="stable")
            c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
            repeat = np.zeros(c.shape, bool)  # a candidate may come twice; equals have equal distance
            for back in (1, 2, 3):
                repeat[:, back:] |= c[:, back:] == c[:, :-back]
            d[repeat] = np.inf
            near = np.take_along_axis(near, order[:, :, None], 1)
            sq = np.einsum("ijk,ijk->ij", near, near)
            gap = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1))
            closest = np.full(c.shape, np.inf, np.float32)
            taken = np.zeros(c.shape, bool)
            count = np.zeros(rows, np.int64)
            for k in range(c.shape[1]):
                ok = np.isfinite(d[:, k]) & (d[:, k] <= closest[:, k]) & (count < most)
                taken[ok, k] = True
                count += ok
                closest[ok] = np.minimum(closest[ok], gap[ok, k])
            rank = np.where(taken, 0, np.where(np.isfinite(d), 1, 2))
            pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
            got = np.where(np.take_along_axis(rank, pick, 1) < 2, np.take_along_axis(c, pick, 1), -1)
            out[at : at + 256, : got.shape[1]] = got
        return out

    def _back(self, nodes: np.ndarray, level: int) -> None:
        """Adds the links the other way and prunes where there are too many."""
        links = self.links[level]
        a = np.repeat(nodes, links.shape[1])
        b = links[nodes].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        touched, first, count = np.unique(b, return_index=True, return_counts=True)
        wide = int(count.max(initial=0))
        slot = np.arange(len(b)) - np.repeat(first, count)
        for at in range(0, len(touched), 512):
            t = touched[at : at + 512]
            lo, hi = first[at], first[at + len(t) - 1] + count[at + len(t) - 1]
            w = min(wide, int(count[at : at + 512].max()))
            extra = np.full((len(t), w), -1, np.int32)
            extra[np.repeat(np.arange(len(t)), count[at : at + 512]), slot[lo:hi]] = a[lo:hi]
            links[t] = self._select(t, np.hstack([links[t], extra]), links.shape[1])

    # -- searching --------------------------------------------------------

    def _beam(self, queries: np.ndarray, level: int, entry: np.ndarray, beam: int, members: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances), nearest first, -1 and inf where fewer. Every query expands its nearest open node, step by step."""
        links, space = self.links[level], self.space
        q = len(queries)
        out_n, out_d = np.full((q, beam), -1, np.int32), np.full((q, beam), np.inf, np.float32)
        step = max(1, min(q, (256 << 20) // max(1, members)))
        for at in range(0, q, step):
            x = queries[at : at + step]
            rows = np.arange(len(x))
            seen = np.zeros((len(x), members + 1), bool)
            seen[:, -1] = True  # where -1 points
            e = entry[at : at + step]
            nodes = np.full((len(x), beam), -1, np.int32)
            dist = np.full((len(x), beam), np.inf, np.float32)
            w = min(beam, e.shape[1])
            nodes[:, :w] = e[:, :w]
            d = ((space[np.maximum(e[:, :w], 0)] - x[:, None]) ** 2).sum(2)
            dist[:, :w] = np.where(e[:, :w] >= 0, d, np.inf)
            order = np.argsort(dist, axis=1, kind="stable")
            nodes, dist = np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)
            seen[rows[:, None], e[:, :w]] = True
            opened = ~np.isfinite(dist)
            while True:
                pick = np.argmin(opened, axis=1)
                live = np.flatnonzero(~opened[rows, pick])
                if not len(live):
                    break
                opened[live, pick[live]] = True
                nb = links[nodes[live, pick[live]]]
                nb = np.where(nb < members, nb, -1)
                fresh = ~seen[live[:, None], nb]
                seen[live[:, None], nb] = True
                d = space[np.maximum(nb, 0)] - x[live][:, None]
                d = np.where(fresh, np.einsum("ijk,ijk->ij", d, d), np.inf)
                better = (d < dist[live, -1:]).any(1)
                live, nb, d = live[better], nb[better], d[better]
                if not len(live):
                    continue
                n2, d2 = np.hstack([nodes[live], nb]), np.hstack([dist[live], d])
                o2 = np.hstack([opened[live], ~np.isfinite(d)])
                order = np.argsort(d2, axis=1, kind="stable")[:, :beam]
                nodes[live], dist[live], opened[live] = (np.take_along_axis(v, order, 1) for v in (n2, d2, o2))
            out_n[at : at + step], out_d[at : at + step] = np.where(np.isfinite(dist), nodes, -1), dist
        return out_n, out_d

    def search(self, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, number of the row, score in double) of about the k largest inner products of each query:
        all rows of a node that may be among the k."""
        beam = max(beam, k)
        x = np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32)
        entry = np.zeros((len(x), 1), np.int32)
        for level in range(len(self.links) - 1, -1, -1):
            found, _ = self._beam(x, level, entry, beam if level == 0 else 8, len(self.links[level]))
            entry = found[:, :8]
        q, at = np.nonzero(found >= 0)
        node = found[q, at]
        score = np.empty(len(q))
        for low in range(0, len(q), 1 << 16):
            part = slice(low, low + (1 << 16))
            score[part] = np.einsum("ij,ij->i", self.vectors[node[part]], queries[q[part]])
        many = np.minimum(self.count[node], k)  # the k smallest ids of a vector are enough
        member = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - self.first[node], many)
        return np.repeat(q, many), self.ids[member], self.rows[member], np.repeat(score, many)

    # -- storing ----------------------------------------------------------

    def save(self, fs, path: str) -> None:
        held = io.BytesIO()
        np.savez(held, ids=self.ids, rows=self.rows, first=self.first, count=self.count, vectors=self.vectors, space=self.space, height=self.height, **{f"links{k}": x for k, x in enumerate(self.links)})
        put(fs, path, held)

    @classmethod
    def load(cls, fs, path: str) -> Graph:
        with fs.open_input_file(path) as f:
            data = np.load(io.BytesIO(f.read()))
            made = cls.__new__(cls)
            made.ids, made.rows, made.first, made.count, made.vectors, made.space, made.height = (data[k] for k in ("ids", "rows", "first", "count", "vectors", "space", "height"))
            made.links = [data[k] for k in sorted((k for k in data.files if k.startswith("links")), key=lambda k: int(k[5:]))]
            return made


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


_graphs: dict[str, Graph] = {}


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def build(vectors: DataFrame, folder: str, shards: int) -> DataFrame:
    """Builds every shard's graph once; shard, path, n of each. vectors: row, vec_id, v."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        name = f"{path}/shard-{shard:06d}.npz"
        Graph(table.column("vec_id").to_numpy(), _matrix(table.column("v")), table.column("row").to_numpy()).build().save(filesystem(folder)[0], name)
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [name], "n": pa.array([len(table)], pa.int64())})

    sharded = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    return sharded.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "shard int, path string, n long")  # a shard is work, whatever its bytes


def save_queries(queries: DataFrame, folder: str, blocks: int) -> DataFrame:
    """Writes the queries (row, vec_id, v) in blocks; block, path of each."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        name = f"{path}/queries-{block:06d}.npz"
        order = np.argsort(table.column("row").to_numpy())
        held = io.BytesIO()
        np.savez(held, row=table.column("row").to_numpy()[order], vec_id=table.column("vec_id").to_numpy()[order], v=_matrix(table.column("v"))[order])
        put(filesystem(folder)[0], name, held)
        return pa.table({"block": pa.array([block], pa.int32()), "path": [name]})

    held = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    return held.groupBy("block").applyInArrow(run, "block int, path string")


def _best(q: np.ndarray, ids: np.ndarray, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each query the k best: largest score, then smallest id, then smallest number."""
    order = np.lexsort((rows, ids, -score, q))
    q, ids, rows, score = q[order], ids[order], rows[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], ids[keep], rows[keep], score[keep]


def neighbours(table: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", beam: int = SEARCH_BEAM, query_rows: bool = False) -> DataFrame:
    """The k nearest of every row that `is_query` (a condition on vec_id) marks, among all rows but its own. query_rows: also
    query_row, the number of the query's row."""
    spark = table.sparkSession
    result = RESULT + ", query_row long" * query_rows
    vectors = usable(table, id_column, vector_column)
    sizes = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    dimension, n = sizes[0]
    # written: a row keeps its number whichever task reads it
    vectors = persist(vectors.where(F.size("v") == dimension).withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(MIN_SHARDS, -(-n * (12 * dimension + 16 * M) // SHARD_BYTES))
    folder = shared_path(spark, "graphs")
    paths = sorted(r["path"] for r in build(vectors, folder, shards).collect())  # a row a shard
    queries = vectors.where(is_query).groupBy("vec_id", "v").agg(F.min("row").alias("row"))
    asked = save_queries(queries, folder, max(1, -(-queries.count() // QUERY_BLOCK)))
    blocks = sorted(r["path"] for r in asked.collect())  # a row a block
    if not blocks:
        return spark.createDataFrame([], result)
    # few blocks go through the shards in several tasks each, many in one
    groups = min(len(paths), max(1, -(-2 * spark.sparkContext.defaultParallelism // len(blocks))))

    def run(batches):
        for batch in batches:
            for task in batch.column(0).to_pylist():
                block, group = divmod(task, groups)
                fs = filesystem(folder)[0]
                with fs.open_input_file(blocks[block]) as f:
                    data = np.load(io.BytesIO(f.read()))
                    row, vec_id, v = data["row"], data["vec_id"], data["v"]
                found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                for path in paths[group::groups]:
                    if path not in _graphs:
                        _graphs.clear()
                        _graphs[path] = Graph.load(fs, path)
                    q, ids, rows, score = _graphs[path].search(v, k + 1, beam)
                    other = rows != row[q]
                    found = _best(*(np.concatenate([a, b[other]]) for a, b in zip(found, (q, ids, rows, score), strict=True)), k)
                q, ids, _, score = found
                yield pa.RecordBatch.from_arrays([pa.array(row[q]), pa.array(vec_id[q]), pa.array(ids), pa.array(score)], ["query_row", "query_id", "vec_id", "score"])

    count = len(blocks) * groups
    found = spark.range(0, count, 1, count).mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*(c.split()[0] for c in result.split(", ")))
