"""Operator 3, sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots whose number never changes; the bytes of each slot are added up, and a
versioned map gives every slot a shard. The map alone is edited when shards are added, removed or out of balance: the
records keep their slots. The law is `bytes`: the sizes of the shards are as near equal as the slots allow.

Defined results: a null text has no bytes, so the size 8 and the checksum 0; repeated rows and equal texts are placed each
on its own; null ids hash like any value; an empty table gives an empty result and an even map; columns besides doc_id
and text are ignored; a very long text counts with all its bytes, in the one slot it falls into.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, shared_path

RESULT = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, virtual_slot int, map_version int"


@dataclass
class SlotMap:
    """shard[v] is the shard of virtual slot v."""

    shard: list[int]
    shards: int
    version: int = 1
    edits: list[dict] = field(default_factory=list)

    @classmethod
    def balanced(cls, load: np.ndarray, shards: int) -> SlotMap:
        """Largest slot first, each to the lightest shard; then slots are moved and exchanged while that helps."""
        out = [0] * len(load)
        heap = [(0, s) for s in range(shards)]
        for v in np.argsort(-load, kind="stable").tolist():
            total, s = heapq.heappop(heap)
            out[v] = s
            heapq.heappush(heap, (total + int(load[v]), s))
        made = cls(out, shards)
        made._exchange(load)
        return made

    def totals(self, load: np.ndarray) -> np.ndarray:
        return np.bincount(self.shard, load, self.shards).astype(np.int64)

    def _exchange(self, load: np.ndarray, rounds: int = 200) -> int:
        """Swaps one slot of the heaviest shard with one of the lightest whose difference is nearest half the gap."""
        swaps = 0
        for _ in range(rounds):
            total = self.totals(load)
            hi, lo = int(total.argmax()), int(total.argmin())
            gap = int(total[hi] - total[lo])
            if gap <= 1:
                break
            shard = np.array(self.shard)
            a, b = np.flatnonzero(shard == hi), np.flatnonzero(shard == lo)
            if not len(a):
                break
            lb = np.append(load[b], 0)  # 0: nothing comes back
            order = np.argsort(lb, kind="stable")
            want = load[a] - gap // 2
            k = np.clip(np.searchsorted(lb[order], want), 0, len(lb) - 1)
            best = None
            for shift in (0, -1):
                kk = np.clip(k + shift, 0, len(lb) - 1)
                moved = load[a] - lb[order[kk]]
                ok = (moved > 0) & (moved < gap)
                if ok.any():
                    score = np.where(ok, np.abs(2 * moved - gap), np.iinfo(np.int64).max)
                    i = int(score.argmin())
                    if best is None or score[i] < best[0]:
                        best = (score[i], int(a[i]), int(order[kk[i]]))
            if best is None:
                break
            _, x, j = best
            self.shard[x] = lo
            if j < len(b):
                self.shard[int(b[j])] = hi
            swaps += 1
        return swaps

    def rebalanced(self, load: np.ndarray, shards: int) -> SlotMap:
        """The next version for a new number of shards: only slots of shards above the mean, or removed, move."""
        out = list(self.shard)
        mean = load.sum() / shards
        total = np.zeros(shards, np.int64)
        loose = []
        for v in np.argsort(-load, kind="stable").tolist():
            s = out[v]
            if s < shards and total[s] + load[v] <= mean:
                total[s] += load[v]
            else:
                loose.append(v)
        heap = [(int(t), s) for s, t in enumerate(total)]
        heapq.heapify(heap)
        moved = []
        for v in loose:
            t, s = heapq.heappop(heap)
            if out[v] != s:
                moved.append([v, out[v], s])
                out[v] = s
            heapq.heappush(heap, (t + int(load[v]), s))
        return SlotMap(out, shards, self.version + 1, [*self.edits, {"version": self.version + 1, "moved": moved}])

    def save(self, folder: str) -> str:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/slots-v{self.version:06d}.json"
        with fs.open_output_stream(name) as f:
            f.write(json.dumps(self.__dict__).encode())
        return name

    @classmethod
    def load(cls, folder: str, version: int) -> SlotMap:
        fs, path = filesystem(folder)
        with fs.open_input_stream(f"{path}/slots-v{version:06d}.json") as f:
            return cls(**json.loads(f.read()))


def sized(docs: DataFrame, slots: int) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot: the texts go no further than this."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rows) of every virtual slot: at most `slots` rows come to the driver."""
    load, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for v, b, n in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        load[v], count[v] = b, n
    return load, count


def assign(docs: DataFrame, shards: int = 24, slots: int = 8192, folder: str | None = None) -> DataFrame:
    """Every record with its shard and its gapless place in it. The map is saved as version 1 in `folder`."""
    spark = docs.sparkSession
    rows = sized(docs, slots)
    load, count = slot_loads(rows, slots)
    made = SlotMap.balanced(load, shards)
    made.save(folder or shared_path(spark, "slots"))
    shard = np.array(made.shard, np.int32)
    base = np.zeros(slots, np.int64)
    for s in range(shards):
        own = np.flatnonzero(shard == s)
        base[own] = np.cumsum(count[own]) - count[own]

    def run(batches):
        for batch in batches:
            v = batch.column(3).to_numpy()
            n = len(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(["bytes"] * n), pa.array(shard[v]), pa.array(base[v] + batch.column(4).to_numpy() - 1), pa.nulls(n, pa.int32()), batch.column(3), pa.array(np.full(n, made.version, np.int32))],
                [c.split()[0] for c in RESULT.split(", ")],
            )

    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")).cast("long")
    return rows.withColumn("place", place).mapInArrow(run, RESULT)
