"""Operator 5, quality classifier by importance resampling.

Two generative models over hashed n-grams (single tokens and pairs, hashed into buckets): one of target text, fitted on a
bounded sample of labelled documents, one of raw text, counted over every document. A document's log importance weight is
the sum over its n-grams of log p_target - log p_raw; divided by its number of n-grams (plus a constant that steadies
short texts) and a temperature it is a log weight of the resampling, which draws k documents without replacement by
Gumbel top-k: the k largest of log weight + Gumbel noise. The noise comes from a hash of the id and text, so a run can be
repeated. k is the number of documents whose weight reaches a threshold, and the threshold is the best split of the
labelled sample. The k-th largest key is found by radix selection, sixteen bits a round, over counts.

Texts are tokenised once: the pass that counts also writes each document's table of buckets, from which it is scored.

Tokens are runs of word characters or of other visible characters, lower-cased; a repeat of the token before, and a word
in capitals, count as tokens of their own kind, so that repetition and shouting have n-grams however rare the word.

Defined results: null and empty texts have no n-grams and the weight 0; rows without usable label don't enter the sample;
repeated rows draw each its own key (equal rows have equal keys, and stay or go together; equal keys at the cut all stay);
with no target sample at all every weight is 0 and all documents are kept; an empty table gives an empty result; other
columns are ignored, whatever their names, unless they are to be carried; a very long text's table has no more rows than
there are buckets.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, as_bytes, persist, small_batches, spread, tidy

#: At most so many labelled documents enter the fit; everything else covers all documents.
SAMPLE = 20_000
BUCKETS = 16_384
STEADY = 20.0
TEMPERATURE = 0.01
TOKEN = re.compile(r"\w+|[^\w\s]+")
SCORES = "doc_id long, n_grams long, log_weight double, score double, key double"
REPEAT, CAPITALS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _token_hash(token: str) -> int:
    if len(token) > 1 and token.isupper():
        return int(CAPITALS)
    data = token.lower().encode("utf-8")
    return (zlib.crc32(data) << 32 | zlib.adler32(data)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


_hashes = Generations(_token_hash, 100_000)


def grams(text: str) -> np.ndarray:
    """Buckets of the single tokens and pairs of a text."""
    tokens = TOKEN.findall(text)
    h = np.array(list(map(_hashes.__getitem__, tokens)), np.uint64)
    if not len(h):
        return np.empty(0, np.int64)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    h = np.where(same, REPEAT, h)
    pairs = h[:-1] * np.uint64(0x100000001B3) + h[1:]
    both = np.concatenate([h, pairs])
    both = (both ^ (both >> np.uint64(33))) * _MIX
    return ((both >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def labelled(labels: DataFrame, good, limit: int = SAMPLE) -> DataFrame:
    """doc_id, good of a bounded sample, by order of a hash of the id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.cast("boolean").alias("good")).where("doc_id is not null and good is not null")
    rows = rows.groupBy("doc_id").agg(F.min("good").alias("good"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def pack_table(found: np.ndarray) -> bytes:
    """A document's n-grams as a table of buckets, byte plane by byte plane."""
    b, times = np.unique(found, return_counts=True)
    planes = [np.diff(b, prepend=0).astype("<u2"), times.astype("<u4")]
    return b"".join(np.ascontiguousarray(p).view(np.uint8).reshape(len(b), -1).T.tobytes() for p in planes if len(b))


def unpack_table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 6
    raw = np.frombuffer(data, np.uint8)
    step = np.ascontiguousarray(raw[: 2 * n].reshape(2, n).T).view("<u2").ravel()
    times = np.ascontiguousarray(raw[2 * n :].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(step.astype(np.int64)), times.astype(np.int64)


TOTAL_RAW, TOTAL_TARGET, BAD, GOOD, OTHER = range(5)


def tables(docs: DataFrame, sample: dict[int, bool], carry: tuple[str, ...] = ()) -> DataFrame:
    """kind 0: raw counts, 1: target counts, by bucket (n, bucket); 2, 3: a bad or good document of the sample, 4: any other,
    with its table (grams), number of n-grams (n), noise and the columns to carry. One pass; each task adds up its own totals
    before anything is shuffled."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "kind int, bucket long, n long, grams binary, doc_id long, noise double" + "".join(f", {c} {types[c]}" for c in carry)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64()]
    names = ["kind", "bucket", "n", "grams", "doc_id", "noise", *carry]

    def run(batches):
        raw, target, carried = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), None
        for batch in batches:
            _hashes.turn()
            carried, rows, every = batch.columns[2:], [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                found = grams((text or b"").decode("utf-8"))
                every.append(found)
                good = sample.get(doc) if doc is not None else None
                if good:
                    target += np.bincount(found, minlength=BUCKETS)
                rows.append((OTHER if good is None else GOOD if good else BAD, None, len(found), pack_table(found), doc, gumbel(doc, text or b"")))
            raw += np.bincount(np.concatenate(every), minlength=BUCKETS) if every else 0
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)), *carried], names)
        if carried is not None:
            rows = [(kind, int(b), int(n[b]), None, None, None) for kind, n in ((TOTAL_RAW, raw), (TOTAL_TARGET, target)) for b in np.flatnonzero(n)]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)), *(pa.nulls(len(rows), c.type) for c in carried)], names)
        tidy(_hashes)

    return spread(docs, "cast(doc_id as long) doc_id", "text", *carry).mapInArrow(run, schema)


class Model:
    """Log ratio of every bucket, and the threshold of the scores."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.ratio = np.zeros(BUCKETS)
        self.threshold = -math.inf
        if target.sum() and raw.sum():
            p = (target + 0.5) / (target.sum() + 0.5 * BUCKETS)
            q = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
            self.ratio = np.log(p) - np.log(q)

    def split(self, good: np.ndarray, score: np.ndarray) -> None:
        """Sets the threshold with fewest errors in the sample; an accepted bad document counts a quarter of a rejected good one."""
        if not len(good) or good.all():
            return
        order = np.argsort(score, kind="stable")
        s, y = score[order], good[order]
        lost = np.concatenate([[0], np.cumsum(y)])  # good ones under the cut
        left = (~y).sum() - np.concatenate([[0], np.cumsum(~y)])  # bad ones over it
        cost = lost + 0.25 * left
        best = np.flatnonzero(cost == cost.min())
        k = int(best[len(best) // 2])
        self.threshold = float(-math.inf if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2)

    @staticmethod
    def score(n: int, weight: float) -> float:
        return weight / (n + STEADY)


def fit(docs: DataFrame, labels: DataFrame, good, limit: int = SAMPLE, carry: tuple[str, ...] = ()) -> tuple[Model, DataFrame]:
    """The model, and the documents' tables that were made on the way."""
    sample = {r[0]: r[1] for r in labelled(labels, good, limit).collect()}  # at most `limit` rows
    small_batches(docs.sparkSession)
    found = persist(tables(docs, sample, carry), "grams")
    totals = np.zeros((2, BUCKETS))
    for kind, b, n in found.where("kind < 2").groupBy("kind", "bucket").agg(F.sum("n")).collect():  # at most 2 x BUCKETS rows
        totals[kind, b] = n
    model = Model(*totals)
    # a document of the sample may be repeated in the table: as many rows as the sample may have enter
    seen = score(found.where(F.col("kind").isin(BAD, GOOD)), model, carry=("kind",))
    rows = seen.select("kind", "score").orderBy(F.xxhash64("score"), "score", "kind").limit(limit).collect()
    if totals[1].sum():
        model.split(np.array([r[0] == GOOD for r in rows], bool), np.array([r[1] for r in rows], np.float64))
    return model, found


def gumbel(doc: int | None, text: bytes) -> float:
    u = (zlib.crc32(text, zlib.crc32(repr(doc).encode())) + 0.5) / 2.0**32
    return -math.log(-math.log(u))


def score(found: DataFrame, model: Model, temperature: float = TEMPERATURE, carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents of tables(), scored. carry: columns that the result has too."""
    types = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    schema = ", ".join([SCORES, "order_bits long", *(f"{c} {types[c]}" for c in carry)])
    ratio = model.ratio

    def run(batches):
        for batch in batches:
            out = []
            for n, data, noise in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                bucket, times = unpack_table(data)
                w = float(ratio[bucket] @ times)
                s = Model.score(n, w)
                out.append((n, w, s, s / temperature + noise))
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            order = pa.array(order_bits(np.array([r[3] for r in out], np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)), order, *batch.columns[4:]], ["doc_id", "n_grams", "log_weight", "score", "key", "order_bits", *carry])
        tidy()

    return found.where(F.col("kind") > TOTAL_TARGET).select("doc_id", "n", "grams", "noise", *carry).mapInArrow(run, schema)


def kth_largest(rows: DataFrame, column: str, k: int, bits: str | None = None) -> float:
    """The k-th largest value by radix selection: each round counts the next sixteen bits below the prefix found so far. bits: a
    column that has order_bits() of the values already."""
    ordered = rows.select((F.col(bits) if bits else _order_bits_udf(column)).alias("bits"))
    bits = F.col("bits")
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF)).alias("part")
        held = ordered if shift == 48 else ordered.where(F.shiftrightunsigned(bits, shift + 16) == F.lit(prefix))
        counts = sorted(held.groupBy(part).count().collect(), reverse=True)  # at most 65,536 rows
        for value, n in counts:
            if left <= n:
                prefix = prefix << 16 | value
                break
            left -= n
    return _from_order_bits(prefix)


def order_bits(x: np.ndarray) -> np.ndarray:
    """Longs whose unsigned order is the order of the doubles: the sign bit flipped, or all bits of negatives."""
    raw = np.asarray(x, np.float64).view(np.int64)
    return np.where(raw < 0, ~raw, raw ^ np.int64(-(2**63)))


def _order_bits_udf(column: str):
    @F.pandas_udf("long")
    def convert(x):
        return x._constructor(order_bits(x.to_numpy(np.float64)))

    return convert(F.col(column))


def _from_order_bits(value: int) -> float:
    raw = value ^ (1 << 63) if value >> 63 else ~value & (2**64 - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def classify(docs: DataFrame, labels: DataFrame, good, limit: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document: doc_id, n_grams, log_weight, score, key, the columns to carry, kept."""
    model, found = fit(docs, labels, good, limit, carry)
    scored = persist(score(found, model, carry=carry), "scores")
    k = scored.where(F.col("score") >= F.lit(model.threshold)).count()
    kept = F.col("key") >= F.lit(kth_largest(scored, "key", k, "order_bits")) if k else F.lit(False)
    return scored.withColumn("kept", kept).drop("order_bits")
