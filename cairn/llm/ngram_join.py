"""Operator 4, exact n-gram Jaccard join over prefix trees.

A document's set holds the hashes of its distinct 2-word shingles. Equal sets form one class; a class is joined once, by
the smallest document that holds it. Classes go by that row's place in the table (file and row), which is unique where ids
aren't; ids only name the results.

Candidates are found by marks, not by shingles: a single shingle, however rare, is held by more classes the more documents
there are, and so are the candidates of each. A mark is a pair of shingles that are neighbours in the set sorted by hash,
both ends counting as shingles, so a set of n shingles has n + 1 marks. In the sorted union of two sets each shingle that
only one of them holds parts two neighbours at most: sets of m and n shingles that share c share 3c - m - n + 1 marks at
least, which is more than (m + n) / 8 from a similarity of 0.6 on. Marks have a global order, rarest first: frequencies
come from an exchange of hashes between chunks (see chunks.py), ties go by hash. So similar sets share a mark in their
prefixes of n + 1 - ceil(n / 5) marks, and marks that no other class holds need no posting.

Each posting's mark has a leader, the smallest class that holds it in its prefix, and a class goes to the groups of its
leaders if a partner passes the bound on the common marks that their positions leave. In a group the sets, ordered by how
many there hold a shingle, form a trie, stored as flat arrays of edges; each set walks it level by level, all edges of a
level at once, adding up the overlap that sets below an edge share, and leaves subtrees whose remaining lengths can't reach
the needed overlap. A pair counts in the group of its first common mark, so it counts once. Groups beyond GROUP classes are
cut into blocks, and pairs of blocks are tasks of their own. Nothing but a count per class and the edges of a spanning
forest leaves a group.

Defined results: words are cut at ASCII white space and A-Z lower-cased; one word alone is its own shingle; documents
without words (or null) have the empty set, link with nothing and are their own component; rows that share an id are each
a document; null ids sort last; an empty table gives an empty result; extra columns are ignored; a
very long text is held whole in one task, and joins those of its length only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C
from .common import persist, tidy

#: Classes in one task of a group.
GROUP = 512
#: Marks of a class that a group gets beside its own, the first that others may hold: by them most pairs that count elsewhere
#: are left out before their sets are read.
HEADS = 16
PERCENT = 60
#: name: the row's place, file number and row number; rep and low: name and id of the class's smallest row; rare: how many
#: marks no other class holds; grams, often: the set and its marks' frequencies, see _unfold.
SETS = "name long, doc_id long, n long, low long, rep long, mult long, own boolean, rare int, grams binary, often binary"
_ONE = np.uint64(0xA0761D6478BD642F)
_ENDS = np.array([0], np.uint64), np.array([2**64 - 1], np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return _set(C.word_hashes(text.lower().split()))


def _set(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return C.mix(x ^ _ONE)
    return np.unique(C.mix(x[:-1] * C.BASE[0] + x[1:]))


def marks(s: np.ndarray) -> np.ndarray:
    """Hashes of the neighbours in a sorted set, its ends included: one more than it has shingles."""
    x = np.concatenate([_ENDS[0], s, _ENDS[1]])
    return C.mix(x[:-1] * C.BASE[0] + x[1:])


def _fold(s: np.ndarray, often: np.ndarray) -> tuple[bytes, bytes]:
    """A sorted set as differences, and the frequencies of its marks."""
    return C.squeeze(np.diff(s, prepend=np.uint64(0))), C.squeeze(often)


def _unfold(grams: bytes, often: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set, and its ordered marks (frequency, then 48 bits)."""
    s = np.cumsum(C.loosen(grams, np.uint64), dtype=np.uint64)
    return s, np.sort(C.loosen(often, np.uint16).astype(np.uint64) << np.uint64(48) | marks(s) >> np.uint64(16))


def _chunk_sets(ids, texts: list[bytes]):
    """Per document of a chunk: its set and the two halves of the set's key."""
    sets = [shingles(t) for t in texts]
    keys = [(int(s.sum(dtype=np.uint64)), int(C.mix(s + C.BASE[1]).sum(dtype=np.uint64))) for s in sets]
    return np.asarray(ids, np.int64), sets, keys


def _name(number: int, row: int) -> int:
    return (number << 40) + row


def _classes(ids, sets, keys, names: list[int]):
    """Of the non-empty classes of a chunk: k1, k2, smallest id, members, set, name of the smallest; ascending k1."""
    table: dict[tuple, list] = {}
    for doc, s, k, name in zip(ids.tolist(), sets, keys, names, strict=True):
        if len(s):
            got = table.setdefault((*k, len(s)), [doc, 0, s, name])
            got[0], got[3] = min((got[0], got[3]), (doc, name))
            got[1] += 1
    order = sorted(table)
    return order, [table[k] for k in order]


def _held(classes: list) -> tuple[np.ndarray, np.ndarray]:
    """The marks (40 bits) of a chunk's classes, ascending, and how many classes hold each."""
    return np.unique(np.concatenate([marks(c[2]) for c in classes]) >> np.uint64(24), return_counts=True)


def _blocks(parts: int, numbers: dict[str, int]):
    def flush(file, chunk, ids, texts, rows):
        order, classes = _classes(*_chunk_sets(ids, texts), [_name(numbers[file], r) for r in rows])
        if not order:
            return
        h, n = _held(classes)
        n = np.minimum(n, 65535).astype(np.uint16)
        k1 = np.array([k[0] for k in order], np.uint64)
        k2 = np.array([k[1] for k in order], np.uint64)
        size = np.array([k[2] for k in order], np.uint32)
        low = np.array([c[0] for c in classes], np.int64)
        many = np.array([c[1] for c in classes], np.int64)
        name = np.array([c[3] for c in classes], np.int64)
        a, b = C.slices(h, parts, 40), C.slices(k1, parts)
        rows = []
        for p in range(parts):
            i, j = slice(a[p], a[p + 1]), slice(b[p], b[p + 1])
            if i.stop > i.start or j.stop > j.start:
                left = C.pack([h[i], n[i]])
                rows.append((p, file, chunk, len(left).to_bytes(4, "little") + left + C.pack([k1[j], k2[j], size[j], low[j], name[j], many[j]])))
        for i in range(0, len(rows), 64):
            yield C.block_batch(rows[i : i + 64])

    return lambda batches: C.by_chunk(batches, flush)


def _answer(table: pa.Table) -> pa.Table:
    """Of one slice, to each chunk: frequencies of its marks in ascending order (the chunk knows them, so they aren't sent
    back), smallest row and members of its classes, and how often a class itself counts. A chunk that two tasks read has two blocks and gets one answer."""
    part = table.column("slice")[0].as_py()
    files, chunk, blocks = (table.column(i).to_pylist() for i in (1, 2, 3))
    keys = list(dict.fromkeys(zip(files, chunk, strict=True)))
    number = {k: i for i, k in enumerate(keys)}
    owner = [number[k] for k in zip(files, chunk, strict=True)]
    left, right = [], []
    for b in blocks:
        n = int.from_bytes(b[:4], "little")
        left.append(C.unpack(b[4 : 4 + n], [np.uint64, np.uint16]))
        right.append(C.unpack(b[4 + n :], [np.uint64, np.uint64, np.uint32, np.int64, np.int64, np.int64]))
    h = np.concatenate([x[0] for x in left])
    who = np.repeat(owner, [len(x[0]) for x in left])
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    n = np.concatenate([x[1] for x in left])[order].astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    total = np.add.reduceat(n, np.flatnonzero(new)) if len(h) else n
    df = np.minimum(total, 65535).astype(np.uint16)[np.cumsum(new) - 1]
    order = np.argsort(who, kind="stable")  # stays sorted by hash within a chunk
    h, df, who = h[order], df[order], who[order]
    once = np.ones(len(h), bool)  # two blocks of a chunk may hold one mark
    once[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    df, who = df[once], who[once]
    cut = np.searchsorted(who, np.arange(len(keys) + 1))
    k1, k2, size, low, name, many = (np.concatenate([x[i] for x in right]) for i in range(6))
    who = np.repeat(owner, [len(x[0]) for x in right])
    order = np.lexsort((name, low, size, k2, k1))
    k1, k2, size, low, name, many, who = (x[order] for x in (k1, k2, size, low, name, many, who))
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (size[1:] != size[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    if len(k1):
        low, name, mult, own = low[first][group], name[first][group], np.add.reduceat(many, first)[group], np.diff(np.append(first, len(k1)))[group]
    else:
        mult = own = many
    order = np.argsort(who, kind="stable")
    k1, k2, size, low, name, mult, own, who = (x[order] for x in (k1, k2, size, low, name, mult, own, who))
    bound = np.searchsorted(who, np.arange(len(keys) + 1))
    rows = []
    for k, key in enumerate(keys):
        i, j = slice(cut[k], cut[k + 1]), slice(bound[k], bound[k + 1])
        told = C.squeeze(df[i])
        rows.append((part, *key, len(told).to_bytes(4, "little") + told + C.pack([k1[j], k2[j], size[j], low[j], name[j], mult[j], own[j]])))
    tidy()
    return pa.Table.from_batches([C.block_batch(rows)])


def prefix_length(n: int) -> int:
    """Marks of which a set of n shingles shares one with any similar set; of all its marks it shares more than n / 5."""
    return n + 1 - -(-n // 5)


def _ordered(table: pa.Table, numbers: dict[str, int], count: int) -> pa.Table:
    """Of one chunk with its answers: every row's class, and the set of each class that may have a partner."""
    file, chunk = table.column(1)[0].as_py(), table.column(2)[0].as_py()
    rows = C.read_chunk(file, chunk, count, ["doc_id", "text"])
    ids, sets, keys = _chunk_sets(*C.ids_and_texts(rows))
    first = _name(numbers[file], chunk * count)
    freq, owner = [], {}
    for _, b in sorted((p, b) for p, b in zip(table.column("slice").to_pylist(), table.column(3).to_pylist(), strict=True) if b):
        n = int.from_bytes(b[:4], "little")
        freq.append(C.loosen(b[4 : 4 + n], np.uint16))
        k1, k2, size, *found = (x.tolist() for x in C.unpack(b[4 + n :], [np.uint64, np.uint64, np.uint32, np.int64, np.int64, np.int64, np.int64]))
        owner.update(zip(zip(k1, k2, size, strict=True), zip(*found, strict=True), strict=True))
    _, classes = _classes(ids, sets, keys, list(range(first, first + len(sets))))
    h, df = (_held(classes)[0], np.concatenate(freq)) if classes else (np.empty(0, np.uint64), np.empty(0, np.uint16))
    assert len(h) == len(df)
    out: list[tuple] = []
    for name, (doc, s, k) in enumerate(zip(ids.tolist(), sets, keys, strict=True), first):
        n = len(s)
        if not n:
            out.append((name, doc, 0, doc, name, 1, False, 0, None, None))
            continue
        low, rep, mult, own = owner[(*k, n)]
        rare, folds = 0, (None, None)
        if rep == name:
            f = df[np.searchsorted(h, marks(s) >> np.uint64(24))]
            rare = int((f == own).sum()) if own < 65535 else 0
            if rare < prefix_length(n):
                folds = _fold(s, f)
        out.append((name, doc, n, low, rep, mult, rep == name, rare, *folds))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
    del rows, sets, keys, classes, h, df, owner
    tidy()
    return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in SETS.split(", ")])


def ordered_sets(spark: SparkSession, paths: C.Chunked) -> DataFrame:
    numbers, count = C.file_numbers(spark, paths), paths.rows
    sent = C.rows_of(spark, paths).mapInArrow(_blocks(paths.slices, numbers), C.BLOCK)
    every = C.chunks_of(spark, paths).unionByName(sent.groupBy("slice").applyInArrow(_answer, C.BLOCK))
    return persist(C.by_place(every, paths).applyInArrow(lambda t: _ordered(t, numbers, count), SETS), "sets")


FAR = np.uint32(2**32 - 1)  # a size that no partner has
NEVER = np.int64(-(2**62))


def _postings(reps: list, sizes: list, rares: list, grams: list, often: list) -> tuple[np.ndarray, ...]:
    """key, rep, n, at of the prefixes of sets' ordered marks, but for marks that a set alone holds; ascending by key, which
    is the mark with its hash in front, so that keys spread evenly."""
    t, who, n, at = [np.empty(0, np.uint64)], [], [], []
    for rep, size, rare, *folds in zip(reps, sizes, rares, grams, often, strict=True):
        x = _unfold(*folds)[1][rare : prefix_length(size)]
        t.append(x)
        who.append(np.full(len(x), rep, np.int64))
        n.append(np.full(len(x), size, np.int64))
        at.append(np.arange(rare, rare + len(x)))
    x = np.concatenate(t)
    x = x << np.uint64(16) | x >> np.uint64(48)
    order = np.argsort(x, kind="stable")
    join = lambda parts: np.concatenate(parts)[order] if parts else np.empty(0, np.int64)
    return x[order], join(who), join(n), join(at)


def _room(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What is left of a set's marks from a place on, and its size's bound on a partner's: a pair passes if each one's room
    reaches 3 times the other's size (8 marks left for 1 of both sizes, and sizes 3 to 5 at most)."""
    return np.minimum(3 * (7 * n - 8 * at), 5 * n)


def _holders(key: np.ndarray, rep: np.ndarray, n: np.ndarray, room: np.ndarray):
    """Of postings sorted by key: the start of each key, how many hold it, the smallest rep and size, the largest room."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    if not len(first):
        return (first,) * 5
    return first, np.diff(np.append(first, len(key))), np.minimum.reduceat(rep, first), np.minimum.reduceat(n, first), np.maximum.reduceat(room, first)


def _pack_summary(key, rep, least, widest) -> bytes:
    names, which = np.unique(rep, return_inverse=True)
    head = C.pack([names.view(np.uint64)])
    return len(head).to_bytes(4, "little") + head + C.pack([key, which.astype(np.uint32), least.astype(np.uint32), widest])


def _unpack_summary(block: bytes):
    n = int.from_bytes(block[:4], "little")
    (names,) = C.unpack(block[4 : 4 + n], [np.uint64])
    key, which, least, widest = C.unpack(block[4 + n :], [np.uint64, np.uint32, np.uint32, np.int64])
    return key, names.view(np.int64)[which], least, widest


def _holder_blocks(parts: int):
    """Each chunk's holders of each mark, summed up: a mark is sent once a chunk, however many classes hold it."""

    def flush(file, chunk, rows):
        key, rep, n, at = _postings(*zip(*rows, strict=True))
        first, _, low, least, widest = _holders(key, rep, n, _room(n, at))
        key = key[first]
        bounds = C.slices(key, parts)
        out = [(p, file, chunk, _pack_summary(key[a:b], low[a:b], least[a:b], widest[a:b])) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        for i in range(0, len(out), 64):
            yield C.block_batch(out[i : i + 64])

    def run(batches):
        at, rows = None, []
        for batch in batches:
            for *row, file, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, chunk) != at:
                    if rows:
                        yield from flush(*at, rows)
                    at, rows = (file, chunk), []
                rows.append(row)
        if rows:
            yield from flush(*at, rows)

    return run


def _leaders(table: pa.Table) -> pa.Table:
    """Of one slice, to each chunk, for marks that other chunks hold too: the leader, and the others' smallest size and
    largest room."""
    files, chunk, blocks = (table.column(i).to_pylist() for i in (1, 2, 3))
    keys = list(dict.fromkeys(zip(files, chunk, strict=True)))
    number = {k: i for i, k in enumerate(keys)}
    parts = [_unpack_summary(b) for b in blocks]
    who = np.repeat([number[k] for k in zip(files, chunk, strict=True)], [len(p[0]) for p in parts])
    key, low, least, widest = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    shared = np.r_[False, same] | np.r_[same, False]
    order, key = order[shared], key[shared]
    low, least, widest, who = low[order], least[order], widest[order], who[order]
    if len(key):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        leader = np.minimum.reduceat(low, first)[group]

        def others(x: np.ndarray) -> np.ndarray:
            """Of each the smallest among the rest of its group."""
            by = np.lexsort((x, group))
            one, two = x[by[first]], x[by[first + 1]]
            mine = np.zeros(len(x), bool)
            mine[by[first]] = True
            return np.where(mine, two[group], one[group])

        least, widest = others(least.astype(np.int64)), -others(-widest)
    else:
        leader = low
    order = np.argsort(who, kind="stable")
    key, leader, least, widest, who = key[order], leader[order], least[order], widest[order], who[order]
    cut = np.searchsorted(who, np.arange(len(keys) + 1))
    rows = [(0, *keys[k], _pack_summary(key[a:b], leader[a:b], least[a:b], widest[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    return pa.Table.from_batches([C.block_batch(rows)])


def signature(tokens: np.ndarray) -> bytes:
    """Parity bits of the shingles that fall on each of 1.5 to 3 times as many places (a power of two) as there are shingles.
    Two sets differ in at least as many shingles as their signatures, folded to one width, differ in bits."""
    bits = max(64, 1 << int(1.5 * len(tokens)).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(signatures: list[bytes], size: int) -> np.ndarray:
    """Signatures of `size` bytes or more, as words of 64 bits, folded to `size` bytes."""
    out = np.empty((len(signatures), size // 8), np.uint64)
    for k, s in enumerate(signatures):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size // 8), 0)
    return out


LED = "leader long, rep long, n long, tokens binary, ats binary, bits binary, heads binary, place long"


def _led(table: pa.Table, numbers: dict[str, int], count: int) -> pa.Table:
    """Of one chunk of ordered sets with its answers, a row a leader and class: which marks that may have a partner the
    leader leads, where they are in the class, the class's signature and first marks, and the place of its row
    among the ordered sets."""
    file, chunk = table.column(1)[0].as_py(), table.column(2)[0].as_py()
    rows = C.read_chunk(file, chunk, count, ["rep", "n", "own", "rare", "grams", "often"])
    rows = list(zip(*(rows.column(c).to_pylist() for c in ("rep", "n", "rare", "grams", "often", "own")), range(_name(numbers[file], chunk * count), 2**63), strict=False))
    rows = [r for r in rows if r[5] and r[3] is not None]
    key, rep, n, at = _postings(*(list(c) for c in zip(*(r[:5] for r in rows), strict=True))) if rows else _postings([], [], [], [], [])
    room = _room(n, at)
    first, count, low, least, widest = _holders(key, rep, n, room)
    # one holder here: its partners are elsewhere; more: among themselves too
    leader, least, widest = low, np.where(count > 1, least, np.int64(FAR)), np.where(count > 1, widest, NEVER)
    told = [_unpack_summary(b) for b in table.column(3).to_pylist() if b]
    if told and len(first):
        tkey, tleader, tleast, twidest = (np.concatenate([t[i] for t in told]) for i in range(4))
        order = np.argsort(tkey)
        at_key = np.searchsorted(key[first], tkey[order])
        leader[at_key] = tleader[order]
        least[at_key] = np.minimum(least[at_key], tleast[order].astype(np.int64))
        widest[at_key] = np.maximum(widest[at_key], twidest[order])
    group = np.repeat(np.arange(len(first)), count)
    may = (room >= 3 * least[group]) & (widest[group] >= 3 * n) if len(first) else np.empty(0, bool)
    token = key >> np.uint64(16) | key << np.uint64(48)
    leader = (leader[group] if len(first) else rep)[may]
    token, rep, n, at = token[may], rep[may], n[may], at[may].astype(np.int32)
    order = np.lexsort((at, rep, leader))
    leader, token, rep, n, at = (x[order] for x in (leader, token, rep, n, at))
    first = np.flatnonzero(np.r_[True, (leader[1:] != leader[:-1]) | (rep[1:] != rep[:-1])]) if len(rep) else np.empty(0, np.int64)
    last = np.append(first[1:], len(rep))[: len(first)]
    asked = set(rep.tolist())
    held = {}
    for r in rows:
        if r[0] in asked:
            s, order = _unfold(*r[3:5])
            held[r[0]] = signature(s), order[r[2] : prefix_length(r[1])][:HEADS].tobytes(), r[6]
    mine = [held[r] for r in rep[first].tolist()]
    spans = list(zip(first.tolist(), last.tolist(), strict=True))
    tidy()
    longs = {"leader": leader[first], "rep": rep[first], "n": n[first]}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in longs.items()} | {"tokens": pa.array([token[a:b].tobytes() for a, b in spans], pa.binary()), "ats": pa.array([at[a:b].tobytes() for a, b in spans], pa.binary()), "bits": pa.array([m[0] for m in mine], pa.binary()), "heads": pa.array([m[1] for m in mine], pa.binary()), "place": pa.array([m[2] for m in mine], pa.int64())})


def led_postings(spark: SparkSession, paths: C.Chunked, numbers: dict[str, int]) -> DataFrame:
    """Rows of LED: postings travel as summaries by chunk, not as rows."""
    row, count = F.col("_metadata.row_index"), paths.rows
    rows = spark.read.parquet(*paths).where("own and grams is not null").select("rep", "n", "rare", "grams", "often", F.col("_metadata.file_path").alias("file"), F.floor(row / F.lit(count)).cast("long").alias("chunk"))
    sent = rows.mapInArrow(_holder_blocks(paths.slices), C.BLOCK)
    every = C.chunks_of(spark, paths).unionByName(sent.groupBy("slice").applyInArrow(_leaders, C.BLOCK))
    return persist(C.by_place(every, paths).applyInArrow(lambda t: _led(t, numbers, count), LED), "postings")


def _first_shared(marks: list[np.ndarray], left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Of each two of these classes (at most about 2 GROUP) the first mark that both hold, 0 if there is none; and the value
    in `left`, one for each mark of each class, that it has in the first of the two."""
    m = len(marks)
    token, who = np.concatenate(marks), np.repeat(np.arange(m), [len(t) for t in marks])
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
    end = np.append(cut[1:], len(token))[: len(cut)]
    first, rest = np.zeros((m, m), np.uint64), None if left is None else np.zeros((m, m), np.int64)
    if len(cut):
        # of the marks that the same classes hold, the first will do
        holders = np.add.reduceat(C.mix(who.astype(np.uint64) + C.BASE[0]), cut)
        cut, end, holders = (x[end - cut > 1] for x in (cut, end, holders))
        one = np.sort(np.unique(holders, return_index=True)[1])
        for a, b in zip(cut[one][::-1].tolist(), end[one][::-1].tolist(), strict=True):
            w = who[a:b]
            at = w[:, None], w[None]
            first[at] = token[a]
            if rest is not None:
                rest[at] = left[order[a:b]][:, None]
    return first, rest


def _survivors(table: pa.Table) -> pa.Table:
    """Of one task of a group: the classes with a partner that first marks, positions and signatures allow, and where the
    group's marks are in them."""
    leader, i, j = (table.column(c)[0].as_py() for c in ("leader", "i", "j"))
    place, n, block = (table.column(c).to_numpy() for c in ("place", "n", "block"))
    tokens, ats, bits, heads = (table.column(c).to_pylist() for c in ("tokens", "ats", "bits", "heads"))
    m = len(place)
    at = np.frombuffer(b"".join(ats), np.int32).astype(np.int64)
    first, left = _first_shared([np.frombuffer(t, np.uint64) for t in tokens], np.repeat(n, [len(a) // 4 for a in ats]) - at)
    before = _first_shared([np.frombuffer(t, np.uint64) for t in heads])[0]
    may = (first > 0) & ((before == 0) | (before >= first)) & (8 * np.minimum(left, left.T) >= n[:, None] + n[None])
    sizes = 5 * n[:, None] >= 3 * n[None]
    may &= sizes & sizes.T
    if i != j:
        may &= block[:, None] != block[None]
    x, y = np.nonzero(np.triu(may, 1))
    size = np.array([len(b) for b in bits])
    narrow = np.minimum(size[x], size[y])
    good = np.zeros(len(x), bool)
    for width in np.unique(narrow).tolist():
        rows = np.flatnonzero(size >= width)
        index = np.zeros(m, np.int64)
        index[rows] = np.arange(len(rows))
        words = folded([bits[r] for r in rows.tolist()], width)
        pairs = np.flatnonzero(narrow == width)
        for p in np.array_split(pairs, max(1, len(pairs) * width // (8 << 20))):
            apart = np.bitwise_count(words[index[x[p]]] ^ words[index[y[p]]]).sum(1, dtype=np.int64)
            good[p] = 4 * apart <= n[x[p]] + n[y[p]]
    alive = np.unique(np.concatenate([x[good], y[good]]))
    return pa.table(
        {
            "leader": pa.array([leader] * len(alive), pa.int64()),
            "i": pa.array([i] * len(alive), pa.int32()),
            "j": pa.array([j] * len(alive), pa.int32()),
            "place": pa.array(place[alive], pa.int64()),
            "block": pa.array(block[alive], pa.int32()),
            "ats": pa.array([ats[k] for k in alive.tolist()], pa.binary()),
        }
    )


SHIPPED = "leader long, i int, j int, block int, ats binary, rep long, low long, mult long, n long, grams binary, often binary"


def _ship(table: pa.Table, files: list[str], count: int) -> pa.Table:
    """The sets that the groups ask of one chunk, read from its file; a set is shipped once a group."""
    place = table.column("place").to_numpy()
    row = place & ((1 << 40) - 1)
    chunk = int(row[0]) // count
    rows = C.read_chunk(files[int(place[0] >> 40)], chunk, count, ["rep", "low", "mult", "n", "grams", "often"])
    asked, which = np.unique(row - chunk * count, return_inverse=True)
    rows = rows.take(pa.array(asked))
    which = pa.array(which)
    return pa.table({c: table.column(c) for c in ("leader", "i", "j", "block", "ats")} | {c: rows.column(c).take(which) for c in ("rep", "low", "mult", "n", "grams", "often")})


def _ranked(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets' shingles as ranks, those that fewest of the sets hold first, without those that one set alone holds."""
    shingle, which, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(shingle), np.uint64)
    rank[np.lexsort((shingle, held))] = np.arange(len(shingle), dtype=np.uint64)
    ends = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(r[h > 1]) for r, h in zip(np.split(rank[which], ends), np.split(held[which], ends), strict=True)]


class Trie:
    """Ordered sets as a radix tree of flat edge arrays, level by level."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray | None = None):
        """sizes: of the whole sets, if `sets` leave out shingles that no other set holds."""
        big = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=big.__getitem__)
        ordered = [sets[k] for k in self.order]
        size = np.array([len(s) for s in ordered])
        whole = size if sizes is None else np.asarray(sizes)[self.order]
        common = np.zeros(len(ordered) + 1, np.int64)
        for k in range(1, len(ordered)):
            a, b = ordered[k - 1], ordered[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common[k] = differ[0] if len(differ) else m
        # an edge: parent, level, tokens [start, stop) of document `via`, documents [low, high) below it
        edges: list[list[int]] = []
        self.leaf = np.full(len(ordered), -1)
        stack = [(0, len(ordered), 0, -1, 0)]
        while stack:
            low, high, depth, parent, level = stack.pop()
            while low < high and size[low] == depth:  # ends here
                self.leaf[low] = parent
                low += 1
            at = low
            while at < high:
                end = at + 1
                while end < high and common[end] > depth:
                    end += 1
                stop = int(min(size[at], common[at + 1 : end].min())) if end > at + 1 else int(size[at])
                edges.append([parent, level, depth, stop, at, end])
                stack.append((at, end, stop, len(edges) - 1, level + 1))
                at = end
        e = np.array(edges, np.int64).reshape(-1, 6)
        self.parent, self.level, start, self.depth, via, low = e[:, 0], e[:, 1], e[:, 2], e[:, 3], e[:, 4], e[:, 4]
        high = e[:, 5]
        self.length = self.depth - start
        self.tokens = np.concatenate([ordered[v][a:b] for v, a, b in zip(via.tolist(), start.tolist(), self.depth.tolist(), strict=True)]) if len(e) else np.empty(0, np.uint64)
        self.first = np.cumsum(self.length) - self.length
        self.last = self.tokens[self.first + self.length - 1] if len(e) else self.tokens
        self.longest = np.array([size[a:b].max() for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        self.most = np.array([whole[a:b].max() for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        self.least = np.array([whole[a:b].min() for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        self.levels = [np.flatnonzero(self.level == k) for k in range(int(self.level.max()) + 1)] if len(e) else []
        self.sizes = whole
        values, self.local = np.unique(self.tokens, return_inverse=True)
        self.values = values
        self.mask = np.zeros(len(values) + 1, bool)

    def overlaps(self, x: np.ndarray, n: int | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """(positions in self.order, overlaps) of the sets that x may be similar to; the overlap of each is exact."""
        at = np.searchsorted(self.values, x)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == x)]
        self.mask[at] = True
        n = len(x) if n is None else n
        over = np.full(len(self.parent) + 1, -1, np.int64)
        over[-1] = 0  # the root, as parent -1
        for level in self.levels:
            e = level[over[self.parent[level]] >= 0]
            e = e[(100 * self.most[e] >= percent * n) & (100 * n >= percent * self.least[e])]
            if not len(e):
                break
            length = self.length[e]
            ends = np.cumsum(length)
            index = np.arange(ends[-1]) - np.repeat(ends - length - self.first[e], length)
            shared = over[self.parent[e]] + np.add.reduceat(self.mask[self.local[index]].astype(np.int64), ends - length)
            rest = np.minimum(len(x) - np.searchsorted(x, self.last[e], "right"), self.longest[e] - self.depth[e])
            good = (100 + percent) * (shared + rest) >= percent * (n + self.least[e])
            over[e[good]] = shared[good]
        self.mask[at] = False
        got = over[self.leaf]
        got[self.leaf < 0] = -1
        ok = (got >= 0) & ((100 + percent) * got >= percent * (n + self.sizes))
        return np.flatnonzero(ok), got[ok]


LINKS = "rep long, low long, partners long, root long"


def _links(table: pa.Table) -> pa.Table:
    """Of one task of a group: for each class the documents that it links with here, and its root in a spanning forest."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    rep, mult, block = (table.column(c).to_numpy() for c in ("rep", "mult", "block"))
    held = [_unfold(g, o) for g, o in zip(table.column("grams").to_pylist(), table.column("often").to_pylist(), strict=True)]
    sets, order = [x[0] for x in held], [x[1] for x in held]
    ats = [np.frombuffer(b, np.int32) for b in table.column("ats").to_pylist()]
    size = table.column("n").to_numpy()
    m = len(sets)
    partners = np.zeros(m, np.int64)
    root = list(range(m))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    if m:
        # the pairs whose first common mark is led by this group
        mine = np.isin(_first_shared(order)[0], np.concatenate([o[a] for o, a in zip(order, ats, strict=True)]))
        np.fill_diagonal(mine, False)
        if i != j:
            mine &= block[:, None] != block[None]
        some = np.flatnonzero(mine.any(1))
        if len(some):
            sets = _ranked([sets[k] for k in some.tolist()])
            trie = Trie(sets, size[some])
            ordered = some[trie.order]
            for k, a in enumerate(ordered.tolist()):
                found = trie.overlaps(sets[trie.order[k]], int(size[a]))[0]
                others = ordered[found[found > k]]
                others = others[mine[a, others]]
                partners[a] += mult[others].sum()
                partners[others] += mult[a]
                for b in others.tolist():
                    x, y = find(a), find(b)
                    if x != y:
                        root[max(x, y)] = min(x, y)
    at = np.flatnonzero(partners)
    low = table.column("low").to_numpy()
    return pa.table({"rep": pa.array(rep[at], pa.int64()), "low": pa.array(low[at], pa.int64()), "partners": pa.array(partners[at], pa.int64()), "root": pa.array([int(rep[find(k)]) for k in at.tolist()], pa.int64())})


def components(edges: DataFrame, a: str, b: str, at_once: int = 0) -> DataFrame:
    """node, component: the smallest node reachable, in rounds of large-star and small-star, each written to the shared folder,
    until a round changes nothing. at_once: a caller who knows that there are at most so many edges may have them joined on
    the driver instead."""
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = persist(e, "edges")
    if at_once and e.count() <= at_once:
        root: dict[int, int] = {}

        def find(k: int) -> int:
            while root.setdefault(k, k) != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for u, v in e.collect():
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        table = pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array([find(k) for k in nodes], pa.int64())})
        return spark.createDataFrame(table) if nodes else spark.createDataFrame([], "node long, component long")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    last = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").where("u <> v").distinct()
        e = persist(e, "edges")
        now = mark(e)
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        last = now


def links(sets: DataFrame) -> DataFrame:
    """rep, low, partners, root over the ordered sets: partners counts documents of other classes."""
    spark = sets.sparkSession
    paths = C.written(sets, spark)
    numbers, count = C.file_numbers(spark, paths), paths.rows
    files = sorted(numbers, key=numbers.__getitem__)
    posts = led_postings(spark, paths, numbers)
    sizes = posts.groupBy("leader").agg(F.count("*").alias("m"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / F.lit(GROUP))).cast("int")
    posts = posts.join(sizes.where("m > 1").select("leader", blocks.alias("blocks")), "leader").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    held = ["place", "n", "tokens", "ats", "bits", "heads", "block"]
    tasks = posts.select("leader", *held, other.alias("other"))
    tasks = tasks.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *held)
    alive = tasks.groupBy("leader", "i", "j").applyInArrow(_survivors, "leader long, i int, j int, place long, block int, ats binary")
    chunk = F.floor(F.col("place").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(count))
    asked = alive.groupBy(F.shiftright("place", 40).alias("file"), chunk.alias("chunk"))
    shipped = asked.applyInArrow(lambda t: _ship(t, files, count), SHIPPED)
    return shipped.groupBy("leader", "i", "j").applyInArrow(_links, LINKS)


def grouped(spark: SparkSession, paths: C.Chunked) -> DataFrame:
    """Every row of the ordered sets without tokens, with partners, and id (least) and name (first) of the smallest row of
    its component."""
    sets = ordered_sets(spark, paths)
    found = persist(links(sets), "links")
    classes = found.groupBy("rep").agg(F.min("low").alias("low"), F.sum("partners").alias("partners"))
    classes = classes.join(components(found.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep"), "rep")
    best = classes.groupBy("component").agg(F.min(F.struct("low", "rep")).alias("best"))
    classes = classes.join(best, "component").select("rep", "partners", "best")
    rows = sets.select("name", "doc_id", "n", "low", "rep", "mult").join(classes, "rep", "left")
    return rows.withColumns({"partners": F.coalesce("partners", F.lit(0)), "least": F.coalesce("best.low", "low"), "first": F.coalesce("best.rep", "rep")}).drop("best")


def similar(spark: SparkSession, docs: DataFrame | str) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id, class_id of every row."""
    clean = lambda c: F.when(F.col(c) != F.lit(C.NO_ID), F.col(c))
    return grouped(spark, C.written(docs, spark)).select(
        clean("doc_id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        (F.col("partners") + F.col("mult") - 1).cast("long").alias("n_similar"),
        clean("least").alias("component_id"),
        clean("low").alias("class_id"),
    )
