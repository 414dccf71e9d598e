"""Operator 7, LM scoring by compression cross-entropy.

Two dictionaries stand for two language models: one of in-domain text, one of general text. What they are made of grows with
the corpus and covers all of it. Every word of every document is counted; the words that would save most bytes fill a part
of fixed size, DICTIONARY_BYTES, the best last. The other part has no bound: it is every phrase of PHRASE words that
documents of the domain hold. A document can only use the phrases that it holds itself, so it is compressed under just
these: windows are hashed and exchanged between chunks (see chunks.py), each chunk learns which of its windows another
document (in the domain) holds too, and a document's windows of that kind merge into runs of words. The size of a document
is what it adds to a stream that its runs begin, under the dictionary of the common words. A document's own text counts only
if another row has it as well.

The score is the difference of the zstandard sizes under the general and the in-domain dictionary, divided by the length:
bytes a byte that in-domain knowledge saves. Cross-entropies in bits a byte come with it, and how many of the words other
documents hold in phrases.

Defined results: null and empty texts have no bytes and null scores; a null condition counts as false; ties between words
go by the word; words of more than PIECE bytes count as pieces of PIECE bytes; a text with fewer words than a phrase is one
phrase; repeated rows repeat, and know each other; rows may share ids or have none; an empty table gives an empty result;
other columns are ignored; a very long text takes a few times its bytes of memory.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import as_bytes, persist, small_batches, tidy

DICTIONARY_BYTES = 112_640
LEVEL = 3
#: A word's reference costs about so many bytes, so shorter words save nothing.
REFERENCE = 3
PIECE = 64
PHRASE = 8
FLUSH = 150_000
RESULT = "doc_id long, n_bytes long, in_bytes long, general_bytes long, in_bits double, general_bits double, score double, n_words long, n_in_seen long, n_seen long"


def word_counts(docs: DataFrame, in_domain: Column) -> DataFrame:
    """word (binary), n, n_in over all documents."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(in_domain, F.lit(False)).alias("inside"), "text")

    def emit(table: Counter, inside: Counter):
        for counts in (table, inside):
            for w in [w for w in counts if len(w) > PIECE]:
                n = counts.pop(w)
                for i in range(0, len(w), PIECE):
                    counts[w[i : i + PIECE]] += n
        words = list(table)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([table[w] for w in part], pa.int64()), pa.array([inside[w] for w in part], pa.int64())], ["word", "n", "n_in"])

    def run(batches):
        table: Counter = Counter()
        inside: Counter = Counter()
        for batch in batches:
            for flag, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = (text or b"").split()
                table.update(words)
                if flag:
                    inside.update(words)
            if len(table) > FLUSH:
                yield from emit(table, inside)
                table, inside = Counter(), Counter()
        yield from emit(table, inside)

    return rows.mapInArrow(run, "word binary, n long, n_in long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_in").alias("n_in"))


def dictionaries(docs: DataFrame, in_domain: Column, size: int = DICTIONARY_BYTES) -> tuple[bytes, bytes]:
    """(in-domain, general) dictionary contents of at most `size` bytes."""
    counts = persist(word_counts(docs, in_domain), "words")  # read twice
    most = size // (REFERENCE + 1)  # more words than fit
    length = F.octet_length("word")
    gain = lambda n: ((length - F.lit(REFERENCE)) * F.col(n)).alias("gain")
    best = []
    for n, domain in (("n_in", 0), ("n", 1)):
        best.append(counts.where(length > REFERENCE).select(F.lit(domain).alias("domain"), "word", gain(n)).where("gain > 0").orderBy(F.desc("gain"), "word").limit(most))
    chosen = best[0].unionByName(best[1]).collect()  # bounded by the dictionary size
    out = []
    for domain in (0, 1):
        words, held = [], 0
        for _, word, _ in sorted((r for r in chosen if r[0] == domain), key=lambda r: (-r[2], bytes(r[1]))):
            if held + len(word) + 1 <= size:
                words.append(bytes(word))
                held += len(word) + 1
        out.append(b" ".join(reversed(words)))
    return out[0], out[1]


class Compressor:
    """Sizes of texts under one dictionary, without frame overhead that all texts share."""

    WINDOW = 21  # of the level: far enough back for texts of a megabyte

    def __init__(self, content: bytes):
        self.content, self.by_window = content, {}

    def _with(self, window: int):
        """A compressor that looks back so far; the dictionary is digested once for each."""
        import zstandard as z

        if window not in self.by_window:
            plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            options = {"compression_params": z.ZstdCompressionParameters.from_level(LEVEL, window_log=window, enable_ldm=True, **plain)} if window > self.WINDOW else {"level": LEVEL, **plain}
            if len(self.content) >= 8:
                options["dict_data"] = z.ZstdCompressionDict(self.content, dict_type=z.DICT_TYPE_RAWCONTENT)
                if window == self.WINDOW:
                    options["dict_data"].precompute_compress(level=LEVEL)
            self.by_window[window] = z.ZstdCompressor(**options)
        return self.by_window[window]

    def size(self, text: bytes, known: bytes = b"") -> int:
        """Bytes of the text; behind what is known beside the dictionary, the bytes that it adds."""
        import zstandard as z

        window = (2 * (len(known) + len(text))).bit_length()
        compressor = self._with(min(max(window, self.WINDOW), 31))
        if not known:
            return len(compressor.compress(text))
        stream = compressor.compressobj()
        stream.compress(known + b" ")
        stream.flush(z.COMPRESSOBJ_FLUSH_BLOCK)
        return len(stream.compress(text)) + len(stream.flush())


class Phrases:
    """Hashes of the phrases of a chunk's documents."""

    def __init__(self, texts: list[bytes], width: int = PHRASE):
        self.words = [t.split() for t in texts]
        n = np.array([len(w) for w in self.words], np.int64)
        x = C.word_hashes([w for words in self.words for w in words])
        starts = np.cumsum(n) - n
        whole = C.rolling(x, width, C.BASE[0])
        count = np.maximum(n - width + 1, 0)
        doc = np.repeat(np.arange(len(n)), count)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        h = whole[at + starts[doc]] if len(doc) else np.empty(0, np.uint64)
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):  # one phrase of all the words, told apart by their number
            one = np.array([int(C.rolling(x[starts[d] : starts[d] + n[d]], int(n[d]), C.BASE[1])[0]) ^ int(n[d]) for d in short.tolist()], np.uint64)
            doc, at, h = np.concatenate([doc, short]), np.concatenate([at, np.zeros(len(short), np.int64)]), np.concatenate([h, C.mix(one)])
        self.n, self.doc, self.at, self.h, self.width = n, doc, at, h, width

    def holders(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending hashes, how many documents hold each, how many of them are inside."""
        order = np.lexsort((self.doc, self.h))
        h, doc = self.h[order], self.doc[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[once], doc[once]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        if not len(first):
            return h, first, first
        return h[first], np.diff(np.append(first, len(h))), np.add.reduceat(inside[doc].astype(np.int64), first)

    def runs(self, doc_marks: np.ndarray) -> tuple[list[list[bytes]], np.ndarray]:
        """For marked phrases, document by document: the maximal runs of words that they cover, and how many words those are."""
        ends = np.cumsum(self.n)
        cover = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
        begin = (ends - self.n)[self.doc[doc_marks]] + self.at[doc_marks]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + np.minimum(self.width, self.n[self.doc[doc_marks]]), -1)
        flags = (np.cumsum(cover)[:-1] > 0).astype(np.int8)
        out, seen = [], np.zeros(len(self.n), np.int64)
        for k, (words, end) in enumerate(zip(self.words, ends.tolist(), strict=True)):
            mine = flags[end - len(words) : end]
            seen[k] = int(mine.sum())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mine, [0]]))).tolist() if seen[k] else []
            out.append([b" ".join(words[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True)])
        return out, seen


def _emit(parts: int, count: int):
    """Of each chunk, by slice: its phrases with their holders, all and inside, two at most; and, in slices of their own, which
    of its rows are inside."""

    def flush(file, chunk, ids, texts, inside, numbers):
        flags = np.array(inside, bool)
        h, n, n_in = Phrases(texts).holders(flags)
        held = (np.minimum(n, 2) | np.minimum(n_in, 2) << 2).astype(np.uint8)
        bounds, rows = C.slices(h, parts), []
        for p in range(parts):
            a, b = bounds[p], bounds[p + 1]
            if b > a:
                rows.append((p, file, chunk, C.pack([h[a:b], held[a:b]])))
        marks = np.zeros(count, np.uint8)
        marks[np.array(numbers, np.int64)[flags] - chunk * count] = 1
        rows.append((parts + chunk % parts, file, chunk, np.packbits(marks).tobytes()))
        for i in range(0, len(rows), 64):
            yield C.block_batch(rows[i : i + 64])

    return lambda batches: C.by_chunk(batches, flush)


def _answer(table: pa.Table, parts: int) -> pa.Table:
    """Of one slice, to each chunk: the holders of its phrases in ascending order of their hashes, which the chunk knows. Marks
    of rows go back as they are."""
    part = table.column("slice")[0].as_py()
    if part >= parts:
        return table
    files, chunk, blocks = (table.column(i).to_pylist() for i in (1, 2, 3))
    keys = list(dict.fromkeys(zip(files, chunk, strict=True)))
    number = {k: i for i, k in enumerate(keys)}
    data = [C.unpack(b, [np.uint64, np.uint8]) for b in blocks]
    h, held = np.concatenate([d[0] for d in data]), np.concatenate([d[1] for d in data]).astype(np.int64)
    who = np.repeat([number[k] for k in zip(files, chunk, strict=True)], [len(d[0]) for d in data])
    order = np.argsort(h, kind="stable")
    h, held, who = h[order], held[order], who[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
    n, n_in = (np.minimum(np.add.reduceat(x, first), 2) for x in (held & 3, held >> 2))
    total = (n | n_in << 2).astype(np.uint8)[group]
    order = np.argsort(who, kind="stable")
    h, total, who = h[order], total[order], who[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (who[1:] != who[:-1])]  # two tasks may have read parts of a chunk
    total, who = total[once], who[once]
    cut = np.searchsorted(who, np.arange(len(keys) + 1))
    return pa.Table.from_batches([C.block_batch([(part, *key, C.squeeze(total[cut[k] : cut[k + 1]])) for k, key in enumerate(keys)])])


_compressors: dict[bytes, Compressor] = {}


def _compressor(content: bytes) -> Compressor:
    if content not in _compressors:
        if len(_compressors) > 4:
            _compressors.clear()
        _compressors[content] = Compressor(content)
    return _compressors[content]


def lm_score(docs: DataFrame, in_domain: Column, size: int = DICTIONARY_BYTES) -> DataFrame:
    """Rows of RESULT for every document. in_domain: a condition on columns of docs by name."""
    spark = docs.sparkSession
    paths = C.written(docs, spark)
    parts, count = paths.slices, paths.rows
    shared = spark.sparkContext.broadcast(dictionaries(docs, in_domain, size))  # twice `size` at most
    rows = C.rows_of(spark, paths, more=(F.coalesce(in_domain, F.lit(False)).alias("inside"),))
    sent = rows.mapInArrow(_emit(parts, count), C.BLOCK)
    every = C.chunks_of(spark, paths).unionByName(sent.groupBy("slice").applyInArrow(lambda t: _answer(t, parts), C.BLOCK))

    def run(table: pa.Table) -> pa.Table:
        inner, general = map(_compressor, shared.value)
        held = C.read_chunk(table.column("file")[0].as_py(), table.column("chunk")[0].as_py(), count, ["doc_id", "text"])
        _, texts = C.ids_and_texts(held)
        blocks = sorted((p, b) for p, b in zip(table.column("slice").to_pylist(), table.column("block").to_pylist(), strict=True) if b)
        inside = np.zeros(count, bool)
        for p, b in blocks:
            if p >= parts:
                inside |= np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool)
        phrases = Phrases(texts)
        h, _, _ = phrases.holders(inside)
        told = [C.loosen(b, np.uint8) for p, b in blocks if p < parts]
        known = np.concatenate(told) if told else np.empty(0, np.uint8)
        if len(known) != len(h):
            raise ValueError("answers don't match the chunk")
        mine = known[np.searchsorted(h, phrases.h)] if len(h) else np.empty(0, np.uint8)
        runs, seen = phrases.runs(np.flatnonzero((mine & 3) > 1))
        in_runs, in_seen = phrases.runs(np.flatnonzero((mine >> 2) > inside[phrases.doc]))
        out = []
        for k, text in enumerate(texts):
            n = len(text)
            counts = (len(phrases.words[k]), int(in_seen[k]), int(seen[k]))
            if n:
                a, b = inner.size(text, b" ".join(in_runs[k])), general.size(text, b" ".join(runs[k]))
                out.append((n, a, b, 8 * a / n, 8 * b / n, (b - a) / n, *counts))
            else:
                out.append((0, 0, 0, None, None, None, *counts))
        kinds = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.int64()] * 3
        names = [c.split()[0] for c in RESULT.split(", ")]
        del texts, phrases, runs, in_runs
        tidy()
        return pa.table({"doc_id": held.column("doc_id").cast(pa.int64())} | {c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names[1:], kinds, strict=True))})

    return C.by_place(every, paths).applyInArrow(run, RESULT)
