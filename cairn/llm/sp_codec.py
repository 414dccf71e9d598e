"""Operator 8, SentencePiece encoding and decoding by a merge-type prefix table.

A text is a sequence of units: a run of word marks (U+2581, what a space becomes) and the characters up to the next mark;
no piece of a merge model reaches over a unit's end. For a unit the table keeps, for each prefix, the unique last token
of its encoding: of the tokens that an Aho-Corasick automaton finds ending there, the one compatible with the last token
of the prefix that it leaves. The ids are recovered backwards from the last prefix. Two tokens are compatible if, their
merges undone from the latest, no merge over the seam would have come first. Runs of marks, whose pieces share one score,
are merged from the left, as the library does. Characters outside the vocabulary become their bytes.

Defined results: null and empty texts have no ids, and decode to the empty text; repeated rows repeat; an empty table
gives an empty result; columns besides doc_id and text are ignored; a very long text is read unit by unit, a very long unit in
time that grows with its length.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Generations, as_bytes, small_batches, spread

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MARK = "▁"


def merge_plainly(text: str, score: dict[str, float]) -> list[str]:
    """Best-scored pair first, leftmost among equals: the definition, in quadratic time."""
    parts = list(text)
    while True:
        best = None
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best[0]):
                best = (s, i)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class PieceCodec:
    """Encodes and decodes with a merge-type SentencePiece model."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity" or not model.trainer_spec.byte_fallback:
            raise ValueError("a merge-type model with byte fallback and no normalisation is needed")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark after other characters")
        self.surface = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        # when a piece is made, later merges having higher ranks; single characters are never made
        self.rank = {p: -1.0 if len(p) == 1 else -s for p, s in self.score.items()}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1 and not p.startswith(MARK + MARK) and self.parts(p):
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.runs = {len(p) for p in self.ids if not p.strip(MARK)}
        self.cache = Generations(self._unit, 150_000)

    def parts(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of the piece's own encoding joins; None if it doesn't encode to itself."""
        if piece not in self.split:
            parts, last = list(piece), None
            while len(parts) > 1:
                s, i = max(((self.score.get(parts[i] + parts[i + 1], float("-inf")), -i) for i in range(len(parts) - 1)))
                if s == float("-inf"):
                    last = None
                    break
                i = -i
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.split[piece] = last
        return self.split[piece]

    def compatible(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, limit, fits = a, b, float("inf"), True
        while True:
            m = self.rank.get(x + y)
            if m is not None and m < limit:
                fits = False
                break
            rx, ry = self.rank.get(x, -1.0), self.rank.get(y, -1.0)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                limit, x = rx, self.parts(x)[1]
            else:  # of equal merges the left comes first, so one over the seam goes before y's own
                limit, y = ry + 0.5, self.parts(y)[0]
        if len(self.fits) > 500_000:
            self.fits.clear()
        self.fits[a, b] = fits
        return fits

    def pieces(self, word: str) -> list[str]:
        """The pieces of one unit with at most one mark, by the prefix table."""
        n = len(word)
        ending: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(word):
            ending[end].append(piece)
        last: list[str] = [""] * (n + 1)
        known, compatible = self.fits.get, self.compatible
        for i in range(1, n + 1):
            for piece in ending[i - 1]:
                k = i - len(piece)
                if k == 0:
                    last[i] = piece
                    break
                fits = known((last[k], piece))
                if compatible(last[k], piece) if fits is None else fits:
                    last[i] = piece
                    break
            else:  # only the character itself is left
                last[i] = word[i - 1]
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def marks(self, n: int) -> list[str]:
        """The pieces of n marks: the leftmost pair that makes a piece is merged, again and again."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in self.runs:
                stack.append(stack.pop() + stack.pop())
        return [MARK * k for k in stack]

    def _ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            out += [self.byte_ids[b] for b in p.encode()] if i is None else [i]
        return out

    def unit_ids(self, unit: str) -> list[int]:
        """unit: spaces for the marks beyond the first, then the word; one mark more goes before it."""
        word = unit.lstrip(" ")
        spare = len(unit) - len(word)
        if not word:
            return self._ids(self.marks(spare + 1))
        pieces = self.pieces(MARK + word)
        if spare:
            pieces = [*self.marks(spare + 1), *pieces[1:]] if pieces[0] == MARK else [*self.marks(spare), *pieces]
        return self._ids(pieces)

    def decode_ids(self, ids: list[int]) -> bytes:
        """The surfaces one after another, marks as spaces."""
        return b"".join([self.surface[i] for i in ids]).replace(MARK.encode(), b" ")

    def _unit(self, unit: str) -> tuple[bytes, bytes]:
        ids = self.unit_ids(unit)
        return ",".join(map(str, ids)).encode(), self.decode_ids(ids)

    @staticmethod
    def units(text: str) -> list[str]:
        units = text.replace(MARK, " ").split(" ")
        if "" not in units:
            return units
        out, spare = [], 0
        for u in units:
            if u:
                out.append(" " * spare + u)
                spare = 0
            else:
                spare += 1
        return out + [" " * (spare - 1)] * (spare > 0)

    def encode(self, text: str) -> list[int]:
        return [i for u in (self.units(text) if text else []) for i in self.unit_ids(u)]

    def decode(self, ids: list[int]) -> str:
        """Of ids that encode() gave."""
        return self.decode_ids(ids)[1:].decode("utf-8", "replace") if ids else ""

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text."""
        if not text:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        self.cache.turn()
        got = list(map(self.cache.__getitem__, self.units(text)))
        ids = b",".join([g[0] for g in got])
        back = b"".join([g[1] for g in got])[1:]
        return ids.count(b",") + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the general form, with the ids themselves."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = [codec(path).encode((x or b"").decode("utf-8")) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spread(docs, "cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the way back from encode()."""

    def run(batches):
        for batch in batches:
            texts = [codec(path).decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; one pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            got = [codec(path).digest((x or b"").decode("utf-8")) for x in as_bytes(batch.column(1))]
            n, ids, back = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs, "cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
