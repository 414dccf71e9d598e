"""Operator 9, token counts by finite-state transducers.

Two deterministic transducers are compiled from the tokenizer's file:

* PRETOKENS reads character classes and marks where pre-tokens start. A text is cut into chunks of equal length; each
  chunk's map from entry state to exit state is computed for all states at once, the maps are composed by a parallel
  prefix scan, and each chunk is then read once from its known entry state.
* CountTransducer reads the bytes of a pre-token. Its state is the last token of every prefix that a further token could
  still reach back to; each transition is annotated with the number of tokens it adds (which may be negative, when a
  longer token swallows earlier ones). States are compiled when first met and kept in a table of bounded size.

Both are exact: a prefix has one last token that can end it, the one compatible with the token before it.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows repeat; columns besides doc_id and text
are ignored; an empty table gives an empty result. A special string in a text is one token, as the library reads it;
a very long text is read chunk by chunk by one task, in memory of a few times its characters.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Generations, as_bytes, small_batches, spread

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
LETTER, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER, STMD, R, V, L, E, END = range(12)
(START, LETTERS, NUMBERS, OTHERS, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L) = range(12)
_WHITE = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
CHUNK = 256


def _continues(pieces, points: list[int], before: str, behind: str) -> np.ndarray:
    """For each code point, whether it stands in one piece with `before`, by the library's own splitting."""
    text, width = "".join(before + chr(c) + behind for c in points), len(before) + 1 + len(behind)
    starts = {a for _, (a, _) in pieces.pre_tokenize_str(text)}
    return np.array([k * width + len(before) not in starts for k in range(len(points))], bool)


def class_table(path: str | None = None) -> np.ndarray:
    """Class of every code point. Unicode grows, and the library at `path` follows tables of its own: where two other tables
    (an older and a newer one) don't agree, it is asked itself."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    old = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in points], np.uint8)
    new = np.full(len(points), OTHER, np.uint8)
    every = "".join(map(chr, points))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        new[[m.start() for m in regex.finditer(pattern, every)]] = kind
    if path is not None:
        from tokenizers import Tokenizer

        pieces = Tokenizer.from_file(path).pre_tokenizer
        open_ = np.flatnonzero(old != new)
        for at in range(0, len(open_), 4096):
            part = open_[at : at + 4096]
            asked = [points[k] for k in part.tolist()]
            letter, number = _continues(pieces, asked, "!a", "!"), _continues(pieces, asked, "!1", "!")
            old[part] = np.where(letter, LETTER, np.where(number, NUMBER, OTHER))
    table = np.full(0x110000, OTHER, np.uint8)
    table[points] = old
    for c in _WHITE:
        table[c] = WHITE
    table[32], table[39] = SPACE, APOSTROPHE
    for letters, c in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for x in letters:
            table[ord(x)] = c
    return table


def pretoken_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state and class. Output bit 1: a pre-token starts here; bit 2: one started a character ago."""
    go, out = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    letters = (LETTER, STMD, R, V, L, E)

    def begin(c: int) -> int:
        return LETTERS if c in letters else {NUMBER: NUMBERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, APOSTROPHE: QUOTE, OTHER: OTHERS, END: START}[c]

    def after_space(c: int) -> int:
        return LETTERS if c in letters else NUMBERS if c == NUMBER else OTHERS

    for state in range(12):
        for c in range(12):
            to, mark = begin(c), 1
            white = c in (SPACE, WHITE)
            if state == LETTERS and c in letters or state == NUMBERS and c == NUMBER or state == OTHERS and c in (OTHER, APOSTROPHE):
                to, mark = state, 0
            elif state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE) and white:
                to, mark = (MORE_SPACE if c == SPACE else MORE_WHITE), 0
            elif c == END:
                mark = 3 if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 1
            elif state == ONE_SPACE:
                to, mark = after_space(c), 0
            elif state == MORE_SPACE:
                to, mark = after_space(c), 2
            elif state == MORE_WHITE:
                mark = 3
            elif state == QUOTE:
                if c == STMD:
                    to, mark = START, 0
                elif c in (R, V, L):
                    to, mark = {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
                elif c in (OTHER, APOSTROPHE):
                    to, mark = OTHERS, 0
            elif state in (QUOTE_R, QUOTE_V, QUOTE_L):
                if c == (L if state == QUOTE_L else E):
                    to, mark = START, 0
                else:
                    to, mark = (LETTERS, 2) if c in letters else (begin(c), 3)
            go[state, c], out[state, c] = to, mark
    return go, out


def scan_starts(classes: np.ndarray, go: np.ndarray, out: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Start marks of a class sequence, by chunk maps composed through a prefix scan."""
    n = len(classes)
    k = -(-n // chunk)
    padded = np.full(k * chunk, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(k, chunk).T)
    flat_go, flat_out = go.ravel(), out.ravel()
    maps = np.broadcast_to(np.arange(12, dtype=np.uint8), (k, 12)).copy()
    wide = columns.astype(np.uint16)
    for j in range(min(16, chunk)):
        maps = flat_go[maps * np.uint16(12) + wide[j][:, None]]
    # most chunks lead to one state from anywhere by now: theirs is a constant map, one column is enough
    one = (maps == maps[:, :1]).all(1)
    same, rest = np.flatnonzero(one), np.flatnonzero(~one)
    ahead, open_maps = maps[same, 0], maps[rest]
    wide_same, wide_rest = np.ascontiguousarray(wide[:, same]), np.ascontiguousarray(wide[:, rest])
    for j in range(16, chunk):
        ahead = flat_go[ahead * np.uint16(12) + wide_same[j]]
        if len(rest):
            open_maps = flat_go[open_maps * np.uint16(12) + wide_rest[j][:, None]]
    maps[same], maps[rest] = ahead[:, None], open_maps
    step = 1
    while step < k:  # inclusive scan: maps[i] becomes the map of chunks 0..i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    state = np.empty(k, np.uint8)
    state[0], state[1:] = START, maps[:-1, START]
    marks = np.empty((chunk, k), np.uint8)
    for j in range(chunk):
        at = state * np.uint16(12) + wide[j]
        marks[j] = flat_out[at]
        state = flat_go[at]
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    start = (marks & 1).astype(bool)
    start[:-1] |= (marks[1:] & 2) != 0
    return start


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountTransducer:
    """Counts the merge tokens of byte strings. States are compiled on demand, at most `most_states` are kept."""

    def __init__(self, merges: list[tuple[bytes, bytes]], most_states: int = 20_000):
        ids = {bytes([b]): b for b in range(256)}
        self.left, self.right, self.pair = {}, {}, {}
        for rank, (a, b) in enumerate(merges):
            t = 256 + rank
            ids[a + b] = t
            self.left[t], self.right[t] = ids[a], ids[b]
            self.pair[ids[a], ids[b]] = t
        self.ids = ids
        self.prefixes = {t[:i] for t in ids for i in range(1, len(t) + 1)}
        self.proper: dict[int, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.most_states = most_states
        self.states: dict[tuple, int] = {(b"", ((-1, 0),)): 0}
        self.keys: list[tuple] = [(b"", ((-1, 0),))]
        self.edges: list[dict[int, tuple[int, int]]] = [{}]

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a: undoing merges from the latest, no merge across the seam would have come first."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, limit = a, b, 1 << 60
        while True:
            m = self.pair.get((x, y))
            if m is not None and m < limit:
                fits = False
                break
            if x > y:
                limit, x = x, self.right.get(x, -1)
                if x < 0:
                    fits = True
                    break
            else:
                limit, y = y + 1, self.left.get(y, -1)
                if y < 0:
                    fits = True
                    break
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[a, b] = fits
        return fits

    def _whole(self, t: int) -> bool:
        """Whether the token's own bytes encode to it."""
        known = self.proper.get(t)
        if known is None:
            known = t < 256 or self._whole(self.left[t]) and self._whole(self.right[t]) and self._alone(t)
            self.proper[t] = known
        return known

    def _alone(self, t: int) -> bool:
        """A token is whole if no split of its bytes into two compatible tokens ends in another last token."""
        x, y = self.left[t], self.right[t]
        limit = t
        while True:
            m = self.pair.get((x, y))
            if m is not None and m < limit:
                return False
            if x > y:
                limit, x = x, self.right.get(x, -1)
            else:
                limit, y = y + 1, self.left.get(y, -1)
            if x < 0 or y < 0:
                return True

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, window = self.keys[state]
        s = suffix + bytes([byte])
        while s not in self.prefixes:
            s = s[1:]
        for n in range(len(s), 0, -1):
            t = self.ids.get(s[-n:])
            if t is None:
                continue
            before, count = window[-n]
            if self._whole(t) if before < 0 else self.compatible(before, t) and self._whole(t):
                break
        else:
            raise AssertionError("no token ends this prefix")
        count += 1
        grown = (*window, (t, count))[-(len(s) + 1) :]
        key = (s, tuple((a, c - count) for a, c in grown))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.edges.append({})
        self.edges[state][byte] = to, count
        return to, count

    def count(self, data: bytes) -> int:
        """Runs the compiled transitions; where one is missing and the table is full, the rest is read without compiling."""
        state = total = 0
        edges = self.edges
        for i, byte in enumerate(data):
            step = edges[state].get(byte)
            if step is None:
                if len(self.keys) >= self.most_states:
                    return total + self._interpret(state, data, i)
                step = self._compile(state, byte)
            state = step[0]
            total += step[1]
        return total

    def _interpret(self, state: int, data: bytes, at: int) -> int:
        suffix, window = self.keys[state]
        last, count = [t for t, _ in window], [c for _, c in window]
        ids, prefixes, fits, proper = self.ids, self.prefixes, self.fits, self.proper
        low = at - len(suffix)
        for i in range(at, len(data)):
            end = i + 1
            while data[low:end] not in prefixes:
                low += 1
            for j in range(low, end):
                t = ids.get(data[j:end])
                if t is None:
                    continue
                k = j - end
                before = last[k]
                ok = proper.get(t)
                if ok is None:
                    ok = self._whole(t)
                if ok and before >= 0:
                    ok = fits.get((before, t))
                    if ok is None:
                        ok = self.compatible(before, t)
                if ok:
                    last.append(t)
                    count.append(count[k] + 1)
                    break
        return count[-1]


class TokenCounter:
    """Token counts of texts by a byte-level merge tokenizer's file. classes: of code points, if they are known already."""

    def __init__(self, path: str, classes: np.ndarray | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        read = lambda s: bytes(alphabet[c] for c in s)
        merges = [tuple(map(read, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.words = CountTransducer(merges)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.classes = class_table(path) if classes is None else classes
        self.go, self.out = pretoken_transducer()
        self.cache = Generations(lambda w: self.words.count(w.encode("utf-8")))

    def _plain(self, texts: list[str]) -> np.ndarray:
        """Counts of texts without special strings."""
        self.cache.turn()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(lengths) - 1
        whole = "\n".join(texts) + "\n"
        if whole.isascii():
            points = np.frombuffer(whole.encode("ascii"), np.uint8)
        else:
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        classes = self.classes[points]
        classes[ends] = END
        start = scan_starts(classes, self.go, self.out)
        begins = np.flatnonzero(start)
        stops = np.append(begins[1:], len(classes))
        # every END is marked as a start of its own; it ends the pre-token before it and holds none
        keep = classes[begins] != END
        begins, stops = begins[keep], stops[keep]
        get = self.cache.__getitem__
        words = [whole[i:j] for i, j in zip(begins.tolist(), stops.tolist())]  # noqa: B905
        counts = np.array(list(map(get, words)), np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        at = np.searchsorted(begins, np.append(0, ends + 1))
        return np.diff(total[at])

    def counts(self, texts: list[str]) -> list[int]:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                if s in text:
                    split = [p.split(s) for p in pieces]
                    extra[i] += sum(len(p) - 1 for p in split)
                    pieces = [q for p in split for q in p]
            parts += pieces
            owner += [i] * len(pieces)
        if not parts:
            return []
        return (np.bincount(owner, self._plain(parts), len(texts)).astype(np.int64) + extra).tolist()


_counters: dict[str, TokenCounter] = {}
_classes: dict[str, bytes] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    if path not in _classes:
        _classes[path] = zlib.compress(class_table(path).tobytes())
    classes = _classes[path]  # a few thousand bytes: the library is asked once, by the driver

    def run(batches):
        if path not in _counters:
            _counters[path] = TokenCounter(path, np.frombuffer(zlib.decompress(classes), np.uint8))
        counter = _counters[path]
        for batch in batches:
            raw = [x or b"" for x in as_bytes(batch.column(1))]
            n = counter.counts([x.decode("utf-8") for x in raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return spread(docs, "cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
