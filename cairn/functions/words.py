"""The analyzer over Arrow arrays. Texts are cut at separators by whole arrays of bytes; each distinct word is folded and
stemmed once, by the twins on strings."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cairn.functions import text as T

#: Bytes of text that are cut at a time.
SLICE_BYTES = 4 << 20
#: Terms that are counted at a time.
SLICE_TERMS = 500_000
#: Words whose terms a worker remembers.
KNOWN_WORDS = 300_000
#: Bytes inside words: ASCII letters and digits, and all of other characters, about which folding decides.
_INSIDE = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_SMALL = np.array([ord(chr(c).lower()) if c < 0x80 else c for c in range(256)], np.uint8)

_known: dict[tuple, dict[str, tuple[str, ...]]] = {}


@cache
def _latin_table() -> dict[int, str | None]:
    return {ord(c): T._TO[k] if k < len(T._TO) else None for k, c in enumerate(T._FROM)} | {ord(a): b for a, b in T._LIGATURES}


def fold_latin_text(text: str | None) -> str:
    """The twin of fold(mode="latin")."""
    text = text or ""
    return (text if text.isascii() else text.translate(_latin_table())).lower()


def _terms(words: list[str], mode: str, least: int) -> list[tuple[str, ...]]:
    """The terms of each word, as a rule one or none; more where a character folds to a separator."""
    known = _known.setdefault((mode, least), {})
    if len(known) > KNOWN_WORDS:
        known.clear()
    fold = T.fold_text if mode == "nfkd" else fold_latin_text
    out = []
    for w in words:
        if (found := known.get(w)) is None:
            found = known[w] = _ascii_term(w, least) if w.isascii() else tuple(t for _, t in T.raws_of_folded(fold(w), least, T.STOPWORDS))
        out.append(found)
    return out


def _ascii_term(word: str, least: int) -> tuple[str, ...]:
    """The term of a word of small letters and digits."""
    if word in T.STOPWORDS or len(word) < least and not (len(word) == 1 and word.isdigit()):
        return ()
    term = T.stem_text(word)
    if term is not word and (term in T.STOPWORDS or len(term) < least and not (len(term) == 1 and term.isdigit())):
        return ()
    return (term,)


def _cut(offsets: np.ndarray, data: np.ndarray, mode: str, least: int) -> pa.ListArray:
    """The terms of neighbouring texts: data, and where each begins and the last ends."""
    inside = _INSIDE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(data)]
    starts[edges] = inside[edges]
    kept, places = _SMALL[data[inside]], np.flatnonzero(starts[inside]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(places), pa.py_buffer(np.append(places, np.int32(len(kept)))), pa.py_buffer(kept))
    first_word = np.searchsorted(np.flatnonzero(starts), offsets)
    coded = words.dictionary_encode()
    terms = _terms(coded.dictionary.to_pylist(), mode, least)
    flat = pa.array([t for x in terms for t in x], pa.string())
    sizes = np.fromiter((len(x) for x in terms), np.int64, len(terms))
    codes = coded.indices.to_numpy()
    many = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(many)))
    begin = (np.cumsum(sizes) - sizes)[codes]
    at = np.repeat(begin - ends[:-1], many) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends[first_word].astype(np.int32)), flat.take(pa.array(at)))


def term_arrays(texts: pa.Array, mode: str = "latin", least: int = 2) -> pa.Array:
    """The terms of each text, in order; none for null."""
    if not len(texts):
        return pa.array([], pa.list_(pa.string()))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    out, at = [], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        low, high = offsets[at], offsets[end]
        out.append(_cut(offsets[at : end + 1] - low, data[low:high], mode, least))
        at = end
    return pa.concat_arrays(out)


def _counted(lists: pa.Array, sizes: np.ndarray, most: int) -> pa.ListArray:
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary
    order = pc.array_sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys = np.repeat(np.arange(len(lists)), sizes) * max(1, len(names)) + rank[coded.indices.to_numpy()]
    keys, n = np.unique(keys, return_counts=True)
    row, r = np.divmod(keys, max(1, len(names)))
    top = int(n.max(initial=0))
    by = np.argsort(row * (top + 1) + (top - n), kind="stable")  # equal counts stay in order of terms
    row, r, n = row[by], r[by], n[by]
    held = np.bincount(row, minlength=len(lists))
    if most:
        kept = np.arange(len(row)) - (np.cumsum(held) - held)[row] < most
        r, n, held = r[kept], n[kept], np.minimum(held, most)
    pairs = pa.StructArray.from_arrays([names.take(pa.array(order[r])), pa.array(n.astype(np.int32))], ["term", "n"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32)), pairs)


def count_arrays(lists: pa.Array, most: int = 0) -> pa.Array:
    """term, n of each list of terms, the most frequent first, then in order of terms; only the first `most` unless that is 0."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    out, at = [_counted(lists.slice(0, 0), sizes[:0], most)], 0
    while at < len(lists):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_TERMS, "right")))
        out.append(_counted(lists.slice(at, end - at), sizes[at:end], most))
        at = end
    return pa.concat_arrays(out)
