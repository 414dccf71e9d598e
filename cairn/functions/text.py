"""The analyzer: Column functions for tables, and twins on plain strings for queries."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English and French function words, by first letter.
STOPWORDS = frozenset(
    ("a an and are as at au aux avec be been being but by can ce ces could dans de des did do does du elle en et eux "
     "for from had has have if il ils in into is it its je la le les leur leurs lui ma mais me mes moi mon ne nos not "
     "notre nous of on or ou over par pas pour qu que qui sa se ses son sur ta te tes than that the their then there "
     "these this those to toi ton tu un under une vos votre vous was were with within would").split()
)
#: Endings taken off one after the other, the longest of a step that fits; and what takes their place.
_STEPS = (
    ("ations ements ances ation ement iques ities ments ance ique ment ity", ""),
    ("issements issement", "iss"),
    ("euses euse eurs ives eur ifs ive if", ""),
    ("ied ies ing ers ed er es s", ""),
)
STEPS = tuple((tuple(sorted(endings.split(), key=len, reverse=True)), left) for endings, left in _STEPS)
BUNDLE_PREFIX = "exact-expanded-v1|"


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters of the basic plane that fold to one ASCII letter or digit; those that vanish; those that become several."""
    one, gone, many = {}, [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if unicodedata.category(c) == "Cs":
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not 0x300 <= ord(x) <= 0x36F)
        if not folded:
            gone.append(c)
        elif folded.isascii() and folded.isalnum():
            if len(folded) == 1:
                one[c] = folded
            elif len(folded) <= 3 and code < 0x3400:
                many.append((c, folded))
    return "".join(one) + "".join(gone), "".join(one.values()), many


_FROM, _TO, _MANY = _fold_tables()
_LIGATURES = [("œ", "oe"), ("Œ", "oe"), ("æ", "ae"), ("Æ", "ae"), ("ǣ", "ae"), ("Ǣ", "ae"), ("ǽ", "ae"), ("Ǽ", "ae"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("™", "tm"), ("№", "no"), ("ĳ", "ij"), ("Ĳ", "ij")]


def fold_text(text: str | None) -> str:
    folded = unicodedata.normalize("NFKD", text or "").lower()
    return "".join(c for c in folded if not 0x300 <= ord(c) <= 0x36F).replace("œ", "oe").replace("æ", "ae")


def fold(text: Column, mode: str = "latin") -> Column:
    """Lower case without accents. `latin`: in the JVM, equal to full normalisation for all characters of the basic plane that
    fold to one letter or digit and for the usual ligatures; `nfkd`: full normalisation, in Arrow batches."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if mode == "nfkd":
        return nfkd_fold()(text)
    for a, b in _LIGATURES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.lower(F.translate(text, _FROM, _TO))


def nfkd_fold():
    @F.pandas_udf("string")
    def run(s):
        return s.map(fold_text)

    return run


def nfkc_lower():
    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: unicodedata.normalize("NFKC", x or "").lower())

    return run


def stem_text(token: str) -> str:
    if len(token) < 5 or token.isdigit():
        return token
    for endings, left in STEPS:
        if token.endswith(endings):
            for e in endings:
                if token.endswith(e):
                    token = token[: -len(e)] + left
                    break
    return token


_WHOLE = "!"  # before a token that is too short to be stemmed


def _step(endings: tuple[str, ...], left: str):
    def run(x: Column) -> Column:
        out = x
        for n in sorted({len(e) for e in endings}):  # the longest is asked first
            found = F.substring(x, -n, n).isin(*(e for e in endings if len(e) == n))
            out = F.when(found, F.concat(F.substring(x, F.lit(1), F.length(x) - F.lit(n)), F.lit(left))).otherwise(out)
        return F.when(F.startswith(x, F.lit(_WHOLE)), x).otherwise(out)

    return run


def stems(tokens: Column) -> Column:
    """The stems of an array of tokens; a step a pass, so that no expression is written twice."""
    out = F.transform(tokens, lambda x: F.when(F.length(x) < 5, F.concat(F.lit(_WHOLE), x)).otherwise(x))
    for endings, left in STEPS:
        out = F.transform(out, _step(endings, left))
    return F.transform(out, lambda x: F.when(F.startswith(x, F.lit(_WHOLE)), F.substring(x, 2, 1 << 30)).otherwise(x))


def _long_enough(token: Column, least: int) -> Column:
    return (F.length(token) >= least) | token.rlike("^[0-9]$")


def _raws(text: str | None, least: int, stopwords):
    return raws_of_folded(fold_text(text), least, stopwords)


def raws_of_folded(folded: str, least: int, stopwords):
    """(raw, stem) of the tokens of a folded text."""
    for raw in re.split("[^a-z0-9]+", folded):
        if (len(raw) >= least or re.fullmatch("[0-9]", raw)) and raw not in stopwords:
            term = stem_text(raw)
            if (len(term) >= least or re.fullmatch("[0-9]", term)) and term not in stopwords:
                yield raw, term


def tokenize_text(text: str | None, least: int = 2, stopwords=STOPWORDS, unique: bool = True) -> list[str]:
    terms = [t for _, t in _raws(text, least, stopwords)]
    return list(dict.fromkeys(terms)) if unique else terms


def analyze_query(text: str | None) -> list[tuple[str, str]]:
    """(surface, stem) of a query, the first surface of each stem."""
    seen: dict[str, str] = {}
    for raw, term in _raws(text, 2, STOPWORDS):
        seen.setdefault(term, raw)
    return [(raw, term) for term, raw in seen.items()]


def surface_stems(text: str | None) -> dict[str, str]:
    """Surface to stem."""
    return dict(_raws(text, 2, STOPWORDS))


def term_counts_text(text: str | None) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in tokenize_text(text, unique=False):
        out[t] = out.get(t, 0) + 1
    return out


def expand_terms(base: list[str]) -> list[str]:
    """The terms, their neighbours in twos, then in threes."""
    grams = ["_".join(base[i : i + n]) for n in (2, 3) for i in range(len(base) - n + 1)]
    return list(dict.fromkeys([*base, *grams]))


def query_terms(text: str | None) -> list[str]:
    return expand_terms(tokenize_text(text))


def bundle_key(base: list[str]) -> str:
    terms = [t for t in dict.fromkeys(base) if t]
    return BUNDLE_PREFIX + " ".join(terms) if 2 <= len(terms) <= 3 else ""


def bundle_keys(base: list[str]) -> list[tuple[str, list[str]]]:
    """(key, terms) of all windows of three terms, then of two."""
    terms = [t for t in dict.fromkeys(base) if t]
    return [(bundle_key(terms[i : i + n]), terms[i : i + n]) for n in (3, 2) if n <= len(terms) for i in range(len(terms) - n + 1)]


def proximity_term_text(a: str, b: str) -> str:
    return "" if not a or not b or a == b else "n_" + "_".join(sorted((a, b)))


def proximity_term(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == "") | (a == b), F.lit("")).otherwise(F.concat(F.lit("n_"), F.least(a, b), F.lit("_"), F.greatest(a, b)))


def tokens(text: Column, mode: str = "latin", least: int = 2, unique: bool = False) -> Column:
    """The terms of a text as an array, in order."""
    keep = lambda x: _long_enough(x, least) & ~x.isin(*STOPWORDS)
    out = F.filter(stems(F.filter(F.split(fold(text, mode), "[^a-z0-9]+"), keep)), keep)
    return F.array_distinct(out) if unique else out


def terms(text: Column, mode: str = "latin", least: int = 2, unique: bool = False) -> Column:
    """The same for the rows of a table, in Arrow batches, where each distinct word is folded and stemmed once. It counts as
    non-deterministic: otherwise a filter on the array would make it a second time."""

    def run(texts: pa.Array) -> pa.Array:
        from cairn.functions.words import term_arrays

        return term_arrays(texts, mode, least)

    out = F.arrow_udf(run, "array<string>").asNondeterministic()(text.cast("string"))
    return F.array_distinct(out) if unique else out


def counts(terms: Column, most: int = 0) -> Column:
    """term, n of an array of terms as an array, in Arrow batches: the most frequent first, then in order of terms; only the
    first `most` unless that is 0."""

    def run(lists: pa.Array) -> pa.Array:
        from cairn.functions.words import count_arrays

        return count_arrays(lists, most)

    return F.arrow_udf(run, "array<struct<term:string,n:int>>").asNondeterministic()(terms)


def windows(terms: Column, n: int) -> Column:
    """All sequences of n neighbours."""
    return F.when(F.size(terms) >= n, F.transform(F.sequence(F.lit(1), F.size(terms) - F.lit(n - 1)), lambda i: F.slice(terms, i, n))).otherwise(F.array().cast("array<array<string>>"))


def ngrams(terms: Column, n: int) -> Column:
    return F.transform(windows(terms, n), lambda w: F.array_join(w, "_"))


def expanded(terms: Column) -> Column:
    """Distinct terms with their neighbours in twos and threes."""
    return F.array_distinct(F.concat(terms, ngrams(terms, 2), ngrams(terms, 3)))


def tie_key(term: Column) -> Column:
    """Sorts terms as a root-locale collation does: the underscore before digits before letters."""
    return F.translate(term, "_", "!")


# -- keys of labels ---------------------------------------------------------


def raw_surface_text(value: str | None) -> str:
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in unicodedata.normalize("NFKC", value or "").lower())
    return " ".join(kept.split())


def folded_surface_text(value: str | None) -> str:
    return " ".join(re.sub("[^a-z0-9]+", " ", fold_text(value)).split())


def raw_surface(value: Column, mode: str = "latin") -> Column:
    value = F.coalesce(value.cast("string"), F.lit(""))
    value = nfkc_lower()(value) if mode == "nfkd" else F.lower(value)
    return F.trim(F.regexp_replace(value, r"[^\p{L}\p{N}]+", " "))


def folded_surface(value: Column, mode: str = "latin") -> Column:
    return F.trim(F.regexp_replace(fold(value, mode), "[^a-z0-9]+", " "))


def label_keys_text(value: str) -> list[tuple[str, str]]:
    """(kind, key) of a label."""
    out = [("surface", "r|" + raw_surface_text(value)), ("exact", "x|" + folded_surface_text(value)), ("tokens", "t|" + " ".join(tokenize_text(value, unique=False)))]
    return [(kind, key) for kind, key in out if len(key) > 2]


def query_label_keys(query: str) -> dict[str, list[str]]:
    """Keys by kind that a query asks for; its distinct terms count as a token key too."""
    out: dict[str, list[str]] = {"surface": [], "exact": [], "tokens": []}
    for kind, key in [*label_keys_text(query), ("tokens", "t|" + " ".join(t for _, t in analyze_query(query)))]:
        if len(key) > 2 and key not in out[kind]:
            out[kind].append(key)
    return out
