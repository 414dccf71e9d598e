"""String distances and the score of a correction: built-in functions where there are any, Arrow UDFs for the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that a stem may have had, the most common first.
ENDINGS = tuple("s e es er eur eurs euse".split() + "ement ements ation ations ique iques ance ances ite ites".split())


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, most + 1 if it is larger than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j], row[-1]) + 1
            best = min(best, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    one = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(one[j - 1] + 1 if x == y else max(one[j], row[-1]))
        one = row
    return one[-1]


def best_surface(token: str, candidate: str, most: int) -> tuple[str, int]:
    """(surface, distance) of the candidate, bare or with an ending, that is nearest to the token."""
    best = (candidate, osa(token, candidate, most))
    for e in ENDINGS:
        if abs(len(candidate) + len(e) - len(token)) <= most:
            d = osa(token, candidate + e, most)
            if d < best[1]:
                best = (candidate + e, d)
    return best


def overlap_text(a: str, b: str) -> float:
    n = 2 if min(len(a), len(b)) <= 5 else 3
    x, y = ({s[i : i + n] for i in range(len(s) - n + 1)} for s in (a, b))
    if not x or not y:
        return 0.25 if a[:1] == b[:1] else 0.0
    return len(x & y) / max(len(x), len(y))


def overlap(a: Column, b: Column) -> Column:
    """Shared 2-grams or, if both are longer than 5, 3-grams, against the larger number of distinct ones."""

    def grams(s: Column, n: int) -> Column:
        return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - F.lit(n - 1)), lambda i: F.substring(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    def of(n: int) -> Column:
        x, y = grams(a, n), grams(b, n)
        share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
        bare = F.when(F.substring(a, 1, 1) == F.substring(b, 1, 1), F.lit(0.25)).otherwise(F.lit(0.0))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), bare).otherwise(share)

    return F.when(F.least(F.length(a), F.length(b)) <= 5, of(2)).otherwise(of(3))


def shortened(s: Column, most: int) -> Column:
    """The string and all that is left of it when up to `most` characters are taken out."""
    less = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))
    out = step = F.array(s)
    for _ in range(most):
        step = F.array_distinct(F.flatten(F.transform(step, less)))
        out = F.array_distinct(F.concat(out, step))
    return out


def osa_udf(most: int):
    @F.pandas_udf("long")
    def run(a, b):
        return a._constructor([osa(x, y, most) for x, y in zip(a, b, strict=True)], dtype="int64")

    return run


def close_pairs(strings, column: str, most: int):
    """a, b, distance of all pairs of distinct strings, a < b, whose optimal string alignment distance is at most `most`. Such
    strings are equal after up to `most` deletions in each, so only those that share a shortened form meet."""
    each = strings.select(F.col(column).alias("s")).where("s is not null").distinct().select("s", F.explode(shortened(F.col("s"), most)).alias("form"))
    met = each.withColumnRenamed("s", "a").join(each.withColumnRenamed("s", "b"), "form").where("a < b").select("a", "b").distinct()
    return met.withColumn("distance", osa_udf(most)("a", "b")).where(F.col("distance") <= most)


def overlapping(queries, strings, column: str):
    """a, b, share of all pairs of a query's string and another with a share above none: they meet by their 2-grams, of which
    pairs that share a 3-gram share two."""
    gram = lambda s: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))))
    held = lambda df, name: df.select(F.col(column).alias(name)).where(F.length(name) > 1).distinct()
    a, b = held(queries, "a"), held(strings, "b")
    met = a.select("a", gram(F.col("a")).alias("g")).join(b.select("b", gram(F.col("b")).alias("g")), "g").where("a <> b").select("a", "b").distinct()
    return met.withColumn("share", overlap(F.col("a"), F.col("b"))).where("share > 0")


def correction_score_text(token: str, surface: str, df: int, distance: int) -> float:
    prefix = next((i for i, (x, y) in enumerate(zip(token, surface, strict=False)) if x != y), min(len(token), len(surface)))
    same_first, same_last = token[:1] == surface[:1] != "", token[-1:] == surface[-1:]
    score = math.log1p(df) * 0.35 + min(prefix, 4) * 0.25 + lcs(token, surface) / max(1, len(token)) * 5.0
    score += (1.2 if same_first else -1.2) + (0.8 if same_last else 0.0)
    return score - distance * 2.6 - abs(len(token) - len(surface)) * 0.35


def max_edits_for(token: str, most: int) -> int:
    return most if len(token) >= 8 else min(1, most)


def correctable(token: Column) -> Column:
    return token.rlike("^[a-z][a-z0-9]{2,31}$")


def is_correctable(token: str) -> bool:
    return 3 <= len(token) <= 32 and token.isascii() and token.isalnum() and token[0].isalpha() and token == token.lower()


def matches_udf(token: str, stemmed: str, most: int):
    """surface, distance, score of a candidate (term, df), or nulls: the exact part, on what the prefilter leaves."""

    @F.pandas_udf("surface string, distance int, score double")
    def run(term, df):
        rows = []
        for t, n in zip(term, df, strict=True):
            surface, d = best_surface(token, t, most)
            if d > most and stemmed != token:
                surface, d = best_surface(stemmed, t, most)
            rows.append((surface, d, correction_score_text(token, surface, int(n), d)) if 0 < d <= most else (None, None, None))
        frame = __import__("pandas").DataFrame(rows, columns=["surface", "distance", "score"])
        frame["distance"] = frame["distance"].astype("Int32")
        return frame

    return run


def probes(raw: str, term: str, most: int = 12) -> list[str]:
    """Spellings near a token whose neighbourhoods a sharded vocabulary would be asked for: losses, swaps, substitutions."""
    seeds = [s for s in (term, raw) if is_correctable(s)]
    target = next((s for s in seeds if len(s) >= 4), seeds[0] if seeds else "")
    if not target:
        return []
    n = len(target)
    near = [i for i in dict.fromkeys((0, 1, 2, 3, n - 1)) if i < n]

    def spellings():
        yield from seeds
        for i in near:
            yield target[:i] + target[i + 1 :]
        for i in near:
            if i < n - 1:
                yield target[:i] + target[i + 1] + target[i] + target[i + 2 :]
        for i in [i for i in dict.fromkeys((1, 0, 2, 3, n - 1)) if i < n]:
            for c in "aeiourstnl" + "cmpdbfgvhqxyzkjw":
                if c != target[i]:
                    yield target[:i] + c + target[i + 1 :]

    out: dict[str, None] = {}
    for s in spellings():
        out[s] = None
        if len(out) >= most:
            break
    return [s for s in out if is_correctable(s)][:most]
