"""When a query finds nothing (or, if so set, little): other surfaces of its words, then spellings near them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import fuzzy as Z
from cairn.functions import text as T
from cairn.operators.index import Index

STRONG = 0.5


def candidates(index: Index, raw: str, term: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """term, surface, df, distance, score: the best corrections of a word among all terms. Lengths, n-grams and first
    letters are tested in the JVM; only what is left meets the exact distance, in Arrow batches."""
    options = index.config.typo
    token = raw if Z.is_correctable(raw) else term
    rows = vocabulary if vocabulary is not None else index.terms
    empty = "term string, surface string, df long, distance int, score double"
    if not Z.is_correctable(token) or not Z.is_correctable(term):
        return index.spark.createDataFrame([], empty)
    most = Z.max_edits_for(token, options.max_edits)
    c = F.col("term")
    shared = F.greatest(Z.overlap(F.lit(token), c), Z.overlap(F.lit(term), c))
    near = Z.correctable(c) & (c != term) & (F.abs(F.length(c) - len(term)) <= most + 4) & ((shared >= (0.2 if len(token) <= 5 else 0.25)) | (F.substring(c, 1, 1) == token[0]))
    found = rows.where(near).select("term", "df", Z.matches_udf(token, term, most)(c, F.col("df")).alias("m")).where("m.distance is not null")
    out = found.select("term", "m.surface", F.col("df").cast("long").alias("df"), "m.distance", "m.score")
    return out.orderBy(F.desc("score"), "distance", F.desc("df"), T.tie_key(c)).limit(options.max_token_candidates)


def near_shards(index: Index, raw: str, term: str, depth: int = 3, lookups: int = 12) -> DataFrame:
    """The part of the vocabulary that a lookup by prefix shards would see: for comparison with engines that probe."""
    from cairn.functions.values import shard_key

    keys = {s[:depth].ljust(depth, "_") for s in Z.probes(raw, term, max(24, 2 * lookups))}
    return index.terms.where(shard_key(F.col("term"), depth).isin(sorted(keys)[:lookups]))


def present(index: Index, words: list[str]) -> dict[str, int]:
    rows = index.terms.where(F.col("term").isin(words)).collect()  # at most the query's words
    return {r["term"]: r["df"] for r in rows}


def surface_terms(index: Index, analyzed: list[tuple[str, str]]) -> list[str] | None:
    """The query with stems replaced by surfaces that are terms themselves; None if there are none."""
    if all(raw == term for raw, term in analyzed):
        return None
    have = present(index, [raw for raw, _ in analyzed])
    out = [raw if raw != term and raw in have else term for raw, term in analyzed]
    return out if out != [t for _, t in analyzed] else None


def plans(index: Index, analyzed: list[tuple[str, str]]) -> list[dict]:
    """Queries with one word corrected, the most promising first: bound on the score, words present, score, query."""
    base = [t for _, t in analyzed]
    if not base or len(base) > 8:
        return []
    options, have = index.config.typo, present(index, base)
    found: dict[str, dict] = {}
    for k, (raw, term) in enumerate(analyzed):
        if term in have and len(have) < len(set(base)):
            continue
        strong = [r.asDict() for r in candidates(index, raw, term).collect() if r["score"] >= STRONG]
        least = max(STRONG, strong[0]["score"] * 0.5) if strong and strong[0]["score"] >= 1 else STRONG
        for c in strong:
            if c["score"] >= least:
                words = [*base[:k], c["term"], *base[k + 1 :]]
                plan = {"q": " ".join(words), "base": words, "score": c["score"], "correction": {"from": raw, "to": c["term"], **{x: c[x] for x in ("surface", "distance", "df")}, "score": round(c["score"], 3)}}
                if plan["q"] not in found or plan["score"] > found[plan["q"]]["score"]:
                    found[plan["q"]] = plan
    chosen = sorted(found.values(), key=lambda p: (-p["score"], p["q"]))[: options.max_query_plans]
    terms = sorted({t for p in chosen for t in T.expand_terms(p["base"])})
    if not terms:
        return []
    bounds = {r["term"]: r["m"] for r in index.postings.where(F.col("term").isin(terms)).groupBy("term").agg(F.max("impact").alias("m")).collect()}
    for p in chosen:
        p["bound"] = sum(bounds.get(t, 0) for t in T.expand_terms(p["base"]))
        p["present"] = sum(t in bounds for t in set(p["base"]))
    return sorted(chosen, key=lambda p: (-p["bound"], -p["present"], -p["score"], p["q"]))


def should_replace(before: int, after: int) -> bool:
    return after > 0 if before <= 0 else after >= max(before + 2, before * 1.5)


def fall_back(index: Index, result, analyzed: list[tuple[str, str]], run):
    """The result, or that of another form of the query."""
    options = index.config.typo
    weak = result.total == 0 or options.trigger == "zero-or-weak" and result.total <= options.weak_result_total
    if options.mode == "off" or not weak:
        return result
    if result.total == 0 and (words := surface_terms(index, analyzed)):
        rows, total = run(words)
        if total > 0:
            result.rows, result.total, result.surface_query = rows, total, " ".join(words)
            return result
    best = None
    for plan in plans(index, analyzed)[: options.max_corrected_searches]:
        rows, total = run(plan["base"])
        value = plan["score"] + min(total, 20) * 0.05
        if total > result.total and (best is None or value > best[0]):
            best = (value, plan, rows, total)
    result.stats["typo_attempted"] = True
    if best is None:
        return result
    _, plan, rows, total = best
    result.corrections = [plan["correction"]]
    if should_replace(result.total, total):
        result.rows, result.total, result.corrected_query = rows, total, plan["q"]
    else:
        result.suggested_query = plan["q"]
    return result


