"""Building an index: documents become tables that searches read.

docs(doc, id, url, title, display, facet arrays, numbers, booleans), tokens(doc, f, terms), doc_terms(doc, term, score),
terms(term, df), postings(term, doc, impact), blocks and tiers (bounds on impacts), facets(field, value, label, n, n_docs),
authority(key, doc, score, rnk, total), bundles(key, doc, score, rnk, total, next_score, next_doc), replica_*(rnk, doc, ..).

Shuffles of a build: occurrences by (document, term) and the budget by document, unless one row has all that a document has
(in_one_row), frequencies by term, postings by term.
Texts are tokenised once, into arrays of terms that phrases, pairs and bundles are made from; what is shuffled is counted in
the task first.
"""

from __future__ import annotations

import dataclasses
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import values as V
from cairn.plans.config import IndexConfig
from cairn.sources.readers import spread, unbounded
from cairn.sources.store import Store, checksum, fingerprint, fresh_path, read_json, source_state
from cairn.sources.store import verify as check


#: Stages of a build at a time.
SIDE_BY_SIDE = 4
#: Postings that one task holds against the bundles, about.
SLICE_ROWS = 200_000


@dataclass
class Index:
    spark: SparkSession
    config: IndexConfig
    n: int
    averages: dict[str, float]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    path: str = ""
    reused: list[str] = field(default_factory=list)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def _kinds(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _kind(df: DataFrame, path: str) -> str:
    return df.select(F.col(path)).dtypes[0][1]


def documents(df: DataFrame, cfg: IndexConfig) -> DataFrame:
    """doc, id, url, title, the display columns and the typed columns (`facet_`, `number_`, `boolean_` in front)."""
    cols = _kinds(df)
    out: dict[str, Column] = {"doc": F.col("doc").cast("long")}
    out["id"] = F.col(cfg.id_path).cast("string") if cfg.id_path.split(".")[0] in cols else F.col("doc").cast("string")
    for d in cfg.display:
        c = F.col(d.column)
        if d.max_chars > 0 and _kind(df, d.column) == "string":
            c = F.when(F.length(c) > d.max_chars, F.rtrim(F.substring(c, 1, d.max_chars))).otherwise(c)
        if d.name not in ("doc", "id"):
            out[d.name] = c
    title = out.get("title", F.lit(None))
    out["title"] = F.when(title.cast("string") != "", title.cast("string")).otherwise(out["id"])
    address = F.col(cfg.url_path).cast("string") if cfg.url_path.split(".")[0] in cols else F.lit("")
    out["url"] = F.coalesce(out.get("url", address).cast("string"), address, F.lit(""))
    for f in cfg.facets:
        out[f"facet_{f.name}"] = V.values_of(F.col(f.column), _kind(df, f.column))
        if not _kind(df, f.column).startswith("array"):  # a plain value too, by which scans prune
            out[f"value_{f.name}"] = F.try_element_at(out[f"facet_{f.name}"], F.lit(1))
    for n in cfg.numbers:
        c = F.unix_millis(F.col(n.column).cast("timestamp")) if n.type == "date" and _kind(df, n.column).startswith("timestamp") else V.number(F.col(n.column), n.type)
        out[f"number_{n.name}"] = c
    for b in cfg.booleans:
        out[f"boolean_{b.name}"] = V.boolean(F.col(b.column))
    return df.select(*(c.alias(k) for k, c in out.items()))


def field_texts(df: DataFrame, cfg: IndexConfig) -> DataFrame:
    """doc, f (the field's number), text as it is indexed: cut at the field's cap unless the field is an always-field."""
    parts = []
    for k, f in enumerate(cfg.text):
        text = V.text_of(F.col(f.column), _kind(df, f.column))
        if cap := cfg.cap(f):
            text = F.substring(text, 1, cap)
        parts.append(F.struct(F.lit(k).alias("f"), text.alias("text")))
    return df.select(F.col("doc").cast("long").alias("doc"), F.inline(F.array(*parts)))


def token_arrays(df: DataFrame, cfg: IndexConfig) -> DataFrame:
    """doc, f, terms: the terms of each field in order, as one array; fields without any are left out."""
    return field_texts(df, cfg).select("doc", "f", T.terms(F.col("text"), cfg.fold).alias("terms")).where(F.size("terms") > 0)


def in_one_row(tokens: DataFrame, cfg: IndexConfig) -> bool:
    """Whether a row of tokens is all that its document has: one field without phrases, and no document twice. Counts and the
    budget of terms then need no shuffle."""
    if len(cfg.text) != 1 or cfg.text[0].phrase or cfg.is_always(cfg.text[0]) or cfg.terms_per_doc < 1 or cfg.text[0].weight <= 0:
        return False
    n, docs = tokens.agg(F.count("*"), F.count_distinct("doc")).first()
    return n == docs


def occurrences(tokens: DataFrame, cfg: IndexConfig, one_row: bool = False) -> DataFrame:
    """doc, term, tf0.. and ph0..: how often a term, or a phrase of two or three terms, is in each field. Phrases are put
    together inside a field's array; only counts are shuffled. one_row: as in_one_row() found."""
    if one_row:
        return tokens.select("doc", T.counts(F.col("terms")).alias("c")).select("doc", F.inline("c")).select("doc", "term", F.col("n").cast("long").alias("tf0"), F.lit(0).cast("long").alias("ph0"))
    rows = tokens.select("doc", "f", F.explode("terms").alias("term"), F.lit(False).alias("phrase"))
    phrased = [k for k, f in enumerate(cfg.text) if f.phrase]
    if phrased:
        terms = F.col("terms")
        near = tokens.where(F.col("f").isin(phrased)).select("doc", "f", F.explode(F.concat(T.ngrams(terms, 2), T.ngrams(terms, 3))).alias("term"), F.lit(True).alias("phrase"))
        rows = rows.unionByName(near)
    sums = []
    for k in range(len(cfg.text)):
        here = F.col("f") == k
        sums += [F.count(F.when(here & ~F.col("phrase"), 1)).alias(f"tf{k}"), F.count(F.when(here & F.col("phrase"), 1)).alias(f"ph{k}")]
    return rows.groupBy("doc", "term").agg(*sums)


def averages(counts: DataFrame, cfg: IndexConfig, n: int) -> dict[str, float]:
    """Mean number of tokens of each field, at least 1."""
    row = counts.agg(*(F.sum(f"tf{k}").alias(f"s{k}") for k in range(len(cfg.text)))).first()
    return {f.name: max(1.0, float(row[k] or 0) / max(1, n)) for k, f in enumerate(cfg.text)}


def proximity_rows(tokens: DataFrame, cfg: IndexConfig) -> DataFrame | None:
    """doc, term, s: pairs of terms close to each other in a field, each pair at its first place only, weight by distance.
    A field's option may bound the tokens that make pairs; 0: all do."""
    out = None
    for k, f in enumerate(cfg.text):
        if not f.proximity or cfg.is_always(f):
            continue
        terms = F.slice("terms", 1, f.max_proximity_tokens) if f.max_proximity_tokens > 0 else F.col("terms")
        held = tokens.where(F.col("f") == k).select("doc", terms.alias("terms"), F.size(terms).alias("n"))
        each = held.select("doc", "terms", "n", F.posexplode("terms").alias("i", "a"))
        near = F.slice("terms", F.col("i") + 2, F.lit(f.proximity_window))
        rows = each.where(F.col("i") + 1 < F.col("n")).select("doc", "i", "a", F.posexplode(near).alias("d", "b")).where("a <> b")
        first = rows.groupBy("doc", T.proximity_term(F.col("a"), F.col("b")).alias("term")).agg(F.min(F.struct("i", F.col("d"))).alias("at"))
        one = first.select("doc", "term", (F.lit(float(f.proximity_weight)) / (F.col("at.d") + 1)).alias("s"))
        out = one if out is None else out.unionByName(one)
    return None if out is None else out.groupBy("doc", "term").agg(F.sum("s").alias("s"))


def doc_terms(counts: DataFrame, pairs: DataFrame | None, cfg: IndexConfig, mean: dict[str, float], tokens: DataFrame | None = None) -> DataFrame:
    """doc, term, score (whole): all terms of always-fields, the best `terms_per_doc` of the others, the best pairs. tokens: given
    if in_one_row() holds for them; in one field more frequent terms score higher, so the best are found inside the row."""
    if tokens is not None:
        best = tokens.select("doc", F.size("terms").cast("long").alias("len0"), T.counts(F.col("terms"), cfg.terms_per_doc).alias("c")).select("doc", "len0", F.inline("c"))
        rows = best.select("doc", "term", "len0", F.col("n").cast("long").alias("tf0"))
    else:
        by_doc = Window.partitionBy("doc")
        rows = counts.select("*", *(F.sum(f"tf{k}").over(by_doc).alias(f"len{k}") for k in range(len(cfg.text))))
    sums: dict[bool, Column | None] = {True: None, False: None}
    for k, f in enumerate(cfg.text):
        norm = F.lit(1 - f.b) + F.lit(f.b) * (F.col(f"len{k}") / F.lit(max(1.0, mean[f.name])))
        x = F.lit(float(f.weight)) * F.col(f"tf{k}") / F.greatest(F.lit(0.2), norm)
        if f.phrase:
            x = x + F.lit(float(f.phrase_weight)) * F.col(f"ph{k}")
        group = cfg.is_always(f)
        sums[group] = x if sums[group] is None else sums[group] + x
    score = lambda x: F.lit(0.0) if x is None else F.when(x > 0, V.saturate(x, cfg.k1)).otherwise(F.lit(0.0))
    rows = rows.select("doc", "term", score(sums[True]).alias("always"), score(sums[False]).alias("base"))
    best = Window.partitionBy("doc").orderBy(F.desc("base"), T.tie_key(F.col("term")))
    rows = rows.withColumn("r", F.row_number().over(best) if tokens is None else F.lit(1))
    kept = rows.where((F.col("always") > 0) | (F.col("base") > 0) & (F.col("r") <= cfg.terms_per_doc))
    chosen = kept.select("doc", "term", F.greatest("always", F.when((F.col("base") > 0) & (F.col("r") <= cfg.terms_per_doc), F.col("base")).otherwise(F.lit(0.0))).alias("s"))
    if pairs is not None and cfg.expansion_terms_per_doc > 0:
        w = Window.partitionBy("doc").orderBy(F.desc("s"), T.tie_key(F.col("term")))
        chosen = chosen.unionByName(pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cfg.expansion_terms_per_doc).drop("r"))
        chosen = chosen.groupBy("doc", "term").agg(F.max("s").alias("s"))
    return chosen.select("doc", "term", V.score_int(F.col("s")).alias("score"))


def document_frequencies(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def merge_segments(*segments: DataFrame) -> DataFrame:
    """One table of doc, term, score from several; what is in more than one is added up."""
    out = segments[0]
    for s in segments[1:]:
        out = out.unionByName(s)
    return out.groupBy("doc", "term").agg(F.sum("score").alias("score"))


def postings(terms: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    return terms.join(unbounded(frequencies), "term").select("term", "doc", V.impact(F.col("score"), F.col("df"), n).alias("impact"))


def facets(df: DataFrame, cfg: IndexConfig) -> DataFrame:
    """field, value, label, n (occurrences, repeats in a document too), n_docs."""
    out = None
    for f in cfg.facets:
        values = V.values_of(F.col(f.column), _kind(df, f.column))
        if f.label_path:
            labels = V.values_of(F.col(f.label_path), _kind(df, f.label_path))
            values = F.transform(values, lambda x, i: F.struct(x.alias("value"), F.coalesce(F.try_element_at(labels, i + 1), x).alias("label")))  # noqa: B023
        else:
            values = F.transform(values, lambda x: F.struct(x.alias("value"), x.alias("label")))
        each = df.select("doc", F.explode(values).alias("v")).groupBy("doc", "v.value").agg(F.count("*").alias("c"), F.min("v.label").alias("label"))
        one = each.groupBy("value").agg(F.min_by("label", "doc").alias("label"), F.sum("c").alias("n"), F.count("*").alias("n_docs")).select(F.lit(f.name).alias("field"), "value", "label", "n", "n_docs")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = df.sparkSession.createDataFrame([], "field string, value string, label string, n long, n_docs long")
    return out


def authority_rows(df: DataFrame, cfg: IndexConfig) -> DataFrame:
    """key, doc, score of every label key; of equal keys of a document the first label's score."""
    out = None
    for order, a in enumerate(cfg.authority):
        values = V.values_of(F.col(a.column), _kind(df, a.column))
        each = df.select("doc", F.posexplode(values).alias("at", "value"))
        each = each.withColumn("terms", T.terms(F.col("value"), cfg.fold)) if a.tokens else each.withColumn("terms", F.array().cast("array<string>"))
        keys = [
            (a.surface, "surface", F.concat(F.lit("r|"), T.raw_surface(F.col("value"), cfg.fold))),
            (a.exact, "exact", F.concat(F.lit("x|"), T.folded_surface(F.col("value"), cfg.fold))),
            (a.tokens, "tokens", F.concat(F.lit("t|"), F.array_join("terms", " "))),
        ]
        structs = [F.struct(key.alias("key"), F.lit(a.score(kind)).cast("long").alias("score"), F.lit(k).alias("k")) for k, (wanted, kind, key) in enumerate(keys) if wanted]
        first = F.lit(order << 40) + F.col("at").cast("long") * 4 + F.col("k")  # one number: structs would make the sums a sort
        one = each.select("doc", "at", F.inline(F.array(*structs))).where(F.length("key") > 2).select("key", "doc", "score", first.alias("first"))
        out = one if out is None else out.unionByName(one)
    if len(cfg.authority) == 1 and not _kind(df, cfg.authority[0].column).startswith("array"):  # one label: its keys differ by kind
        return out.select("key", "doc", "score")
    return out.groupBy("key", "doc").agg(F.min_by("score", "first").alias("score"))


def authority(df: DataFrame, cfg: IndexConfig) -> DataFrame:
    """The best rows of each key, with its number of rows. A key's ranks come from two steps, so a key that a third of the
    documents share is cut down bucket by bucket before its rows meet."""
    rows = authority_rows(spread(df), cfg)
    return top_rows(rows, "key", cfg.authority_rows)


def top_rows(rows: DataFrame, key: str, most: int, buckets: int = 64) -> DataFrame:
    """key, doc, score, rnk, total: the `most` best of each key, score first, then the smaller document. The rows are made once:
    the last of each bucket stays too, as its place is the bucket's number of rows."""
    order = [F.desc("score"), F.asc("doc")]
    w, by_key = Window.partitionBy(key, "b").orderBy(*order), Window.partitionBy(key)
    salted = rows.select(key, "doc", "score", F.pmod(F.xxhash64("doc"), F.lit(buckets)).alias("b"))
    first = salted.withColumn("r", F.row_number().over(w)).withColumn("last", F.lead("doc").over(w).isNull())
    kept = first.where((F.col("r") <= most) | F.col("last"))  # at most `most` + 1 a bucket
    best = kept.withColumn("total", F.sum(F.when(F.col("last"), F.col("r").cast("long"))).over(by_key)).withColumn("rnk", F.row_number().over(by_key.orderBy(*order)))
    return best.where(F.col("rnk") <= most).select(key, "doc", "score", "rnk", "total")


def bundle_seeds(tokens: DataFrame, terms: DataFrame, cfg: IndexConfig) -> DataFrame:
    """key, base (array), docs: sequences of two or three terms that at least `bundle_seed_docs` documents select. Sequences are
    held against a document's terms inside its row; what is exploded are the seeds it selects."""
    most = max(2, min(3, cfg.bundle_terms))
    split = F.transform(F.filter("has", lambda t: F.contains(t, F.lit("_")) & ~F.startswith(t, F.lit("n_"))), lambda t: F.split(t, "_"))
    phrase = F.filter(split, lambda b: (F.size(b) >= 2) & (F.size(b) <= most))
    fields = [k for k, f in enumerate(cfg.text) if f.bundles]
    limit = F.lit(0)
    for k in fields:
        cap = cfg.text[k].bundle_tokens if cfg.text[k].bundle_tokens is not None else cfg.bundle_field_tokens
        limit = F.when(F.col("f") == k, F.lit(int(cap))).otherwise(limit)
    kept = tokens.where(F.col("f").isin(fields)).select("doc", F.when(limit > 0, F.slice("terms", F.lit(1), F.greatest(limit, F.lit(1)))).otherwise(F.col("terms")).alias("terms"))
    sequences = T.windows(F.col("terms"), 2) if most == 2 else F.concat(T.windows(F.col("terms"), 2), T.windows(F.col("terms"), 3))
    windows = kept.select("doc", sequences.alias("s")).groupBy("doc").agg(F.flatten(F.collect_list("s")).alias("s"))
    held = terms.groupBy("doc").agg(F.collect_list("term").alias("has")).join(unbounded(windows), "doc", "left")
    both = held.select("has", F.concat(phrase, F.coalesce("s", F.array().cast("array<array<string>>"))).alias("all"))
    # all of the sequence's terms must be selected in the document; terms have no spaces
    whole = F.filter("all", lambda b: (F.size(b) == F.size(F.array_distinct(b))) & F.forall(b, lambda t: F.array_contains("has", t)))
    names = both.select(F.transform(whole, lambda b: F.array_join(b, " ")).alias("names")).select(F.explode(F.array_distinct("names")).alias("name"))
    seeds = names.groupBy("name").agg(F.count("*").alias("docs")).where(F.col("docs") >= cfg.bundle_seed_docs)
    return seeds.select(F.concat(F.lit(T.BUNDLE_PREFIX), F.col("name")).alias("key"), F.split("name", " ").alias("base"), "docs").orderBy(F.desc("docs"), "key").limit(cfg.bundle_keys)


def rarest(each: DataFrame, key: str, frequencies: DataFrame, many: Column) -> DataFrame:
    """key, term: of each row's terms (base) the `many` rarest; terms that nothing holds are the rarest of all."""
    base = each.select(key, many.alias("many"), F.explode("base").alias("term"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "term"))  # a row a term of one query
    return base.join(unbounded(frequencies), "term", "left").withColumn("r", place).where(F.col("r") <= F.col("many")).select(key, "term")


def bundles(seeds: DataFrame, posts: DataFrame, frequencies: DataFrame, cfg: IndexConfig) -> DataFrame:
    """key, doc, score, rnk, total, next_score, next_doc: the best documents of each seed and the bound that follows them. Only
    documents of a seed's rarest term are candidates."""
    slices = max(posts.sparkSession.sparkContext.defaultParallelism, -(-posts.count() // SLICE_ROWS))
    candidates = posts.join(F.broadcast(rarest(seeds, "key", frequencies, F.lit(1))), "term").select("key", "doc")  # at most `bundle_keys` rows
    each = seeds.select("key", "base", T.expanded(F.col("base")).alias("all"))
    found = candidates.repartition(slices, "doc").join(unbounded(posts.repartition(slices, "doc")), "doc").join(F.broadcast(each), "key").where(F.array_contains("all", F.col("term")))  # as many
    hits = found.groupBy("key", "doc").agg(F.sum("impact").alias("score"), F.count(F.when(F.array_contains("base", F.col("term")), 1)).alias("have"), F.first(F.size("base")).alias("need"))
    rows = hits.where("have = need").select("key", "doc", "score")
    after, by_key = F.col("rnk") == cfg.bundle_rows + 1, Window.partitionBy("key")
    best = top_rows(rows, "key", cfg.bundle_rows + 1)
    best = best.withColumn("next_score", F.coalesce(F.max(F.when(after, F.col("score"))).over(by_key), F.lit(0).cast("long"))).withColumn("next_doc", F.max(F.when(after, F.col("doc"))).over(by_key))
    return best.where(F.col("rnk") <= cfg.bundle_rows)


def replica(docs: DataFrame, column: str, order: str) -> DataFrame:
    """rnk from 0, doc, _value (ascending in the replica's order) and the typed columns: documents by a value, then by doc;
    those without a value are left out. No single-partition window."""
    from cairn.sources.readers import with_ordinals

    value = F.col(column).cast("double")
    typed = [c for c in docs.columns if c.startswith(("facet_", "value_", "number_", "boolean_"))]
    rows = docs.where(F.col(column).isNotNull()).select("doc", (value if order == "asc" else -value).alias("_value"), *typed)
    return with_ordinals(rows, "rnk", ["_value", "doc"])


def rank_map(index: Index, name: str) -> DataFrame:
    """replica, doc, rnk of a sort replica."""
    return index.tables[f"replica_{name}"].select(F.lit(name).alias("replica"), "doc", "rnk")


def build(df: DataFrame, cfg: IndexConfig, path: str | None = None, source: str = "", checksums: bool = False) -> Index:
    """Builds or resumes the index of `df` (with a unique `doc`) at `path`. checksums: of every table, for open(verify=True)."""
    spark = df.sparkSession
    cfg.check(df.columns)
    path = path or fresh_path(spark, "index")
    store = Store(spark, path, fingerprint(dataclasses.asdict(cfg), source or path, df.schema.jsonValue(), source_state(df)))
    try:
        return _build(df, cfg, store, checksums)
    except Exception as error:
        store.failed(error)
        raise


def _build(df: DataFrame, cfg: IndexConfig, store: Store, checksums: bool) -> Index:
    """Stages that don't wait for each other run side by side: the scheduler fills the cores that one leaves free."""
    spark, began = df.sparkSession, time.time()
    tables: dict[str, DataFrame] = {}
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:

        def start(name: str, make, **how):
            return pool.submit(inheritable_thread_target(spark)(lambda: store.stage(name, make, **how)))

        later = {"docs": start("docs", lambda: documents(df, cfg), sort=["doc"]), "facets": start("facets", lambda: facets(df, cfg))}
        if cfg.authority:
            later["authority"] = start("authority", lambda: authority(df, cfg), sort=["key"], bloom="key")
        tokens = tables["tokens"] = store.stage("tokens", lambda: token_arrays(spread(df), cfg))
        one_row = in_one_row(tokens, cfg)
        counts = tables["occurrences"] = store.stage("occurrences", lambda: occurrences(tokens, cfg, one_row))
        docs = later["docs"].result()
        n = docs.count()
        for field_name, order in cfg.sort_replicas:
            kind = "number" if any(x.name == field_name for x in cfg.numbers) else "boolean"
            name = f"replica_{field_name}_{order}"
            later[name] = start(name, lambda c=f"{kind}_{field_name}", o=order: replica(docs.withColumn(c, F.col(c).cast("double")), c, o), sort=["rnk"])
        mean = averages(counts, cfg, n)
        pairs = proximity_rows(tokens, cfg) if cfg.expansion_terms_per_doc > 0 else None
        terms = tables["doc_terms"] = store.stage("doc_terms", lambda: doc_terms(counts, pairs, cfg, mean, tokens if one_row else None))
        if cfg.locality:
            from cairn.operators import layout

            later["payload"] = start("payload", lambda: layout.placed(docs, terms), sort=layout.PLACE)
        if cfg.bundles:
            later["seeds"] = start("seeds", lambda: bundle_seeds(tokens, terms, cfg))
        frequencies = tables["terms"] = store.stage("terms", lambda: document_frequencies(terms), sort=["term"])
        posts = tables["postings"] = store.stage("postings", lambda: postings(terms, frequencies, n), sort=["term", "doc"], bloom="term")
        if cfg.bounds:
            from cairn.operators import bounds, layout

            later["blocks"] = start("blocks", lambda: layout.block_bounds(posts, bounds.BLOCK_DOCS), sort=["term", "block"])
            later["tiers"] = start("tiers", lambda: layout.impact_tiers(posts), sort=["term"])
        if cfg.bundles:
            seeds = later["seeds"].result()
            later["bundles"] = start("bundles", lambda: bundles(seeds, posts, frequencies, cfg), sort=["key"])
        tables |= {name: found.result() for name, found in later.items()}
    index = Index(spark, cfg, n, mean, tables, store.path, store.reused)
    publish(index, store, round(time.time() - began, 3), checksums)
    return index


def publish(index: Index, store: Store, seconds: float, checksums: bool) -> None:
    """The manifests, telemetry and report of a finished build; the small manifest, by which an index is opened, comes last."""
    from cairn.operators.report import build_report, optimizer_report

    held = {p["name"]: p for p in store.phases}
    tables = {name: {"bytes": held[name]["bytes"], "files": held[name]["files"]} | ({"checksum": checksum(df)} if checksums else {}) for name, df in index.tables.items()}
    small = {"version": 2, "total": index.n, "averages": index.averages, "config": dataclasses.asdict(index.config), "tables": sorted(tables), "full": "manifest.json", "telemetry": "telemetry.json", "optimizer": "optimizer.json"}
    store.write("telemetry.json", {"seconds": seconds, "phases": store.phases, "report": build_report(store.phases, index.n, seconds)})
    store.write("optimizer.json", optimizer_report(index, tables))
    store.write("manifest.json", small | {"tables": tables, "reused": store.reused, "mark": store.mark})
    store.write("manifest.min.json", small)


def open_index(spark: SparkSession, path: str, verify: bool = False) -> Index:
    """A built index, by its small manifest. verify: every table is compared with the checksum that its build recorded."""
    path = path.rstrip("/")
    small = read_json(spark, f"{path}/manifest.min.json")
    if small is None:
        raise FileNotFoundError(f"no finished index at {path}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in small["tables"]}
    if verify:
        full = read_json(spark, f"{path}/manifest.json")["tables"]
        for name, df in tables.items():
            if "checksum" not in full[name]:
                raise ValueError(f"{name} was built without a checksum")
            check(df, full[name]["checksum"])
    return Index(spark, IndexConfig.from_dict(small["config"]), small["total"], small["averages"], tables, path)
