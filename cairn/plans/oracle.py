"""The scoring rules once more, as DuckDB SQL: common table expressions that the checks of queries are put together from."""

from __future__ import annotations

from cairn.functions.text import STEPS, STOPWORDS
from cairn.plans.config import IndexConfig

STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))


def fold(x: str) -> str:
    return f"replace(replace(strip_accents(lower(coalesce({x}, ''))), 'œ', 'oe'), 'æ', 'ae')"


def stem(x: str) -> str:
    out = x
    for endings, left in STEPS:
        out = f"regexp_replace({out}, '({'|'.join(endings)})$', '{left}')"
    return f"CASE WHEN length({x}) < 5 OR regexp_full_match({x}, '[0-9]+') THEN {x} ELSE {out} END"


def good(x: str) -> str:
    return f"(length({x}) >= 2 OR regexp_full_match({x}, '[0-9]')) AND {x} NOT IN ({STOP})"


def tokens(name: str, source: str) -> str:
    """CTE `name`(doc, f, pos, term) of `source`(doc, f, text)."""
    return f"""
{name}_words AS (SELECT doc, f, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS raw FROM (SELECT doc, f, string_split_regex({fold('text')}, '[^a-z0-9]+') AS a FROM {source})),
{name}_stems AS (SELECT doc, f, pos, {stem('raw')} AS term FROM {name}_words WHERE {good('raw')}),
{name} AS MATERIALIZED (SELECT doc, f, row_number() OVER (PARTITION BY doc, f ORDER BY pos) AS pos, term FROM {name}_stems WHERE {good('term')})"""


def tie(x: str) -> str:
    return f"translate({x}, '_', '!')"


def index(cfg: IndexConfig, docs: str, doc: str, columns: dict[str, str]) -> str:
    """WITH clause: src, tok, occ, mean, doc_terms(doc, term, score), df(term, df), postings(term, doc, impact)."""
    texts = " UNION ALL ".join(
        f"SELECT {doc} AS doc, {k} AS f, " + (f"substr(coalesce({columns[f.name]}, ''), 1, {cap})" if (cap := cfg.cap(f)) else f"coalesce({columns[f.name]}, '')") + f" AS text FROM {docs}" for k, f in enumerate(cfg.text)
    )
    rows = ["SELECT doc, f, term, 0 AS phrase FROM tok"]
    for k, f in enumerate(cfg.text):
        if f.phrase:
            near = f"SELECT doc, term, lead(term, 1) OVER w AS t1, lead(term, 2) OVER w AS t2 FROM tok WHERE f = {k} WINDOW w AS (PARTITION BY doc ORDER BY pos)"
            rows += [f"SELECT doc, {k}, term || '_' || t1, 1 FROM ({near}) WHERE t1 IS NOT NULL", f"SELECT doc, {k}, term || '_' || t1 || '_' || t2, 1 FROM ({near}) WHERE t2 IS NOT NULL"]
    sums = ", ".join(f"count(*) FILTER (f = {k} AND phrase = 0) AS tf{k}, count(*) FILTER (f = {k} AND phrase = 1) AS ph{k}" for k in range(len(cfg.text)))
    means = ", ".join(f"greatest(1e0, sum(tf{k}) / greatest(1, (SELECT count(*) FROM {docs}))::DOUBLE) AS m{k}" for k in range(len(cfg.text)))
    lengths = ", ".join(f"sum(tf{k}) OVER (PARTITION BY doc) AS len{k}" for k in range(len(cfg.text)))
    x = {True: [], False: []}
    for k, f in enumerate(cfg.text):
        one = f"{float(f.weight)!r}e0 * tf{k} / greatest(0.2e0, {1 - f.b!r}e0 + {f.b!r}e0 * (len{k} / greatest(1e0, m{k})))"
        x[cfg.is_always(f)].append(one + (f" + {float(f.phrase_weight)!r}e0 * ph{k}" if f.phrase else ""))
    total = {g: " + ".join(parts) or "0e0" for g, parts in x.items()}
    k1 = f"{cfg.k1!r}e0"
    score = lambda g: f"CASE WHEN {g} > 0 THEN {cfg.k1 + 1!r}e0 * {g} / ({k1} + {g}) ELSE 0e0 END"
    chosen = "SELECT doc, term, greatest(always, CASE WHEN base > 0 AND r <= " + str(cfg.terms_per_doc) + " THEN base ELSE 0e0 END) AS s FROM ranked WHERE always > 0 OR base > 0 AND r <= " + str(cfg.terms_per_doc)
    expansion = ""
    if cfg.expansion_terms_per_doc:
        parts = []
        for k, f in enumerate(cfg.text):
            if f.proximity and not cfg.is_always(f):
                pairs = " UNION ALL ".join(
                    f"SELECT a.doc, a.pos AS i, {d} AS d, 'n_' || least(a.term, b.term) || '_' || greatest(a.term, b.term) AS term FROM tok a JOIN tok b ON a.doc = b.doc AND b.f = {k} AND b.pos = a.pos + {d} WHERE a.f = {k} AND a.term <> b.term" + (f" AND b.pos <= {f.max_proximity_tokens}" if f.max_proximity_tokens > 0 else "")
                    for d in range(1, f.proximity_window + 1)
                )
                parts.append(f"SELECT doc, term, {float(f.proximity_weight)!r}e0 / arg_min(d, i * 100 + d) AS s FROM ({pairs}) GROUP BY doc, term")
        expansion = f",\npairs AS (SELECT doc, term, sum(s) AS s FROM ({' UNION ALL '.join(parts)}) GROUP BY doc, term)"
        best = f"SELECT doc, term, s FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY s DESC, {tie('term')}) AS r FROM pairs) WHERE r <= {cfg.expansion_terms_per_doc}"
        chosen = f"SELECT doc, term, max(s) AS s FROM ({chosen} UNION ALL {best}) GROUP BY doc, term"
    return f"""WITH src AS ({texts}),{tokens('tok', 'src')},
occ AS (SELECT doc, term, {sums} FROM ({' UNION ALL '.join(rows)}) GROUP BY doc, term),
mean AS (SELECT {means} FROM occ),
weighted AS (SELECT doc, term, {total[True]} AS xa, {total[False]} AS xb FROM (SELECT *, {lengths} FROM occ), mean),
sat AS (SELECT doc, term, {score('xa')} AS always, {score('xb')} AS base FROM weighted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY base DESC, {tie('term')}) AS r FROM sat){expansion},
doc_terms AS MATERIALIZED (SELECT doc, term, CAST(greatest(1, floor(s * 1000e0 + 0.5e0)) AS BIGINT) AS score FROM ({chosen})),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM doc_terms GROUP BY term),
total AS (SELECT count(*)::DOUBLE AS n FROM {docs}),
postings AS MATERIALIZED (SELECT t.term, t.doc, CAST(greatest(1, floor(t.score * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) / 10e0 + 0.5e0)) AS BIGINT) AS impact FROM doc_terms t JOIN df USING (term), total)"""


def quoted(items: list[str]) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def hits(base: list[str], expanded: list[str], need: int, postings: str = "postings") -> str:
    """CTE hits(doc, score)."""
    return f"hits AS (SELECT doc, CAST(sum(impact) AS BIGINT) AS score FROM {postings} WHERE term IN ({quoted(expanded)}) GROUP BY doc HAVING count(*) FILTER (term IN ({quoted(base)})) >= {need}"


def page(order: str, size: int, offset: int = 0, source: str = "hits", columns: str = "doc, score") -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM {source}) WHERE rank > {offset} AND rank <= {offset + size}"


def distances(pairs: str, name: str = "dist") -> str:
    """CTE `name`(a, b, d, lcs) of the table `pairs`(a, b): optimal string alignment distance and longest common subsequence, a row of
    the usual table at a time. WITH RECURSIVE must come first."""
    change = "one[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END"
    swap = "CASE WHEN i > 0 AND j > 1 AND a[i + 1] = b[j - 1] AND a[i] = b[j] THEN two[j - 1] + 1 ELSE 1000000 END"
    ends = "FOR j IN range(0, length(b) + 1)"
    return f"""
{name}_rows AS (SELECT DISTINCT a, b, 0::BIGINT AS i, range(0, length(b) + 1) AS one, NULL::BIGINT[] AS two, [0::BIGINT FOR k IN range(0, length(b) + 1)] AS l FROM {pairs}
 UNION ALL SELECT a, b, i + 1, [list_min([c[k + 1] - k FOR k IN range(0, j + 1)]) + j {ends}], one, [list_max(m[1:j + 1]) {ends}] FROM (
  SELECT *, list_concat([i + 1], [least(one[j + 1] + 1, {change}, {swap}) FOR j IN range(1, length(b) + 1)]) AS c,
   list_concat([0::BIGINT], [CASE WHEN a[i + 1] = b[j] THEN l[j] + 1 ELSE l[j + 1] END FOR j IN range(1, length(b) + 1)]) AS m FROM {name}_rows WHERE i < length(a))),
{name} AS (SELECT a, b, one[-1] AS d, l[-1] AS lcs FROM {name}_rows WHERE i = length(a))"""


def overlap(a: str, b: str) -> str:
    """Shared n-grams of two strings against the larger number of distinct ones."""
    n = f"(CASE WHEN least(length({a}), length({b})) <= 5 THEN 2 ELSE 3 END)"
    grams = lambda x: f"list_distinct([substr({x}, i, {n}) FOR i IN range(1, length({x}) - {n} + 2)])"
    return f"(len(list_intersect({grams(a)}, {grams(b)})) / greatest(len({grams(a)}), len({grams(b)}))::DOUBLE)"


def typo(token: str, most: int, vocabulary: str = "df") -> str:
    """CTE candidates(term, surface, df, distance, score) for a token that is its own stem. WITH RECURSIVE must come first."""
    from cairn.functions.fuzzy import ENDINGS

    endings = " UNION ALL ".join([f"SELECT term, df, term AS b, 0 AS k, '{token}' AS a FROM near", *(f"SELECT term, df, term || '{e}', {k + 1}, '{token}' FROM near WHERE abs(length(term) + {len(e)} - {len(token)}) <= {most}" for k, e in enumerate(ENDINGS))])
    share = 0.2 if len(token) <= 5 else 0.25
    near = f"regexp_full_match(term, '[a-z][a-z0-9]{{2,31}}') AND term <> '{token}' AND abs(length(term) - {len(token)}) <= {most + 4}"
    prefix = f"len(list_filter(range(1, 5), lambda i: substr(surface, 1, i) = substr('{token}', 1, i) AND length(surface) >= i))"
    score = f"ln(1 + df) * 0.35e0 + {prefix} * 0.25e0 + lcs / {len(token)}e0 * 5 + CASE WHEN surface[1] = '{token[0]}' THEN 1.2e0 ELSE -1.2e0 END + CASE WHEN surface[-1] = '{token[-1]}' THEN 0.8e0 ELSE 0e0 END - d * 2.6e0 - abs(length(surface) - {len(token)}) * 0.35e0"
    return f"""
near AS (SELECT term, df FROM {vocabulary} WHERE {near} AND (term[1] = '{token[0]}' OR {overlap(f"'{token}'", 'term')} >= {share})),
surfaces AS ({endings}),{distances('surfaces')},
nearest AS (SELECT term, df, arg_min(s.b, d * 1000 + k) AS surface, min(d) AS d, arg_min(lcs, d * 1000 + k) AS lcs FROM surfaces s JOIN dist USING (a, b) GROUP BY term, df),
candidates AS (SELECT term, surface, df, d::INTEGER AS distance, {score} AS score FROM nearest WHERE d BETWEEN 1 AND {most})"""
