import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cairn.functions import fuzzy as Z
from cairn.functions import text as T


def test_fold_and_terms():
    assert T.fold_text("École CŒUR Æther") == "ecole coeur aether"
    assert T.tokenize_text("Static indexes are running quickly") == "static index runn quickly".split()
    assert " ".join(T.query_terms("static range search")) == "static range search static_range range_search static_range_search"
    assert T.analyze_query("indexes index") == [("indexes", "index")]
    assert T.surface_stems("running runs") == {"running": "runn", "runs": "runs"}
    assert T.term_counts_text("range ranges range") == {"range": 2, "rang": 1}
    assert T.tokenize_text("") == T.tokenize_text(None) == []


def test_stems():
    assert [T.stem_text(x) for x in ("12345", "abcd", "ement", "chanteuses", "ations", "parties", "played")] == ["12345", "abcd", "", "chant", "", "part", "play"]


def test_keys():
    assert T.bundle_key(["a"]) == "" and T.bundle_key(["a", "b", "a"]) == "exact-expanded-v1|a b"
    assert [k for k, _ in T.bundle_keys(["a", "b", "c"])] == ["exact-expanded-v1|a b c", "exact-expanded-v1|a b", "exact-expanded-v1|b c"]
    assert T.proximity_term_text("b", "a") == "n_a_b" and T.proximity_term_text("a", "a") == ""
    assert T.raw_surface_text(" École—№1 ") == "école no1" and T.folded_surface_text("École!") == "ecole"
    assert T.query_label_keys("the Range range")["tokens"] == ["t|range range", "t|range"]


TEXTS = ["École CŒUR Æther", "Static indexes are running", "ﬁn ² ﬀ ß été", "", "a 1 22 b-c_d", "les jugements issements possibilities Ñandú ŻÓŁW", "İstanbul", "x" * 3000, None]


def test_columns_equal_their_twins(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("t", T.tokens(F.col("t")).alias("a"), T.tokens(F.col("t"), "nfkd").alias("b"), T.expanded(T.tokens(F.col("t"), unique=True)).alias("c"), T.raw_surface(F.col("t"), "nfkd").alias("r"), T.folded_surface(F.col("t")).alias("s")).collect()
    for t, a, b, c, r, s in rows:
        assert b == T.tokenize_text(t, unique=False)
        assert a == b
        assert c == T.query_terms(t)
        assert s == T.folded_surface_text(t) and r == T.raw_surface_text(t)


def test_latin_fold_equals_full_normalisation(spark):
    text = "".join(chr(c) for c in range(0xA1, 0x250) if chr(c) not in "¼½¾ŉĿŀǄǅǆǇǈǉǊǋǌǱǲǳ⅐")
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.fold(F.col("t"))).first()[0]
    keep = lambda s: "".join(c for c in s if c.isascii() and c.isalnum())
    assert keep(got) == keep(T.fold_text(text))


@settings(max_examples=60, deadline=None)
@given(st.text("abcde", max_size=9), st.text("abcde", max_size=9))
def test_osa_against_full_table(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    full = d[len(a), len(b)]
    assert Z.osa(a, b, 2) == (full if full <= 2 else 3)


def test_typo_helpers(spark):
    assert Z.osa("elecrtif", "electrif", 2) == 1
    assert Z.best_surface("climatiqe", "climat", 2) == ("climatique", 1)
    assert (Z.max_edits_for("short", 2), Z.max_edits_for("longtoken", 2)) == (1, 2)
    assert 0 < len(Z.probes("elecrtified", "elecrtifi")) <= 12
    assert Z.lcs("abcde", "ace") == 3
    pairs = [("static", "statik"), ("ab", "abc"), ("a", "b"), ("a", "a"), ("range", "ranges"), ("winding", "windings")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b, x in df.select("a", "b", Z.overlap(F.col("a"), F.col("b")).alias("x")).collect():
        assert x == pytest.approx(Z.overlap_text(a, b))


def test_terms_in_arrow_equal_the_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "été №12 K3 x y MIXED_Case", "a" * 7 + " " * 9])], "i int, t string")
    rows = df.select("t", T.terms(F.col("t")).alias("a"), T.tokens(F.col("t")).alias("b"), T.terms(F.col("t"), "nfkd", unique=True).alias("c"), T.tokens(F.col("t"), "nfkd", unique=True).alias("d")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and [r["c"] for r in rows] == [r["d"] for r in rows]


def test_terms_are_made_once(spark):
    df = spark.createDataFrame([("red widget",)], "t string").select(T.terms(F.col("t")).alias("a")).where(F.size("a") > 0).select(F.array_join("a", " ").alias("s"))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and df.first()[0] == "red widget"


def test_terms_cut_anywhere(monkeypatch):
    import pyarrow as pa

    from cairn.functions import words

    texts = [*TEXTS, *(t[k:] for t in TEXTS if t for k in range(1, min(20, len(t)))), None]
    for size in (4 << 20, 9, 1):
        monkeypatch.setattr(words, "SLICE_BYTES", size)
        assert words.term_arrays(pa.array([None, "zz", *texts]).slice(2), "nfkd").to_pylist() == [T.tokenize_text(t, unique=False) for t in texts]
