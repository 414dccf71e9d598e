"""Each operator against brute force, the library it must equal, or an exact round trip, on small tables with hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from cairn.llm import ann, chunks, lm_score, media, ngram_join, packing, quality, sharding, sp_codec, substring_dedup, token_counts  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, file string, chunk long, slice int"
RNG = random.Random(5)
WORDS = ["the", "of", "Déjà", "ing", "tion", "über", "naïve", "x1", "don't", "日本", "😀", "a.b,c", "<|endoftext|>", "zz top", "Q Q", "42", "!!"]


def some_text(n: int) -> str:
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", "s", "er", "."]) for _ in range(n))


def make_rows() -> list[tuple]:
    passage = some_text(40)
    texts = [None, "", " ", "one", "Two words", "a  b \n\n c\t", "x" * 5000, some_text(3000), some_text(19), some_text(20), passage]
    texts += [some_text(30) + " " + passage + " " + some_text(10) for _ in range(6)]
    base = some_text(120).split()
    for k in range(8):  # near copies
        w = list(base)
        for _ in range(3 * k):
            w[RNG.randrange(len(w))] = f"new{RNG.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [passage] * 5 + [" ".join(["rep"] * 90), "▁ ▁▁ mark", "tail ", "  lead", "LONE", "lone"]
    rows = [(i * 3 % 101, t, "en" if i % 2 else None, f"src{i % 3}", len(t) if t else None, "f", i, 0) for i, t in enumerate(texts)]
    RNG.shuffle(rows)
    return rows


ROWS = make_rows()
BY_ID = {r[0]: r[1] for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def words(t) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- 9, 8, 10: tokenizers -------------------------------------------------------


def test_token_counts(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, path, 512).collect()}
    assert len(got) == len(ROWS)
    for i, t in BY_ID.items():
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert token_counts.count_tokens(empty, path).count() == 0
    with_null = spark.createDataFrame([(None, "a b")] * 2, "doc_id long, text string")
    assert [tuple(r) for r in token_counts.count_tokens(with_null, path).collect()] == [(None, 3, 2, False)] * 2


def test_pretoken_scan_is_the_pattern():
    import regex

    go, out = token_counts.pretoken_transducer()
    table = token_counts.class_table()
    for n in range(300):
        text = "".join(random.Random(n).choice(["'", "s", "r", "e", "l", "v", "t", " ", "  ", "\n", "1", "é", "!", "X", "_"]) for _ in range(n))
        classes = np.append(table[np.frombuffer(text.encode("utf-32-le"), np.uint32)], token_counts.END).astype(np.uint8)
        starts = np.flatnonzero(token_counts.scan_starts(classes, go, out, chunk=32))
        assert [s for s in starts.tolist() if s < len(text)] == [m.start() for m in regex.finditer(P.PATTERN, text)]


def test_token_counts_of_every_code_point():
    """Before a contraction, every code point is split as the library splits it."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, counter = Tokenizer.from_file(path), token_counts.TokenCounter(path)
    texts = [chr(c) + "'s" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        assert counter.counts(part) == [len(e.ids) for e in lib.encode_batch_fast(part, add_special_tokens=False)]


def test_sentencepiece(spark, docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in sp_codec.digests(docs, path).collect()}
    for i, t in BY_ID.items():
        ids = lib.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert sp_codec.digests(empty, path).count() == 0
    back = {r["doc_id"]: r["text"] for r in sp_codec.decode(sp_codec.encode(docs, path), path).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in BY_ID.items())
    codec = sp_codec.codec(path)
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice(["a", "th", "e", " ", "   ", "ing", "é", "\n", "1", "日", "▁", "'s", "\0"]) for _ in range(r.randrange(25)))
        assert codec.encode(t) == lib.encode(t) and codec.decode(codec.encode(t)) == lib.decode(lib.encode(t))


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, 64, buckets=4).collect()
    pieces, where = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        where[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in BY_ID.items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == [(k, min(64, len(ids) - k)) for k in range(0, len(ids), 64)]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(where) <= -(-total // 64) + 2
    assert packing.pack(empty, path).count() == 0


def test_packing_of_repeats_and_missing_ids(spark, monkeypatch):
    """Equal rows and rows without id are packed each, whatever buckets their length has; at full capacity."""
    monkeypatch.setattr(packing, "BUCKET", 7)
    texts = ["one two three"] * 60 + [None, ""] * 5 + [" ".join(["word"] * 5000)] * 3
    df = spark.createDataFrame([(None if i % 2 else 5, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = packing.pack(df, P.path("word_bpe_49k.json"), 2048).collect()
    assert Counter(r["length"] for r in rows) == {4: 60, 1: 10, 2048: 6, 5001 - 4096: 3}
    taken = Counter()
    for r in rows:
        taken.update((r["sequence_id"], r["offset"] + k) for k in range(r["length"]))
    assert max(taken.values()) == 1 and len({s for s, _ in taken}) == 8  # 6 full ones, and 2965 tokens in two
    full = Counter(s for s, _ in taken)
    assert all(sorted(o for s2, o in taken if s2 == s) == list(range(n)) for s, n in full.items())


def test_word_ids_are_the_librarys():
    """Pieces that are cut out of a text and looked up: composition, capitals, contractions and special strings across cuts."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, words, r = Tokenizer.from_file(path), packing.WordIds(path, most=500), random.Random(3)
    assert words.fine and words.lower and words.quick
    parts = ["a", "B", "H", "e", "'", "s", "'s", "'re", "'VE", "1", "23", ".", ",", "&&", "é", "É", "ß", "ÿ", "÷", "\u0301", "\u0331", "\u0308", "日", "😀", " ", "  ", "\n", "\t", "\x1c", "\0", "\x7f", "\xa0", "\u2003", "<|endoftext|>", "<|", "|>", "ſ", "K", "İ", "Σ", "ﬁ", "𝐀", "²", "Ⅷ", "_", "’", "the", "Ing"]
    for _ in range(40):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(200)]
        assert words.ids([t.encode() for t in texts]) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_bin_completion_plans():
    r = random.Random(1)
    for _ in range(20):
        h = Counter(min(100, int(r.lognormvariate(3, 1)) + 1) for _ in range(400))
        best = packing.plan(h, 100)
        for patterns in (best, packing.complete(h, 100), packing.best_fit(h, 100)):
            used = Counter()
            for pattern, many in patterns:
                assert sum(n * k for n, k in pattern) <= 100
                for n, k in pattern:
                    used[n] += k * many
            assert used == h
        assert sum(m for _, m in best) <= sum(m for _, m in packing.best_fit(h, 100))
    assert sum(m for _, m in packing.plan({60: 2, 40: 2, 50: 2}, 100)) == 3


# -- 3, 6 -------------------------------------------------------------------------


def test_bin_completion_is_exact():
    # greedy completion and best fit need one more
    for h, most in (({18: 1, 26: 1, 42: 1, 55: 2, 39: 1, 30: 1, 35: 1, 50: 1, 38: 1}, 4), ({50: 2, 36: 2, 49: 1, 22: 1, 24: 1, 11: 1, 16: 1, 38: 1, 57: 1, 29: 1, 52: 1, 23: 1}, 5)):
        assert sum(m for _, m in packing.plan(h, 100)) == most < sum(m for _, m in packing.complete(h, 100))

    def fewest(pieces: list[int], rooms: tuple, most: int) -> int:
        if len(rooms) >= most:
            return most
        if not pieces:
            return len(rooms)
        n, *rest = pieces
        for room in sorted({r for r in rooms if r >= n}):
            k = rooms.index(room)
            most = fewest(rest, (*rooms[:k], room - n, *rooms[k + 1 :]), most)
        return fewest(rest, (*rooms, 30 - n), most)

    r = random.Random(10)
    for _ in range(150):
        pieces = sorted((r.randint(2, 20) for _ in range(r.randint(1, 11))), reverse=True)
        best, bound = packing.plan_and_bound(Counter(pieces), 30)
        used = Counter()
        for pattern, many in best:
            assert sum(n * k for n, k in pattern) <= 30
            for n, k in pattern:
                used[n] += k * many
        assert used == Counter(pieces)
        assert bound <= sum(m for _, m in best) == fewest(pieces, (), len(pieces) + 1)


def test_sharding(spark, docs, empty, tmp_path):
    rows = sharding.assign(docs, 5, 64, f"file://{tmp_path}/map").collect()
    assert len(rows) == len(ROWS)
    shards = defaultdict(list)
    for r in rows:
        t = BY_ID[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None)
        shards[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())
    load = np.random.default_rng(0).integers(1, 1000, 4096)
    m = sharding.SlotMap.balanced(load, 24)
    assert np.ptp(m.totals(load)) <= 2
    more = m.rebalanced(load, 25)
    t = more.totals(load)
    assert t.max() / t.mean() < 1.01 and more.version == 2
    assert load[np.array(m.shard) != np.array(more.shard)].sum() < load.sum() * 0.05  # only what must move moves
    fewer = m.rebalanced(load, 23)
    assert max(fewer.shard) == 22 and fewer.totals(load).max() / fewer.totals(load).mean() < 1.01
    m.save(str(tmp_path))
    assert sharding.SlotMap.load(str(tmp_path), 1) == m
    assert sharding.assign(empty).count() == 0


def test_media(spark, docs, empty, tmp_path):
    got = {r["doc_id"]: r for r in media.store_and_describe(docs).collect()}
    for i, t in BY_ID.items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        png = media.to_png(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), sha(png)) and media.from_png(png).tobytes() == payload
        assert r["feature"].startswith(f"576x{len(payload) // 576};sum={sum(payload)};")
    assert media.store_and_describe(empty).count() == 0
    folder = f"file://{tmp_path}/media"
    media.write_archives(docs, folder)
    parts = media.read_archives(spark, folder, rangeBytes="700", batchBytes="500")
    assert sorted(r["doc_id"] for r in parts.select("doc_id").collect()) == sorted(BY_ID)
    # a damaged member fails by itself, after its tries, with its offset
    file = next(p for p in (tmp_path / "media").iterdir() if p.suffix == ".cmem")
    data = bytearray(file.read_bytes())
    data[media.HEAD.size + 20] ^= 1
    file.write_bytes(data)
    fs, _ = media.filesystem(folder)
    with pytest.raises(ValueError, match="damaged"):
        media.read_member(fs, str(file), 0, tries=2, pause=0)
    offset = media.HEAD.size + media.HEAD.unpack(bytes(data[: media.HEAD.size]))[4]
    assert media.read_member(fs, str(file), offset)[0] in BY_ID


def test_sharding_media_and_codecs_of_repeats_and_missing_ids(spark, tmp_path):
    """Equal rows, rows without id and very long texts each give a row; shards of skewed documents come out near equal."""
    r = random.Random(6)
    texts = ["same text"] * 40 + [None, "", "tie"] * 4 + ["long " * 30_000] + [" ".join(["w"] * r.randrange(1, 200)) for _ in range(400)]
    rows = [(None if i % 3 == 0 else i // 2, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string, size int").repartition(3)
    want = Counter((i, len((t or "").encode())) for i, t, *_ in rows)
    got = sharding.assign(df, 4, 512, f"file://{tmp_path}/map").collect()
    assert Counter((x["doc_id"], x["size"] - 8) for x in got) == want
    shards = defaultdict(list)
    for x in got:
        shards[x["shard"]].append(x)
    assert all(sorted(x["slot"] for x in s) == list(range(len(s))) for s in shards.values())
    heaviest = 8 + 5 * 30_000
    rest = [sum(x["size"] for x in s if x["size"] < heaviest) for s in shards.values() if not any(x["size"] >= heaviest for x in s)]
    assert len(shards) == 4 and max(rest) < 1.3 * min(rest)
    small = df.where("length(text) < 2000 or text is null")
    want = Counter({k: n for k, n in want.items() if k[1] < 2000})
    media_rows = media.store_and_describe(small).collect()
    assert Counter((x["doc_id"], x["n_bytes"]) for x in media_rows) == want
    assert len({tuple(x)[2:] for x in media_rows}) == len({t or "" for t in texts if not t or len(t) < 2000})  # equal texts, equal values
    codes = sp_codec.digests(small, P.path("piece_bpe_32k.model")).collect()
    assert len(codes) == sum(want.values()) and len({x["ids_sha256"] for x in codes if x["decoded_sha256"] == sha("same text")}) == 1


# -- 2, 4 ---------------------------------------------------------------------------


def brute_dedup(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substring_dedup(spark, docs, empty):
    docs = docs.repartition(7)  # a chunk a file
    for width in (3, 20):
        got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.digests(spark, docs, width).collect()}
        assert got == brute_dedup([(r[0], r[1]) for r in ROWS], width)
    assert substring_dedup.digests(spark, empty).count() == 0
    left = {r["doc_id"]: r for r in substring_dedup.remove(spark, docs).collect()}
    for i, (_, n, digest) in brute_dedup([(r[0], r[1]) for r in ROWS], 20).items():
        assert sum(b - a for a, b in left[i]["removed"]) == n and left[i]["lang"] in ("en", None)
        assert left[i]["text"] == BY_ID[i] if not n else sha(left[i]["text"]) == digest


def test_substring_dedup_of_equal_ids_in_several_chunks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    # whatever the order of arrival in a slice, the same chunk keeps what it shares with others
    x = np.arange(1, 40, dtype=np.uint64)
    block = substring_dedup._pack_entries(x, np.zeros(39, np.uint8), np.array([chunks.NO_ID]), np.zeros(39, np.int64))
    for order in ("abc", "cba", "bca"):
        told = substring_dedup._answer(pa.Table.from_batches([chunks.block_batch([(0, f, 0, block) for f in order])]))
        assert sorted(told.column("file").to_pylist()) == ["b", "c"]
    # of a passage in rows of one id or none, one copy stays whole
    passage = [f"p{k}" for k in range(400)]
    for f in range(6):
        texts = [" ".join([*passage, f"end{f}"]), " ".join(f"q{k}" for k in range(300))]
        pq.write_table(pa.table({"doc_id": pa.array([None, 7], pa.int64()), "text": texts}), tmp_path / f"part{f}.parquet")
    left = [(r["doc_id"], r["text"].split()) for r in substring_dedup.remove(spark, str(tmp_path), 20).collect()]
    assert sorted(sum(w in t for _, t in left) for w in passage) == [1] * 400
    assert sorted(len(t) for i, t in left if i == 7) == [0] * 5 + [300]


def test_substring_dedup_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(30))), 5, "f", 1), (2, " ".join(map(str, range(25))), 6, "g", 2)], "doc_id long, text string, removed int, file string, slice int").coalesce(1)
    left = {r["doc_id"]: r for r in substring_dedup.remove(spark, df).collect()}
    assert (left[1]["removed"], left[2]["removed"], left[2]["text"], left[2]["file"], left[2]["slice"]) == ([], [[0, 25]], "", "g", 2)


def test_rolling_hashes():
    x = np.arange(50, dtype=np.uint64) ** 5
    for width in (1, 2, 3, 7, 20, 50):
        want = [sum(int(x[i + k]) * pow(int(chunks.BASE[0]), width - 1 - k, 1 << 64) for k in range(width)) % (1 << 64) for i in range(50 - width + 1)]
        assert (chunks.rolling(x, width, chunks.BASE[0]) == chunks.mix(np.array(want, np.uint64))).all()
    assert len(chunks.rolling(x, 51, chunks.BASE[0])) == 0
    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    e = np.arange(1000).astype(np.uint16)
    a, b = chunks.unpack(chunks.pack([h, e]), [np.uint64, np.uint16])
    assert (a == h).all() and (b == e).all()


def brute_similar(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False))
    near = {i: {j for j, b in sets.items() if j != i and a and b and 100 * len(a & b) >= 60 * len(a | b)} for i, a in sets.items()}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(sets[i]), len(near[i]), min(seen))
    return out


@pytest.mark.parametrize("group", [2, 512])
def test_ngram_join(spark, docs, empty, monkeypatch, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)  # 2: blocks and pairs of blocks
    got = {r["doc_id"]: (r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join.similar(spark, docs.repartition(5)).collect()}
    assert got == brute_similar([(r[0], r[1]) for r in ROWS])
    if group == 2:
        assert ngram_join.similar(spark, empty).count() == 0


def test_ngram_join_of_a_chunk_read_by_two_tasks(spark, tmp_path):
    """Row groups of 1000 rows, each a split of its own: chunks of 2048 rows begin in one task and end in another."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    base = [f"s{k}" for k in range(12)]
    texts = [" ".join(f"u{i}x{k}" for k in range(4)) for i in range(5000)]
    texts[3] = texts[2040] = " ".join(base)
    texts[4500] = " ".join([*base, "more"])
    path = str(tmp_path / "groups.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(5000), pa.int64()), "text": texts}), path, row_group_size=1000)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = {r["doc_id"]: (r["n_similar"], r["component_id"], r["class_id"]) for r in ngram_join.similar(spark, path).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert (got[3], got[2040], got[4500]) == ((2, 3, 3), (2, 3, 3), (2, 3, 4500))


def test_ngram_join_of_equal_and_missing_ids(spark):
    a, b = [f"a{k}" for k in range(12)], [f"b{k}" for k in range(12)]
    for name in (9, None):  # two texts under one id, each like another row, and like each other in a second pair
        rows = [(name, " ".join(a)), (name, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (name, " ".join([*a, "z"])), (name, " ".join(b)), (name, None)]
        got = ngram_join.similar(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        found = sorted((r["doc_id"] or 0, r["n_shingles"], r["n_similar"], r["component_id"] or 0, r["class_id"] or 0) for r in got)
        i = name or 0
        assert found == sorted([(i, 11, 2, 2, i), (i, 12, 2, 2, i), (2, 12, 2, 2, 2), (i, 11, 2, 3, i), (i, 11, 2, 3, i), (3, 12, 2, 3, 3), (i, 0, 0, i, i)])


def test_similar_sets_share_marks():
    r = np.random.default_rng(11)
    seen = 0
    for _ in range(4000):
        m = int(r.integers(1, 60))
        pool = np.unique(chunks.mix(r.integers(0, 2**63, 2 * m).astype(np.uint64)))
        a = np.sort(r.choice(pool, m, replace=False))
        b = np.unique(np.concatenate([a[r.random(m) < r.uniform(0.6, 1)], r.choice(pool, int(r.integers(0, m // 2 + 1)))]))
        c = len(np.intersect1d(a, b))
        if 160 * c < 60 * (len(a) + len(b)):
            continue
        seen += 1
        x, y = ngram_join.marks(a), ngram_join.marks(b)
        both = np.intersect1d(x, y)
        assert len(x) == len(a) + 1 and len(both) >= 3 * c - len(a) - len(b) + 1 > (len(a) + len(b)) / 8
        # in any order of marks, the first common one lies in both prefixes, where both have room
        at, bt = (np.searchsorted(np.sort(z), both[0]) for z in (x, y))
        assert at < ngram_join.prefix_length(len(a)) and bt < ngram_join.prefix_length(len(b))
        assert ngram_join._room(len(a), at) >= 3 * len(b) and ngram_join._room(len(b), bt) >= 3 * len(a)
        t, u = (ngram_join._unfold(*ngram_join._fold(z, np.full(len(z) + 1, 7, np.uint16))) for z in (a, b))
        assert (t[0] == a).all() and (u[0] == b).all() and (t[1] == np.sort(np.uint64(7 << 48) | x >> np.uint64(16))).all()
    assert seen > 1000


def test_ngram_join_of_few_words(spark):
    """2000 texts over 100 words: every shingle is in a dozen texts, but only the near copies have candidates, and from 60 %
    on a pair counts, one shingle less and it doesn't."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(100)}" for _ in range(r.randrange(50, 70))) for _ in range(2000)]
    base = [f"w{k}" for k in range(100)]
    for k in range(30):
        words = r.choice(texts[:20]).split()
        for _ in range(r.randrange(16)):
            words[r.randrange(len(words))] = r.choice(base)
        texts.append(" ".join(words))
    texts += [" ".join(f"x{k}" for k in range(7)), " ".join(f"x{k}" for k in range(11)), " ".join(f"x{k}" for k in range(12))]  # 6, 10, 11 shingles
    texts += ["p q", "p q r", "p q r s", "p"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    paths = chunks.written(df, spark)
    sets = chunks.written(ngram_join.ordered_sets(spark, paths), spark)
    posts = ngram_join.led_postings(spark, sets, chunks.file_numbers(spark, sets))
    assert posts.select("rep").distinct().count() < 200
    got = {r["doc_id"]: (r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join.similar(spark, paths[0]).collect()}
    assert got == brute_similar(rows)
    assert got[2030][1:] == (1, 2030) and got[2031][1:] == (2, 2030) and got[2032][1:] == (1, 2030)


def test_chunks_follow_the_length_of_rows(spark, tmp_path, monkeypatch):
    """Long rows make smaller chunks, larger tables more slices; results are the same."""
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(chunks, "SLICE_BYTES", 500)
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(ROWS, SCHEMA).coalesce(2).write.parquet(path)
    paths = chunks.written(path, spark)
    assert paths.rows == 8 and paths.slices > 8
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.digests(spark, path, 20).collect()} == brute_dedup([(r[0], r[1]) for r in ROWS], 20)
    assert {r["doc_id"]: (r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join.similar(spark, path).collect()} == brute_similar([(r[0], r[1]) for r in ROWS])
    brute_lm([(r[0], r[1], r[2] == "en") for r in ROWS], *lm_score.dictionaries(spark.read.parquet(path), F.col("lang") == "en"), {r["doc_id"]: r for r in lm_score.lm_score(spark.read.parquet(path), F.col("lang") == "en").collect()})


def test_signatures_bound_the_difference():
    r = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 3000, r.integers(1, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = ngram_join.signature(a), ngram_join.signature(b)
        width = min(len(x), len(y))
        p, q = ngram_join.folded([x, y], width)
        assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(a, b)) and (ngram_join.folded([x], len(x)) == np.frombuffer(x, np.uint64)).all()


def test_trie_overlaps():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = np.unique(r.integers(0, 400, 60).astype(np.uint64))
        for _ in range(5):
            sets.append(np.unique(np.concatenate([base[r.random(len(base)) < 0.9], r.integers(0, 400, 5).astype(np.uint64)])))
    sets = list({s.tobytes(): s for s in sets}.values())
    trie = ngram_join.Trie(sets)
    for k, x in enumerate(sets):
        at, over = trie.overlaps(x)
        got = {trie.order[a]: o for a, o in zip(at.tolist(), over.tolist(), strict=True)}
        want = {j: len(np.intersect1d(x, y)) for j, y in enumerate(sets)}
        assert got == {j: o for j, o in want.items() if 160 * o >= 60 * (len(x) + len(sets[j]))} and k in got


def test_components_in_rounds(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (50, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    for at_once in (1000, 0):
        got = {r[0]: r[1] for r in ngram_join.components(df, "a", "b", at_once).collect()}
        assert got == {**{i: 0 for i in range(41)}, 50: 0, 100: 100, 101: 100, 103: 100}


# -- 1, 5, 7 ------------------------------------------------------------------------


def test_neighbours(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 16))
    v = centres[r.integers(0, 12, 3000)] + 0.7 * r.normal(size=(3000, 16))
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    bad = [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [None] * 16, 1), (5080, [1.0], 1), (None, v[0].tolist(), 1)]
    repeat = [(20, v[20].tolist(), 1), (7000, v[40].tolist(), 1)]
    df = spark.createDataFrame(rows + bad + repeat, "vec_id long, embedding array<double>, query_id int")
    got = defaultdict(list)
    for q, rank, i, s in ann.neighbours(df, F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        assert rank == len(got[q]) + 1
        got[q].append((i, s))
    ids = [*range(3000), 20, 7000]
    whole = np.vstack([v, v[20], v[40]])
    hits = total = 0
    for q in [*range(0, 3000, 20), 7000]:
        own = ids.index(q)
        score = whole @ whole[own]
        order = sorted((k for k in range(len(ids)) if k != own), key=lambda k: (-score[k], ids[k]))[:10]
        want = [(ids[k], score[k]) for k in order]
        assert len(got[q]) == 10
        assert [x for x, _ in got[q]] == [x for x, _ in sorted(got[q], key=lambda p: (-p[1], p[0]))]
        hits += len({x for x, _ in want} & {x for x, _ in got[q]})
        total += len({x for x, _ in want})
    assert set(got) == {*range(0, 3000, 20), 7000} and hits / total >= 0.9
    assert (20, pytest.approx(float(v[20] @ v[20]))) in got[20]  # the repeat of the query's own row counts
    few = ann.neighbours(df.where("vec_id < 4"), F.col("vec_id") % 20 == 0, 10).collect()
    assert len(few) == 3
    assert ann.neighbours(df.where("vec_id = 5000"), F.col("vec_id") % 20 == 0).count() == 0


def brute_neighbours(rows, k):
    """(query id, rank, id, score), sorted: every distinct (id, vector) of an id divisible by 20 is asked once."""
    out, asked = [], set()
    for at, (i, x) in enumerate(rows):
        if i % 20 == 0 and (i, x) not in asked:
            asked.add((i, x))
            best = sorted((-float(np.dot(x, y)), j) for b, (j, y) in enumerate(rows) if b != at)[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    return sorted(out)


def test_neighbours_of_repeated_ids_and_ties(spark):
    rows = [(20, (1.0, 0.0)), (20, (5.0, 0.0)), (1, (2.0, 0.0))]
    # a vector that most rows hold, ties at the last rank, one id for many rows
    many = [(i, (1.0, 1.0)) for i in range(300)] + [(40, (1.0, 1.0)), (7, (3.0, 0.0)), (7, (0.0, 3.0)), (600, (-1.0, 2.0)), (600, (-1.0, 2.0)), *[(9, (float(k), -1.0)) for k in range(30)]]
    for held, k in ((rows, 5), (many, 4)):
        df = spark.createDataFrame([(i, list(x)) for i, x in held], "vec_id long, embedding array<double>").repartition(3)
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.neighbours(df, F.col("vec_id") % 20 == 0, k).collect())
        assert got == brute_neighbours(held, k)
    wide = spark.createDataFrame([(i, [float((i * 7 + j) % 11) for j in range(3000)]) for i in range(25)] + [(60, [float("inf")] * 3000)], "vec_id long, embedding array<double>")
    assert ann.neighbours(wide, F.col("vec_id") % 20 == 0, 3, query_rows=True).columns == ["query_id", "rank", "vec_id", "score", "query_row"]
    assert ann.neighbours(wide, F.col("vec_id") % 20 == 0, 30).count() == 2 * 24


def test_graph_recall_over_a_larger_shard():
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 24))
    v = centres[r.integers(0, 40, 20_000)] + 0.5 * r.normal(size=(20_000, 24))
    graph = ann.Graph(np.arange(len(v)), v).build()
    asked = v[::200]
    q, ids, _, score = ann._best(*graph.search(asked, 20), 20)
    truth = np.argsort(-(asked @ v.T), axis=1)[:, :20]
    assert sum(len(set(ids[q == k]) & set(truth[k])) for k in range(len(asked))) >= 0.9 * truth.size
    assert np.allclose(score, np.einsum("ij,ij->i", asked[q], v[ids]))


def test_quality(spark, empty):
    r = random.Random(4)
    clean = lambda: " ".join(r.choice(["river", "stone", "walks", "under", "light", "and", "the"]) + r.choice(["", ",", "."]) for _ in range(r.randrange(20, 80)))
    junk = lambda: " ".join(r.choice(["buy", "click", "now", "win"]) + "$$$" for _ in range(r.randrange(20, 80)))
    rows = [(i, clean() if i % 4 else junk(), i % 4 > 0) for i in range(400)] + [(1000, None, True), (1001, "", True), (None, "the river", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.classify(docs, labels, F.col("quality") == 1).collect()}
    assert len(out) == 403
    held_out = [i for i in range(200, 400)]
    assert all(out[i]["kept"] == (i % 4 > 0) for i in held_out) and out[1000]["score"] == 0
    assert quality.classify(empty, labels, F.col("quality") == 1).count() == 0
    assert quality.classify(docs, labels.limit(0), F.col("quality") == 1).where("not kept").count() == 0
    x = spark.createDataFrame([(float(v),) for v in [3, -1, 2.5, -7, 0, 2.5, 1e300, -0.0]], "x double")
    values = sorted([3, -1, 2.5, -7, 0, 2.5, 1e300, -0.0], reverse=True)
    assert [quality.kth_largest(x, "x", k) for k in range(1, 9)] == values


def brute_grams(text):
    """Buckets of single tokens and pairs, one by one."""
    mask, q, out, last = 2**64 - 1, quality, [], None
    for token in re.findall(r"\w+|[^\w\s]+", text or ""):
        if len(token) > 1 and token.isupper():
            h = int(q.CAPITALS)
        else:
            data = token.lower().encode()
            h = (zlib.crc32(data) << 32 | zlib.adler32(data)) * 0x9E3779B97F4A7C15 & mask
        out.append((h, int(q.REPEAT) if h == last else h))
        last = h
    h = [b for _, b in out]
    both = h + [(a * 0x100000001B3 + b) & mask for a, b in zip(h, h[1:], strict=False)]
    return [(((x ^ x >> 33) * int(q._MIX) & mask) >> 40) % q.BUCKETS for x in both]


def test_quality_against_brute_force(spark):
    """Counts, ratios, threshold, keys and the kept set, over ties, repeats, capitals, long texts and clashing columns."""
    r, vocabulary = random.Random(8), ["stone", "River", "LOUD", "win", "win", "buy!!", "é", "a"]
    rows = [(i % 150 if i % 10 else None, " ".join(r.choice(vocabulary[: 4 if i % 3 else 8]) for _ in range(r.randrange(1, 60)))) for i in range(300)]
    rows += rows[:5] + [(7, None), (8, ""), (9, "long " * 70_000), (10, "same text"), (11, "same text")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)] + [(5, 0, 0), (None, 1, 0), (61, None, 0)]
    df = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, kind int, grams string, score double").repartition(3)
    got = quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("quality") == 1, carry=()).collect()
    sample = {i: bool(q) for i, q, _ in labels if i is not None and q is not None} | {5: False}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    held = [(i, t, brute_grams(t)) for i, t in rows]
    for i, _, g in held:
        np.add.at(raw, g, 1)
        np.add.at(target, g if sample.get(i) else [], 1)
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * quality.BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * quality.BUCKETS))
    scores = [sum(ratio[b] for b in g) / (len(g) + quality.STEADY) for _, _, g in held]
    seen = sorted((s, sample[i]) for (i, _, _), s in zip(held, scores, strict=True) if i in sample)
    costs = [sum(y for _, y in seen[:k]) + 0.25 * sum(not y for _, y in seen[k:]) for k in range(len(seen) + 1)]
    best = [k for k, c in enumerate(costs) if c == min(costs)]
    k = best[len(best) // 2]
    threshold = -np.inf if k == 0 else seen[-1][0] + 1 if k == len(seen) else (seen[k - 1][0] + seen[k][0]) / 2
    keys = [s / quality.TEMPERATURE + quality.gumbel(i, (t or "").encode()) for (i, t, _), s in zip(held, scores, strict=True)]
    n = sum(s >= threshold for s in scores)
    cut = sorted(keys)[-n] if n else np.inf
    want = sorted((i if i is not None else -1, len(g), round(s, 9), round(key, 6), key >= cut - 1e-9) for (i, _, g), s, key in zip(held, scores, keys, strict=True))
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["n_grams"], round(x["score"], 9), round(x["key"], 6), x["kept"]) for x in got) == want
    assert 0 < n < len(rows)


def lm_dictionary(counts, size):
    """The words that save most, the best last."""
    out, held = [], 0
    for w, n in sorted(counts.items(), key=lambda p: (-(len(p[0].encode()) - 3) * p[1], p[0].encode())):
        if len(w.encode()) > 3 and held + len(w.encode()) + 1 <= size:
            out.append(w.encode())
            held += len(out[-1]) + 1
    return b" ".join(reversed(out))


def brute_lm(rows, inside, general, got):
    """Sizes under the common words and the runs of words in phrases that another row holds, by counting tuples of words."""
    phrases = lambda w: [tuple(w[k : k + 8]) for k in range(len(w) - 7)] if len(w) >= 8 else [tuple(w)] if w else []
    all_, in_ = Counter(), Counter()
    for _, t, flag in rows:
        held = set(phrases(words(t)))
        all_.update(held)
        in_.update(held if flag else ())

    def runs(w, known):
        marks = [False] * len(w)
        for k, p in enumerate(phrases(w)):
            if known(p):
                marks[k : k + len(p)] = [True] * len(p)
        return [" ".join(w[a:b]).encode() for a, b in re_spans(marks)], sum(marks)

    for i, t, flag in rows:
        w, raw, r = words(t), (t or "").encode(), got[i]
        (near, n_in), (far, n_all) = runs(w, lambda p: in_[p] - flag > 0), runs(w, lambda p: all_[p] > 1)  # noqa: B023
        assert (r["n_words"], r["n_in_seen"], r["n_seen"]) == (len(w), n_in, n_all)
        if raw:
            a, b = (lm_score.Compressor(c).size(raw, b" ".join(found)) for c, found in ((inside, near), (general, far)))
            assert (r["n_bytes"], r["in_bytes"], r["general_bytes"], r["score"], r["in_bits"]) == (len(raw), a, b, (b - a) / len(raw), 8 * a / len(raw))
        else:
            assert (r["in_bytes"], r["general_bytes"], r["score"]) == (0, 0, None)


def re_spans(marks):
    return [m.span() for m in re.finditer("1+", "".join("1" if m else "0" for m in marks))]


def test_lm_score_of_copies(spark, docs):
    rows = [(r[0], r[1], r[2] == "en") for r in ROWS]
    got = {r["doc_id"]: r for r in lm_score.lm_score(docs, F.col("lang") == "en").collect()}
    brute_lm(rows, *lm_score.dictionaries(docs, F.col("lang") == "en"), got)
    # a text that two rows hold is known to the corpus, whatever its length; one row's own text isn't
    once = " ".join(f"only{k}" for k in range(40))
    twice, brief, long = " ".join(f"both{k}" for k in range(40)), "three words here", "z" * 5000
    held = [(1, once, True), (2, twice, True), (3, twice, False), (4, brief, True), (5, brief, True), (None, long, True), (None, long, True), (6, None, None), (6, "", None)]
    df = spark.createDataFrame([(i, t, f, "x") for i, t, f in held], "doc_id long, text string, inside boolean, slice string").repartition(4)
    out = sorted((tuple(r) for r in lm_score.lm_score(df, F.col("inside")).select("n_words", "n_in_seen", "n_seen").collect()))
    assert out == sorted([(40, 0, 0), (40, 0, 40), (40, 40, 40), (3, 3, 3), (3, 3, 3), (1, 1, 1), (1, 1, 1), (0, 0, 0), (0, 0, 0)])
    known = lm_score.Compressor(inside := lm_score.dictionaries(df, F.col("inside"))[0])
    far = bytes(np.random.default_rng(0).integers(97, 123, 3 << 20).astype(np.uint8))  # beyond the level's window
    assert known.size(far, far) < 5000 < 10**6 < known.size(far)
    assert b"z" * lm_score.PIECE in inside and b"z" * (lm_score.PIECE + 1) not in inside


def test_lm_score(spark, docs, empty):
    rows = [(i, " ".join(random.Random(i).choice(["alpha", "river", "stone", "cloud", "meadow"] if i % 2 else ["gamma", "engine", "socket", "packet", "router"]) for _ in range(60)), i % 2 == 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, inside boolean")
    counts = {bytes(r["word"]).decode(): (r["n"], r["n_in"]) for r in lm_score.word_counts(df, F.col("inside")).collect()}
    want = Counter(w for _, t, _ in rows for w in t.split())
    assert {w: n for w, (n, _) in counts.items()} == want and counts["river"][1] == want["river"] and counts["router"][1] == 0
    inside, general = lm_score.dictionaries(df, F.col("inside"))
    assert lm_dictionary(want, lm_score.DICTIONARY_BYTES) == general
    got = {r["doc_id"]: r for r in lm_score.lm_score(df, F.col("inside")).collect()}
    brute_lm([(i, t, inside_) for i, t, inside_ in rows], inside, general, got)
    scores = {r["doc_id"]: r["score"] for r in lm_score.lm_score(df, F.col("inside")).collect()}
    assert np.mean([s for i, s in scores.items() if i % 2]) > np.mean([s for i, s in scores.items() if not i % 2])
    hard = {r["doc_id"]: r for r in lm_score.lm_score(docs, F.col("lang") == "en").collect()}
    assert len(hard) == len(ROWS) and all((hard[i]["score"] is None) == (not t) for i, t in BY_ID.items())
    assert lm_score.lm_score(empty, F.col("lang") == "en").count() == 0
