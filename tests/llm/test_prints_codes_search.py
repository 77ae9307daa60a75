"""SimHash near-dedup, vector codes and ranked search: brute force and edge cases."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gatewise.llm import codebooks, ranked_search, simhash

ODD = [None, "", " ", "\n\t", "A", "a", "é x", "two words", "TWO  words", "word " * 30_000, "x\x0by\x1cz", "x\x0by\x1cz"]


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


# ---- SimHash


def plain_print(text, size):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if x]
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def made_texts(r, n):
    words = ["ab%d" % i for i in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(1, 60))] for _ in range(n)]
    near = []
    for own in base[: n // 3]:
        copy = list(own)
        copy[r.randrange(len(copy))] = "CHANGED"
        near.append(copy if r.random() < 0.7 else own)
    return [" ".join(x) for x in base + near]


@pytest.mark.parametrize(("size", "radius", "shard"), [(3, 2, 20_000), (3, 6, 20), (2, 0, 20), (1, 9, 15)])
def test_simhash(spark, monkeypatch, size, radius, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "SHARE", 2)
    monkeypatch.setattr(simhash, "FEWEST", 4)
    texts = ODD + made_texts(random.Random(size), 120)
    prints = [plain_print(t, size) for t in texts]
    linked = [(i, j) for i, j in combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= radius]
    docs = spark.createDataFrame([(i, t, "old", "old", 1) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string, component_id string, n int")
    got = simhash.near_fingerprints(spark, docs, size=size, radius=radius).orderBy("doc_id").collect()
    assert [int(r.fingerprint, 16) for r in got] == prints
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got)
    assert [r.component_id for r in got] == groups(len(texts), linked)


def test_simhash_odd_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "A B C D"), (None, "p q r s t"), (3, None), (1, "")], "doc_id long, text string")
    got = simhash.near_fingerprints(spark, docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("3", "1"), ("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash.near_fingerprints(spark, docs.limit(0)).count() == 0
    named = simhash.near_fingerprints(spark, docs.withColumn("doc_id", F.concat(F.lit("n"), "doc_id")))
    assert {r.component_id for r in named.collect()} == {"n1", "n7", None}


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join("w%d" % random.Random(i).randint(0, 50) for i in range(500))
    whole = np.concatenate(list(simhash.shingle_hashes(text.encode(), 3)))
    monkeypatch.setattr(simhash, "_CUT", 7)
    monkeypatch.setattr(simhash, "_ROOM", 40)
    parts = list(simhash.shingle_hashes(text.encode(), 3))
    assert len(parts) > 50 and np.array_equal(np.concatenate(parts), whole)
    counts = simhash.Majority(2)
    for x in parts:
        counts.add(1, x)
    assert counts.fingerprints().tolist() == [0, plain_print(text, 3)]


def near_prints(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 5)).astype(np.uint64), axis=1)
    near = centres[rng.integers(0, 40, n)] ^ (flips & rng.integers(0, 2**64, n, dtype=np.uint64))
    return np.unique(np.concatenate([near, rng.integers(0, 2**64, n, dtype=np.uint64)]))


@pytest.mark.parametrize("radius", [1, 2, 5])
def test_every_pair_meets_in_one_shard(monkeypatch, radius):
    monkeypatch.setattr(simhash, "SHARD", 100)
    fps = near_prints(radius, 1500)
    tree = simhash.Tree(fps[::3], len(fps), radius)
    assert tree.shards > 8
    shard, who, home = tree.route(fps)
    assert sorted(who[home].tolist()) == list(range(len(fps)))
    met = []
    for s in np.unique(shard):
        mine, own = who[shard == s], home[shard == s]
        assert len(set(mine.tolist())) == len(mine)
        for i in mine[own]:
            for j in mine[~own]:
                if int(fps[i] ^ fps[j]).bit_count() <= radius:
                    met.append((min(i, j), max(i, j)))
        met += [(i, j) for i, j in combinations(sorted(mine[own].tolist()), 2) if int(fps[i] ^ fps[j]).bit_count() <= radius]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    assert sorted(met) == [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j]


@pytest.mark.parametrize(("leaf", "links"), [(512, 1 << 20), (8, 1 << 20), (8, 50)])
def test_links_of_a_shard(monkeypatch, leaf, links):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "_LINKS", links)
    fps = near_prints(9, 900)
    homes, visitors = fps[: len(fps) // 2], fps[len(fps) // 2 :]
    a, b = simhash.shard_links(homes, visitors, 4)
    assert len(a) < len(fps)
    at = {int(x): i for i, x in enumerate(fps)}
    near = [(i, j) for i, j in combinations(range(len(fps)), 2) if i < len(homes) and int(fps[i] ^ fps[j]).bit_count() <= 4]
    assert groups(len(fps), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]) == groups(len(fps), near)


def test_what_no_vantage_point_parts_is_dealt_to_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 50)
    ball = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64), (np.uint64(1) << np.arange(64, dtype=np.uint64))[:, None].repeat(64, 1).ravel() | np.tile(np.uint64(1) << np.arange(64, dtype=np.uint64), 64)])
    fps = np.unique(ball)
    tree = simhash.Tree(fps[::4], len(fps), 4)
    assert tree.blocks.max() > 4
    shard, who, home = tree.route(fps)
    pairs = {(i, j) for s in np.unique(shard) for i in who[(shard == s) & home] for j in who[shard == s]}
    assert all((i, j) in pairs or (j, i) in pairs for i, j in combinations(range(0, len(fps), 7), 2) if int(fps[i] ^ fps[j]).bit_count() <= 4)


# ---- vector codes


def plain_codes(rows, parts, entries, rounds, scale=4096):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min((far(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [best(v[p], books[p])[1] for v in cut]
            for k in range(len(books[p])):
                mine = [v[p] for v, o in zip(cut, own, strict=True) if o == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    ends = [[best(v[p], books[p]) for p in range(parts)] for v in cut]
    error = [sum(d for d, _ in e) for e in ends]
    by = {}
    for (_, label, _), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in e), err, by[label]) for (i, label, _), e, err in zip(kept, ends, error, strict=True)), digest


@pytest.mark.parametrize(("n", "parts", "entries", "rounds"), [(300, 4, 16, 6), (9, 2, 16, 3), (200, 8, 5, 0), (50, 1, 3, 2)])
def test_vector_codes(spark, n, parts, entries, rounds):
    r = random.Random(n)
    rows = [(i, r.choice([None, "a", "b", ""]), [r.choice([-0.5, 0.0, 0.25, r.uniform(-1, 1)]) for _ in range(8)]) for i in range(n)]
    rows += [(None, "a", [0.1] * 8), (n + 1, "a", None), (n + 2, "b", [0.1] * 7 + [float("nan")]), (n + 3, "b", [None] + [0.1] * 7), (n + 4, None, [float("inf")] * 8), (n - 1, "b", rows[-1][2])]
    df = spark.createDataFrame([(*x, "old", 3) for x in rows], "vec_id long, label string, embedding array<double>, code string, error int")
    done, books = codebooks.compress(spark, df, parts=parts, entries=entries, rounds=rounds)
    want, digest = plain_codes(rows, parts, entries, rounds)
    assert sorted((str(x.vec_id), x.code, x.error, x.label_error) for x in done.collect()) == want
    assert codebooks.books_digest(books) == digest
    back = codebooks.decode(done, books).collect()
    names = {x.code: x.vector for x in back}
    for code, vector in names.items():
        picked = [books[p][int(code[2 * p : 2 * p + 2], 16)] for p in range(parts)]
        assert vector == [c / 4096 for part in picked for c in part.tolist()]


def test_vector_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, [float("nan")])], "vec_id long, label int, embedding array<float>")
    for odd in (df, df.limit(0)):
        done, books = codebooks.compress(spark, odd)
        assert done.count() == 0 and books is None
        assert done.columns == ["vec_id", "label", "code", "error", "label_error"]


@pytest.mark.parametrize("vectors", [[[1.0] * 8, [1.0] * 16], [[1.0] * 7], [[1e9] * 8]])
def test_vectors_without_codebooks(spark, vectors):
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(vectors)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="components|component of"):
        codebooks.compress(spark, df)[0].collect()


def test_nearest_against_all_distances():
    rng = np.random.default_rng(3)
    for k, width in [(1, 1), (16, 8), (16, 3), (40, 2)]:
        book = rng.integers(-4, 5, (k, width))
        x = rng.integers(-5, 6, (500, width))
        far = np.square(x[:, None] - book[None]).sum(2)
        entry, d = codebooks.nearest(x, book)
        assert np.array_equal(entry, far.argmin(1)) and np.array_equal(d, far.min(1))
    assert [len(x) for x in codebooks.nearest(x[:0], book)] == [0, 0]


# ---- ranked search


def plain_ranking(docs, queries, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    own = [(i, w) for i, t in docs if (w := split(t))]
    n, total = len(own), sum(len(w) for _, w in own)
    df = {}
    for _, w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in queries:
        scored = []
        for i, w in own:
            m = 75 + 25 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 12 * m)) for t in split(text) if t in df)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(str(q), r + 1, str(i), -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "terms"), [(8192, 50_000), (8, 50_000), (8, 40)])
def test_ranked_search(spark, monkeypatch, shard, terms):
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    monkeypatch.setattr(ranked_search, "FEWEST", 4)
    monkeypatch.setattr(ranked_search, "TERMS", terms)
    r = random.Random(5)
    pools = [["%s%d" % (p, i) for i in range(30)] for p in ("ab", "é", "X")]
    docs = list(enumerate(ODD)) + [(100 + i, ". ".join(r.choice(pools[i % 3]) for _ in range(r.randint(1, 40)))) for i in range(150)]
    docs += [(100, docs[12][1]), (None, docs[12][1]), (None, docs[30][1]), (9000, docs[12][1])]
    queries = [(i, " ".join(r.choice(pools[i % 3]) for _ in range(12))) for i in range(9)] + [(3, docs[12][1]), (None, "word a"), (10, None), (11, "!"), (12, "never seen")]
    left = spark.createDataFrame([(i, t, "old", "old") for i, t in docs], "doc_id long, text string, rank string, n string")
    right = spark.createDataFrame([(q, t, "old") for q, t in queries], "item_id long, text string, row string")
    got = ranked_search.search(spark, left, right, k=7)
    assert sorted((str(x.item_id), x.rank, str(x.doc_id), x.score) for x in got.collect()) == plain_ranking(docs, queries, 7)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([("a", "some words"), ("b", None)], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "words")], "item_id int, text string")
    assert [tuple(x) for x in ranked_search.search(spark, docs, queries).collect()] == [(1, 1, "a", math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 12 * 100)))]
    for d, q in [(docs.limit(0), queries), (docs, queries.limit(0)), (docs.limit(0), queries.limit(0))]:
        assert ranked_search.search(spark, d, q).count() == 0


def test_terms_are_cut_between_terms(monkeypatch):
    text = "Ab, é-x1! " * 50
    want = {"ab": 50, "é": 50, "x1": 50}
    assert {t.decode(): n for t, n in ranked_search.count_terms(text).items()} == want
    monkeypatch.setattr(ranked_search, "_CUT", 3)
    assert {t.decode(): n for t, n in ranked_search.count_terms(text).items()} == want


def test_bisection_parts_documents_without_common_terms():
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 4, 400)
    lists = [np.unique(25 * k + rng.integers(0, 25, 12)) for k in kind]
    gains = ranked_search.fit_bisection(lists, 100, 2)
    leaf = ranked_search.route(np.array([len(x) for x in lists]), np.concatenate(lists), gains)
    assert all(len(set(leaf[kind == k])) == 1 for k in range(4)) and len(set(leaf)) == 4
    assert ranked_search.route(np.array([0, 2]), np.array([1, 2]), np.zeros((0, 100))).tolist() == [0, 0]


def test_queries_stop_at_shards_that_cannot_matter(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD", 20)
    monkeypatch.setattr(ranked_search, "FEWEST", 4)
    visited = []
    plain = ranked_search.visit
    monkeypatch.setattr(ranked_search, "visit", lambda index, visits, weights, k: visited.append(visits.selectExpr("sum(size(asked))").first()[0]) or plain(index, visits, weights, k))
    r = random.Random(2)
    docs = [(i, " ".join("%s%d" % ("abcdefgh"[i % 8], r.randint(0, 60)) for _ in range(30))) for i in range(640)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    queries = [(i, docs[i][1]) for i in range(0, 640, 40)]
    got = ranked_search.search(spark, frame, spark.createDataFrame(queries, "item_id long, text string"), k=1)
    assert sorted((x.item_id, x.doc_id) for x in got.collect()) == [(i, i) for i, _ in queries]
    assert sum(visited) < len(queries) * 640 / 20 / 2  # of about 32 shards
