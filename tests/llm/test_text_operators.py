"""Line dedup, near dedup, decontamination, license scan, chat: brute force and edge cases."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.llm import chat, decontaminate, graphs, licenses, line_dedup, near_dedup

EDGES = [None, "", " ", "\n", "\n\n", "A", "é x", "word " * 30_000, "same\nsame\nSAME \n" * 3, "\t\x0b tab"]


def table(spark, texts, extra="n_lines string, n_words string, kept string, score string, cid string"):
    """Documents with columns whose names clash with outputs."""
    names = [c.split()[0] for c in extra.split(", ")]
    rows = [(i, t, *(["old"] * len(names))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


# ---- line dedup


def lines_dropped(texts, least):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    split = [(t or "").split("\n") for t in texts]
    count = {}
    for own in split:
        for k in {key(x) for x in own}:
            count[k] = count.get(k, 0) + 1
    gone = {k for k, n in count.items() if k and n >= least}
    return [(len(own), sum(key(x) in gone for x in own), "\n".join(x for x in own if key(x) not in gone)) for own in split]


@pytest.mark.parametrize("broadcast_bytes", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup(spark, broadcast_bytes):
    r = random.Random(1)
    texts = EDGES + ["\n".join(r.choice(["Menu", " menu\t", "Ünique", "ÜNIQUE", "x%d" % r.randint(0, 40), ""]) for _ in range(r.randint(0, 9))) for _ in range(60)]
    docs = table(spark, texts, "n_lines string, kept string, _row string, _gone string, shard string, line string")
    got = line_dedup.drop_common_lines(spark, docs, min_docs=3, broadcast_bytes=broadcast_bytes).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in got] == lines_dropped(texts, 3)
    assert got[0].kept == got[0]._row == got[0]._gone == got[0].line == "old"
    nothing = line_dedup.drop_common_lines(spark, table(spark, []), min_docs=3, broadcast_bytes=broadcast_bytes)
    assert nothing.count() == 0


@pytest.mark.parametrize("broadcast_bytes", [line_dedup.BROADCAST_BYTES, 0])
def test_the_count_array_decides(spark, monkeypatch, broadcast_bytes):
    """Every distinct line is in the index; a line goes or stays by its count there."""
    texts = ["often\ntwice\nonce %d" % i if i < 2 else "often" for i in range(6)]
    whole, made = line_dedup.shard_table, []

    def changed(counted, n_shards):
        made.append(sorted(r.n for r in counted.collect()))
        return whole(counted.withColumn("n", F.when(F.col("n") == 6, 1).when(F.col("n") == 2, 5).otherwise(F.col("n"))), n_shards)

    monkeypatch.setattr(line_dedup, "shard_table", changed)
    got = line_dedup.drop_common_lines(spark, table(spark, texts), min_docs=5, broadcast_bytes=broadcast_bytes).orderBy("doc_id").collect()
    assert made == [[1, 1, 2, 6]]
    assert [r.text for r in got] == ["often\nonce 0", "often\nonce 1", *["often"] * 4]


def test_perfect_hash():
    h = np.random.default_rng(0).integers(0, 2**64, (7000, 2), dtype=np.uint64)
    shard = h[:, 0] % np.uint64(3)
    index = line_dedup.LineIndex({s: line_dedup.build_shard(h[shard == s, 0], h[shard == s, 1], np.arange(7000)[shard == s] + 1) for s in range(3)}, 3)
    assert (index.count(h[:, 0], h[:, 1]) == np.arange(7000) + 1).all()
    assert not index.count(h[:, 1], h[:, 0]).any()
    assert len(index.prints) == 7000


# ---- near duplicates


def shingle_sets(texts, size):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def near_groups(texts, size, percent):
    sets, root = shingle_sets(texts, size), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def near_corpus(seed, families, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(families):
        base = [r.choice(words) for _ in range(r.choice([4, 40, 150]))]
        for _ in range(r.randint(1, n)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t) if r.random() < 0.8 else "\t".join(t).upper())
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, size, percent):
    texts = EDGES + near_corpus(size, 30, 9)
    got = near_dedup.near_duplicates(spark, table(spark, texts), size=size, percent=percent).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == near_groups(texts, size, percent)


def test_near_dedup_in_blocks(spark, monkeypatch):
    """Groups cut into many blocks give the same components."""
    monkeypatch.setattr(near_dedup, "BLOCK", 300)
    texts = near_corpus(5, 6, 30)
    got = near_dedup.near_duplicates(spark, table(spark, texts), size=3, percent=85).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == near_groups(texts, 3, 85)


def test_near_dedup_odd_ids(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "A B C D"), (3, "x y z"), (None, "lone text here"), (None, None)]
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (-1, 7, False), (3, 3, True), (7, 7, True), (7, 7, True)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(spark, empty).count() == 0


def test_sets_linked_only_through_a_hub():
    """Copies that are near a base but not near each other form one component."""
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([np.delete(base, range(i * 5, i * 5 + 5)), np.arange(1000 + i * 10, 1005 + i * 10, dtype=np.uint64)])) for i in range(12)]
    assert near_dedup.link_sets(sets, 85).tolist() == list(range(12))
    assert near_dedup.link_sets([*sets, base], 85).tolist() == [0] * 13


def test_thresholds_that_no_signature_serves():
    assert near_dedup.design(85) == (8, near_dedup.design(85)[1])
    for percent in (30, 50, 80, 85, 100):
        chunks, accept = near_dedup.design(percent)
        meets = sum(near_dedup.comb(5, e) * (percent / 100) ** (5 - e) * (1 - percent / 100) ** e for e in range(2))
        assert (1 - meets) ** chunks <= near_dedup.MISSED
        assert accept < chunks * near_dedup.WIDTH or percent < 60
    for percent in (0, 10, 101):
        with pytest.raises(ValueError, match="no signature"):
            near_dedup.design(percent)
    assert all((a == b[:7]).all() for a, b in zip(near_dedup.multipliers(7), near_dedup.multipliers(90), strict=True))


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HOT", 10)
    left = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(200)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k < 2").withColumn("name", F.concat(F.lit("k"), "k"))
    for how in ("inner", "left"):
        got = sorted((x.v, x.name) for x in graphs.join_hot(left, right, "k", "v", how).collect())
        want = [(i, f"k{i % 3}" if i % 5 and i % 3 < 2 else None) for i in range(200)]
        assert got == [x for x in want if how == "left" or x[1]]
    salted = graphs.join_hot(left, right, "k", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in salted


def test_near_dedup_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HOT", 5)
    texts = near_corpus(11, 8, 20)
    got = near_dedup.near_duplicates(spark, table(spark, texts), size=3, percent=85).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == near_groups(texts, 3, 85)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(60)]
    low = {x: x for e in edges for x in e}
    while True:
        before = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    got = {x.node: x.root for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in low.items() if k not in alone}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- decontamination


def contaminated(texts, items, window=10):
    cut = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    windows = {}
    for item, t in items:
        w = cut(t)
        n = min(len(w), window)
        for i in range(len(w) - n + 1) if n else []:
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return out


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination(spark, broadcast_rows):
    r = random.Random(3)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("aé1")
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 4, 9, 10, 11, 30, 60])))) for i in range(25)]
    items += [(3, items[4][1]), (100, items[4][1] + " more"), (101, None), (102, "..."), (None, " ".join(word() for _ in range(12)))]
    texts = list(EDGES)
    for _ in range(60):
        own = [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            taken = r.choice(items)[1]
            taken = (taken or "").split()
            a = r.randint(0, max(0, len(taken) - 3))
            own[r.randint(0, len(own)) :] = taken[a : a + r.randint(1, 40)]
        texts.append(r.choice([" ", "-", "\n"]).join(own).replace("é", r.choice(["é", "É"])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(spark, table(spark, texts), bench, broadcast_rows=broadcast_rows).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_hit, list(x["items"]), x.contaminated) for x in got] == contaminated(texts, items)
    assert all(x.n_items == len(x["items"]) and x.kept == "old" for x in got)


def test_fingerprints_are_winnowed(spark):
    """Few of the windows begin a run, every window belongs to one, and a shared window keeps the same print anywhere."""
    r = random.Random(8)
    base = [r.choice("abcdefghijklmnop") + r.choice("abcdefghijklmnop") for _ in range(400)]
    texts = [base, ["x"] * 3 + base[50:90] + ["y"] * 7, ["z"] * 11 + base[55:65], ["same"] * 50, base[:9], []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, _w array<string>")
    got = {x.doc_id: [tuple(p) for p in x._prints] for x in decontaminate.with_fingerprints(df).collect()}
    for i, t in enumerate(texts):
        assert [at + k for _, _, at, n in got[i] for k in range(n)] == list(range(max(0, len(t) - 9)))
    assert len(got[0]) < 0.5 * 391  # about 2 of 7
    kept = lambda i, j: next(fp for _, fp, at, n in got[i] if at <= j < at + n)
    assert all(kept(0, 50 + j) == kept(1, 3 + j) for j in range(31))
    assert kept(0, 55) == kept(2, 11)


@pytest.mark.parametrize("broadcast", [True, False])
def test_without_shared_fingerprints_no_window_is_compared(spark, broadcast):
    r = random.Random(9)
    text = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(200)) for _ in range(20)]
    items = [(0, " ".join(text[3].split()[20:50])), (1, "short one")]
    prints, windows = decontaminate.benchmark_tables(spark.createDataFrame(items, "item_id long, text string"))
    docs = table(spark, [*text, "a short one"]).select(F.struct("doc_id").alias("_doc"), decontaminate.words(F.col("text")).alias("_w"))
    rows, hits = decontaminate.fingerprint_hits(docs, ["doc_id"], prints, (2,), 10, 5, broadcast)
    compared = hits.selectExpr("_row", "len", "size(words) - len + 1 as n").collect()
    assert rows.count() == 21
    assert sum(x.n for x in compared if x.len == 10) in range(21, 40)  # of 20 * 191 windows
    assert sum(x.n for x in compared if x.len == 2) == 1
    assert not decontaminate.fingerprint_hits(docs, ["doc_id"], prints.limit(0), (2,), 10, 5, broadcast)[1].count()


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_items_whose_ids_hold_commas(spark, broadcast_rows):
    one, two = ("a b c d e f g h i j", "k l m n o p q r s t")
    bench = spark.createDataFrame([("a,b", one), ("a", two), ("b", two)], "item_id string, text string")
    got = decontaminate.contamination(spark, table(spark, [one, two, one + " x " + two]), bench, broadcast_rows=broadcast_rows).orderBy("doc_id").collect()
    assert [x["items"] for x in got] == [["a,b"], ["a", "b"], ["a", "a,b", "b"]]


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    some = decontaminate.contamination(spark, table(spark, ["a b", None]), bench).collect()
    assert sorted(tuple(x[c] for c in ("n_words", "n_hit", "n_items", "contaminated")) for x in some) == [(0, 0, 0, False), (2, 0, 0, False)]
    full = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(spark, table(spark, []), full).count() == 0


# ---- licenses


def base_places(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(found), sorted({label for _, label in found}), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None)


def resolved(found):
    """The detections that stay: none lies in another, and by priority each one that meets none before it."""
    places = [(f.start, f.upto, f.order) for f in found]
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and ((a[0], a[1]) != (b[0], b[1]) or b[2] < a[2])
    out = []
    for a in sorted((a for a in places if not any(inside(a, b) for b in places)), key=lambda a: (a[2], a[0])):
        if all(a[1] <= b[0] or b[1] <= a[0] for b in out):
            out.append(a)
    return sorted(out)


def test_a_suppressed_detection_suppresses_none(spark):
    table = [{"order": i, "label": e[0], "needs": [], "base": False, "regex": f"(?<= ){e}(?= )"} for i, e in enumerate(["a b c", "c d e", "e f g", "g h", "c d e f"])]
    texts = ["a b c d e f g", "c d e f g", "e f g h a b c d e", "c d e f g h"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table=table).orderBy("doc_id").collect()
    assert [[(f.start, f.order) for f in x.detections] for x in got] == [[(0, 0), (4, 2)], [(2, 2)], [(0, 2), (4, 0)], [(2, 2)]]
    assert [[(f.start, f.upto, f.order) for f in x.detections] for x in got] == [resolved(x.found) for x in got]


def test_license_scan(spark):
    parts = ["MIT License", "mit-license", "the Apache License, Version 2.0", "GNU General Public License", "gnu lesser general public license", "CC BY-SA 4.0", "cc-by", "word", "licensé", "all rights reserved", "\n", "spdx-license-identifier: mit"]
    parts += ["licensed under a creative commons attribution 4.0", "dual licensed under the ruby license", "the mit", "license agreement", "commercial license", "under", "gpl", "version 2"]
    r = random.Random(4)
    texts = EDGES + [" ".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(80)] + ["mit license " * 300]
    got = licenses.scan(table(spark, texts, "n_words string, found string, score string, _w string, _text string, _keys string, _given string")).orderBy("doc_id").collect()
    suppressed = 0
    for t, x in zip(texts, got, strict=True):
        base = [f for f in x.found if f.base]
        assert (x.n_words, len(base), sorted({f.label for f in base}), min((f.start for f in base), default=None), max((f.start for f in base), default=None)) == base_places(t)
        assert [(f.start, -f.upto, f.order) for f in x.found] == sorted((f.start, -f.upto, f.order) for f in x.found)
        assert [(f.start, f.upto, f.order) for f in x.detections] == resolved(x.found)
        outer = [f for f in x.found if not any(g is not f and g.start <= f.start and f.upto <= g.upto for g in x.found)]
        suppressed += len(outer) > len(x.detections)
        assert x._w == x._given == x.score == "old"
    assert suppressed  # also by priority alone
    assert licenses.scan(table(spark, [])).count() == 0


def test_license_places_against_plain_search(spark):
    texts = ["dual-licensed under MIT/GPL; apache 2.0 license, gplv3 or later", "the mit license the mit license mit license", "Neither the name of X nor Y may be used to endorse or promote products derived from this software"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for t, x in zip(texts, got, strict=True):
        spaced = " " + " ".join(re.findall(r"[a-z0-9]+", t.lower())) + " "
        want = {(spaced[: m.start()].count(" ") - 1, spaced[: m.end()].count(" "), rule["order"]) for rule in licenses.rules() for m in re.finditer(rule["regex"], spaced)}
        assert {(f.start, f.upto, f.order) for f in x.found} == want


def test_license_scan_of_very_many_matches(spark):
    import time

    text = "mit license or gpl license and " * 50_000
    began = time.time()
    x = licenses.scan(spark.createDataFrame([(0, text)], "doc_id long, text string")).selectExpr("n_words", "size(found) as f", "size(detections) as d").first()
    assert (x.n_words, x.d) == (300_000, 100_000)
    assert x.f >= x.d
    assert time.time() - began < 60


def test_license_rules(spark):
    say = {
        "SPDX-License-Identifier: Apache-2.0": ["apache-2.0"],
        "Licensed under the GNU General Public License version 3": ["gpl-3.0"],
        "GNU Lesser General Public License v2.1": ["lgpl-2.1"],
        "released under CC BY-NC-SA 4.0 and the zlib license": ["cc-by-nc-sa", "zlib"],
        "the mitten apache gnu license": [],
        "SPDX-License-Identifier: MIT-0": ["mit-0"],
        "this is MIT licensed work": ["mit"],
    }
    rows = spark.createDataFrame(list(enumerate(say)), "doc_id long, text string")
    got = licenses.scan(rows).orderBy("doc_id").collect()
    assert [sorted({d.label for d in x.detections}) for x in got] == list(say.values())
    assert len(licenses.rules()) > 300
    assert all(re.compile(x["regex"]) for x in licenses.rules())


def sayings(e):
    """Every text of an expression; digits and the open gap stand as one example."""

    def choices(i):
        out = []
        while True:
            got, i = sequence(i)
            out += got
            if i == len(e) or e[i] == ")":
                return out, i
            i += 1

    def sequence(i):
        out = [""]
        while i < len(e) and e[i] not in "|)":
            if e.startswith("(?:", i):
                part, i = choices(i + 3)
                i += 1
            elif e[i] == "[":
                part, i = list(e[i + 1 : e.index("]", i)]), e.index("]", i) + 1
            elif e.startswith(".{1,80}?", i):
                part, i = ["any one"], i + len(".{1,80}?")
            elif e.startswith("\\d", i):
                part, i = ["4"], i + 2
            else:
                part, i = [e[i]], i + 1
            if e[i : i + 1] == "?":
                part, i = [*part, ""], i + 1
            out = [a + b for a in out for b in part]
        return out, i

    return choices(0)[0]


def test_license_keywords_lose_nothing(spark):
    rules, texts = licenses.rules(), []
    for x in rules:
        e = x["regex"].removeprefix("(?<= )").removesuffix("(?= )")
        every = sayings(e)
        assert all(re.fullmatch(e, t) for t in every)
        assert x["needs"], e
        assert all(set(x["needs"]) <= set(t.split()) for t in every), e
        texts += [every[0], every[-1]]
    docs = spark.createDataFrame(list(enumerate([*texts, "no rule"])), "doc_id long, text string")
    with_keys = [x.found for x in licenses.scan(docs).orderBy("doc_id").collect()]
    assert with_keys == [x.found for x in licenses.scan(docs, table=[{**x, "needs": []} for x in rules]).orderBy("doc_id").collect()]
    assert all(with_keys[:-1])
    assert not with_keys[-1]


def test_license_rules_apart_from_their_family(spark):
    say = {
        "under the same terms as Perl itself": ["artistic"],
        "FreeBSD license": ["bsd-2-clause"],
        "PSF License": ["python-2.0"],
        "GPL v1.0": ["gpl-1.0"],
        "GPL1.0 only": ["gpl-1.0"],
        "LGPL3 or later": ["lgpl"],
        "AGPL3": ["agpl-3.0"],
        "The above copyright notice and this permission notice shall be included in all copies": ["mit"],
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(say)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[d.label for d in x.detections] for x in got] == list(say.values())


# ---- chat


def test_chat_round_trip(spark):
    r = random.Random(5)
    bits = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "<\\\\|", "\n", "text", "é", "|>", "assistant", "%7C", "%"]
    rows = []
    for c in range(40):
        for t in range(r.randint(1, 7)):
            text = r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(0, 12)))])
            rows.append((c if c else None, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", "odd\nrole|%", None]), text, "old"))
    rows.append((50, 0, "assistant", "long " * 50_000, "old"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_chats(df).withColumn("mask", F.expr(chat.loss_mask()))
    back = chat.read_back(done.select("conv_id", "formatted", "mask")).collect()
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(back) == len(want)
    for x in back:
        own = [(role, text) for _, role, text in sorted(want[x.conv_id])]
        assert [(t.role, t.text) for t in x.turns] == own
        assert x.loss_text == "".join(text for role, text in own if role == "assistant")
        assert x.formatted.count("<|im_start|>") == x.formatted.count("<|im_end|>") == len(own)


@pytest.mark.parametrize(("opening", "closing"), [("[INST]", "[/INST]\n"), ("<s>", "</s>"), ("#@", "!#x"), ("({", "})")])
def test_chat_with_another_template(spark, opening, closing):
    r = random.Random(6)
    bits = [opening, closing, opening[0], opening[1], closing[0], closing[1:], "\\", "\\\\", "[\\/", "%2F", "x", "\n"]
    rows = [(c, t, r.choice(["user", "assistant", "odd" + opening, "%5B"]), "".join(r.choice(bits) for _ in range(r.randint(0, 10)))) for c in range(30) for t in range(4)]
    template = chat.Template(opening=opening, closing=closing)
    done = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template).withColumn("mask", F.expr(chat.loss_mask()))
    for x in chat.read_back(done.select("conv_id", "formatted", "mask"), template).collect():
        own = [(role, text) for c, _, role, text in rows if c == x.conv_id]
        assert [(t.role, t.text) for t in x.turns] == own
        assert x.loss_text == "".join(text for role, text in own if role == "assistant")


def test_templates_that_cannot_be_kept_apart():
    for opening, closing in (("<", "</s>"), ("<s>", "s>"), ("a\\b", "</s>"), ("##", "@#")):
        with pytest.raises(ValueError, match="kept apart"):
            chat.Template(opening=opening, closing=closing)


def test_the_machine_says_what_carries_loss(spark):
    """Only answers after the first one carry loss, and so does a tool's text out of order."""
    go = chat.Move
    moves = {("start", "user"): go("asked"), ("asked", "assistant"): go("first"), ("first", "user"): go("again"), ("again", "assistant"): go("first", loss=True)}
    template = chat.Template(moves=moves, strays={"tool": go("tooled", loss=True), "": go("broken")}, ends=("first", "tooled"))
    names = {"u": "user", "a": "assistant", "t": "tool", "'": "it's"}
    say = {"uaua": ([3], True), "ua": ([], True), "au": ([], False), "uat": ([2], True), "uatt": ([2, 3], True), "u'a": ([], False), "": ([], None)}
    rows = [(i, n, names[r], "x") for i, path in enumerate(say) for n, r in enumerate(path)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template).orderBy("conv_id").collect()
    assert [([i // 3 for i, s in enumerate(x.segments) if s.loss], x.valid) for x in got] == list(say.values())[:-1]


def test_chat_of_very_many_turns(spark):
    rows = spark.range(40_000).selectExpr("0L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    done = chat.format_chats(rows).withColumn("mask", F.expr(chat.loss_mask()))
    x = done.selectExpr("size(mask) as n", "element_at(mask, -1) as last", "length(formatted) as chars", "valid").first()
    assert (x.n, x.valid) == (20_000, True)
    assert x.last.start + x.last.length + len("<|im_end|>\n") == x.chars


def test_chat_order(spark):
    say = {"sua": True, "ua": True, "uaua": True, "u": False, "au": False, "uua": False, "usa": False, "sa": False, "uax": False}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(i, t, names[r], "x") for i, path in enumerate(say) for t, r in enumerate(path)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id").collect()
    assert [x.valid for x in got] == list(say.values())
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert [(s.text, s.loss) for s in got[1].segments] == [("<|im_start|>user\n", False), ("x", False), ("<|im_end|>\n", False), ("<|im_start|>assistant\n", False), ("x", True), ("<|im_end|>\n", False)]
    assert hashlib.sha256(got[1].formatted.encode()).hexdigest()
