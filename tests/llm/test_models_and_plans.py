"""Packing, language ID, quality, HTML, top-k: round trips, held-out accuracy, brute force, edge cases."""

import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.llm import html_text, lang_id, packing, quality, top_k

DATA = "/root/testdata/sf0.01"
EDGES = [None, "", " ", "\n", "12 34", "é", "a  b \n c", "word " * 30_000, "x" * 20_000, "<|endoftext|>", "a<|endoftext|>b"]


# ---- packing


def fewest(sizes, capacity):
    """The least number of sequences, by trying every assignment."""
    for n in range(1, len(sizes) + 1):
        for where in product(range(n), repeat=len(sizes)):
            load = [0] * n
            for s, w in zip(sizes, where, strict=True):
                load[w] += s
            if max(load) <= capacity:
                return n
    return 0


def used(plan, capacity, counts):
    got = np.zeros_like(counts)
    for use, copies in plan:
        assert copies > 0
        assert sum(x * m for x, m in use.items()) <= capacity
        for x, m in use.items():
            got[x] += m * copies
    assert (got == counts).all()
    return sum(copies for _, copies in plan)


def test_small_plans_are_optimal():
    r = random.Random(1)
    for _ in range(40):
        capacity = r.randint(4, 20)
        sizes = [r.randint(1, capacity) for _ in range(r.randint(1, 6))]
        counts = np.bincount(sizes, minlength=capacity + 1)
        plan = packing.bin_completion(counts, capacity)
        assert used(plan, capacity, counts) == fewest(sizes, capacity) >= packing.lower_bound(counts, capacity)


def test_large_plans_keep_every_piece():
    r = np.random.default_rng(2)
    for capacity, n in ((2048, 20_000), (97, 500), (10, 3)):
        counts = np.bincount(np.minimum(r.geometric(5 / capacity, n), capacity), minlength=capacity + 1)
        found = used(packing.bin_completion(counts, capacity), capacity, counts)
        assert packing.lower_bound(counts, capacity) <= found <= 1.01 * packing.lower_bound(counts, capacity) + 1
    assert packing.bin_completion(np.zeros(11, int), 10) == []


def test_plan_by_fillings_of_many_pieces():
    counts = np.bincount([900, 600, 500, 474, 474, 287, 287, 287, 287], minlength=2049)
    assert used(packing.best_fit_decreasing(counts, 2048), 2048, counts) == 3
    assert used(packing.bin_completion(counts, 2048), 2048, counts) == 2


def test_plans_without_waste_are_found():
    r, harder = random.Random(3), 0
    for _ in range(60):
        capacity, sizes = 60, []
        for _ in range(4):
            cuts = sorted(r.sample(range(5, capacity - 4), r.randint(2, 4)))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, capacity], strict=True)]
        counts = np.bincount(sizes, minlength=capacity + 1)
        harder += used(packing.best_fit_decreasing(counts, capacity), capacity, counts) > 4
        assert used(packing.bin_completion(counts, capacity, nodes=10**6), capacity, counts) == 4
    assert harder > 10


def test_fillings_against_brute_force():
    r = random.Random(4)
    for _ in range(80):
        room = r.randint(3, 24)
        counts = np.array([0] + [r.choice([0, 0, 1, 2]) for _ in range(room)])
        lengths = [int(x) for x in np.flatnonzero(counts)][::-1]
        every = [f for f in product(*(range(counts[x] + 1) for x in lengths)) if sum(map(int.__mul__, f, lengths)) <= room]
        want = []
        for f in every:
            waste = room - sum(map(int.__mul__, f, lengths))
            parts = [(sum(map(int.__mul__, p, lengths)), sum(p)) for p in product(*(range(m + 1) for m in f))]
            if not any(s <= x <= s + waste and (n != 1 or s < x) for x, m in zip(lengths, f, strict=True) if m < counts[x] for s, n in parts):
                want.append((waste, [-m for m in f], tuple((x, m) for x, m in zip(lengths, f, strict=True) if m)))
        want = [(w, f) for w, _, f in sorted(want)]
        got = [f for f in packing.fillings(counts, room) if f]
        assert got == want
        for i, f in enumerate(got):
            assert [g for g in packing.fillings(counts, room, f) if g] == want[i + 1 :]
        assert [g for g in packing.fillings(counts, room, None, 1) if g] == [f for f in want if f[0] <= 1]


def pieces(texts, capacity):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    out = []
    for i, t in texts:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        out += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(out, key=repr)


def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    ids, model, r = packing.TokenIds(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer()), random.Random(1)
    assert np.frombuffer(ids.of("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]
    bits = ["<|endoftext|>", "<|", "|>", " ", "\n", "a", "é", "漢", "\u0301", "<|endoftext|", "endoftext|>", "1", "'s", "\t", "😀", "\u00a0", "\u2028"]
    for _ in range(3000):
        text = "".join(r.choice(bits) if r.random() < 0.7 else chr(r.choice([r.randint(32, 0x2FFF), r.randint(0x10000, 0x1FFFF)])) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(ids.of(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("capacity", "group"), [(2048, packing.RANK_GROUP), (64, 50)])
def test_packing(spark, monkeypatch, capacity, group):
    monkeypatch.setattr(packing, "RANK_GROUP", group)
    real = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(120).collect()]
    rows = list(enumerate([*EDGES, *real])) + [(3, "again"), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 5, "old") for r in rows], "doc_id long, text string, offset long, piece string")
    got = packing.pack(spark, docs, capacity=capacity).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == pieces(rows, capacity)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        assert ends[r.sequence_id] <= capacity
    assert len(ends) <= 1.02 * -(-sum(ends.values()) // capacity) + 1
    assert packing.pack(spark, docs.limit(0)).count() == 0


# ---- language ID


def segmentations(word, table, unknown):
    """Each segmentation of a word as a list of pieces; None stands for an unknown character."""
    if not word:
        return [[]]
    out = []
    for k in range(1, len(word) + 1):
        if word[:k] in table or k == 1:
            out += [[word[:k] if word[:k] in table else None, *rest] for rest in segmentations(word[k:], table, unknown)]
    return out


VOCAB = ["a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb", "abbabba"]


def test_forward_sums_all_segmentations(monkeypatch):
    lattice = lang_id.Lattice(VOCAB)
    probs = np.random.default_rng(1).dirichlet(np.ones(len(VOCAB) + 1))
    logs, table = np.log(probs), dict(zip([*VOCAB, None], probs, strict=True))
    for stretch in (lang_id._STRETCH, 2):
        monkeypatch.setattr(lang_id, "_STRETCH", stretch)
        soft = np.zeros(len(probs))
        for n, word in enumerate(("abab", "bbaa", "xaby", "a", "abbabba"), 1):
            each = [(s, np.prod([table[p] for p in s])) for s in segmentations("▁" + word, set(VOCAB), None)]
            total = sum(p for _, p in each)
            assert np.isclose(lattice.forward([word], logs[:, None])[0, 0], np.log(total))
            for s, p in each:
                for piece in s:
                    soft[[*VOCAB, None].index(piece)] += n * p / total
        got = lattice.expected(["abab", "bbaa", "xaby"], logs, np.array([1.0, 2, 3])) + lattice.expected(["a"], logs, np.array([4.0])) + lattice.expected(["abbabba"], logs, np.array([5.0]))
        assert np.allclose(got, soft)


@pytest.mark.parametrize("letters", [40, 10_000])
def test_long_words_are_summed_whole(letters):
    r = random.Random(2)
    word = "".join(r.choice("abx漢") for _ in range(letters))
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(len(VOCAB) + 1), 2).T)
    for model in range(2):
        table, text, best = dict(zip(VOCAB, logs[:, model], strict=False)), "▁" + word, [0.0]
        for j in range(1, len(text) + 1):
            into = [best[j - k] + table.get(text[j - k : j], logs[-1, model] if k == 1 else -np.inf) for k in range(1, min(j, 7) + 1)]
            best.append(float(np.logaddexp.reduce(into)))
        assert np.isclose(lang_id.Lattice(VOCAB).forward([word], logs)[0, model], best[-1], rtol=1e-9)
        scorer = lang_id.Scorer(VOCAB, ["x", "y"], logs, np.zeros(2))
        assert scorer._rows([word, "ab"]).shape == (2, 2)
        assert np.isclose(scorer.likelihood([word])[model] if letters > 64 else best[-1], best[-1])


def test_fit_equals_plain_em(spark):
    words = {"x": {"abab": 3, "bbaa": 1, "xaby": 2}, "y": {"bb": 5, "é": 1}}
    rows = spark.createDataFrame([(lang, w, n) for lang, own in words.items() for w, n in own.items()], "lang string, word string, n long").repartition(3)
    got = lang_id.fit(rows, VOCAB, ["x", "y"], rounds=3)
    for i, lang in enumerate(words):
        table = dict.fromkeys([*VOCAB, None], 1 / (len(VOCAB) + 1))
        for _ in range(3):
            soft = dict.fromkeys(table, lang_id.SMOOTH)
            for w, n in words[lang].items():
                each = [(s, np.prod([table[p] for p in s])) for s in segmentations("▁" + w, set(VOCAB), None)]
                for s, p in each:
                    for piece in s:
                        soft[piece] += n * p / sum(q for _, q in each)
            table = {k: v / sum(soft.values()) for k, v in soft.items()}
        assert np.allclose(np.exp(got[:, i]), [table[p] for p in [*VOCAB, None]])


def test_vocabulary_is_whole():
    vocab = lang_id.vocabulary(lang_id.default_vocabulary())
    assert max(map(len, vocab)) > 12
    assert len(vocab) > 23_900
    assert lang_id.words_of("² ½ ① 12 _") == []
    assert lang_id.words_of("a² हिन्दी Ünï x_y") == ["a", "हिन्दी", "ünï", "x", "y"]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = lang_id.identify(spark, docs.withColumn("score", F.lit("old"))).select("doc_id", "held_out", "lang", "lang_pred", "score").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count()
    assert 0.15 < len(held) / len(got) < 0.35
    assert (held.lang == held.lang_pred).mean() > 0.99
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate([*EDGES, "²½①", "漢字" * 5000] * 2)]
    rows += [(100 + i, t, lang) for i in range(30) for t, lang in (("the thing and that", "en"), ("der und schein mit", "de"))] + [(None, "the and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang_id.identify(spark, docs).collect()
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert all((r.lang_pred == "und") == (not letters(r.text)) and (r.score == 0) == (r.lang_pred == "und") for r in got)
    assert {r.lang_pred for r in got if r.text == "the thing and that"} == {"en"}
    assert {r.lang_pred for r in lang_id.identify(spark, docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang_id.identify(spark, docs.limit(0)).count() == 0


def test_tied_languages_and_clashing_columns(spark):
    """Two languages learned from the same texts: the first by name wins everywhere."""
    rows = [(i + 100 * k, "one and the same text", lang, "old", "old", "old") for i in range(40) for k, lang in enumerate(("zz", "aa"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out string, lang_pred string")
    even = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    n = {r.lang: r["count"] for r in even.groupBy("lang").count().collect()}
    drop = abs(n["zz"] - n["aa"])
    more = max(n, key=n.get)
    spare = [r.doc_id for r in even.where(F.col("lang") == more).limit(drop).collect()]
    got = lang_id.identify(spark, docs.where(~F.col("doc_id").isin(spare)) if spare else docs)
    assert {r.lang_pred for r in got.collect()} == {"aa"}
    assert dict(got.dtypes)["score"] == "double" and dict(got.dtypes)["held_out"] == "boolean"


# ---- quality


def test_isotonic():
    r = np.random.default_rng(3)
    n, k = r.integers(1, 9, 40).astype(float), None
    k = np.array([r.integers(0, x + 1) for x in n], float)
    got = quality.isotonic(n, k)
    assert (np.diff(got) >= -1e-12).all()
    # the pooled fit is the best non-decreasing one: max-min formula
    want = [max(min(k[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(got, want)


def test_normal_equations(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(90, len(quality.STATISTICS)))
    rows = [(int(i % 3), float(i % 2), x[i].tolist()) for i in range(90)]
    rff = quality.Fourier(x.mean(0), x.std(0), 20, 4.0, 1)
    grams, rights, sizes = quality.normal_equations(spark.createDataFrame(rows, "fold int, y double, _x array<double>").repartition(5), rff)
    for f in range(3):
        z = rff(x[f::3])
        assert np.allclose(grams[f], z.T @ z)
        assert np.allclose(rights[f], z.T @ np.array([row[1] for row in rows[f::3]]))
        assert np.isclose(sizes[f], 30)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.score_quality(spark, docs, labels).toPandas()
    assert len(got) == docs.count()
    assert got.score.between(0, 1).all()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean() > 0.95
    assert (both.predicted == both.quality).mean() > 0.93


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(EDGES)] + [(None, "text", "old"), (1, "again", "old")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None), (None, 1), (3, 1)], "doc_id long, quality int")
    got = quality.score_quality(spark, docs, labels).collect()
    assert len(got) == len(EDGES) + 2
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_quality(spark, docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(spark, docs.limit(0), labels).count() == 0


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu, one</a></li></ul></nav><!-- <p>not, this.</p> --><div class="ad">Buy this, now. It is good!</div>
%s
<div id="comments"><p>I like it, really. Very much!</p></div><form><p>Your name, please.</p></form>
<aside><p>More, to read.</p></aside><footer>&copy; someone, 2020.</footer></body></html>"""


@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main><div class='post'>%s</div></main>", "<div id='content'>%s</div>", "<div class='layout has-sidebar'>%s</div>", "<form class='page'><div>%s</div></form>"])
def test_article(shell):
    inner = "<h1>A &amp; B</h1><p><b>First,\n  sentence. &#233;<br><p>Second <a href='x'>one</a>, with more.</p>Tail, text here.<p>x &lt; y, and much more of it.</p>"
    got = html_text.main_text(PAGE % (shell % inner))
    assert got == "A & B\n\nFirst, sentence. é\n\nSecond one, with more.\n\nTail, text here.\n\nx < y, and much more of it."
    bare = html_text.main_text(PAGE % inner.replace("Tail, text here.", ""))
    assert bare == got.replace("Tail, text here.\n\n", "")


def test_markup_that_misleads():
    """Raw elements end at their own end tag only, a quote inside an unquoted value is no quote, wrappers speak for nothing."""
    for page, want in {
        "<script>for(i=0;i<n;i++){x()}</script><p>hello, there.": "hello, there.",
        "<script>s=\"<!--\";</script><p>hello, there.": "hello, there.",
        "<style>a:after{content:'<p>'}</style ><p>hello, there.": "hello, there.",
        "<p title=don't>hello, there.</p>": "hello, there.",
        "<p title='a>b'>hello, there.</p>": "hello, there.",
        "<div class='layout has-sidebar'><p>hello, there.</p></div>": "hello, there.",
        "<div class='sidebar'><p>hello, there.</p></div>": "hello, there.",
        "<div class='entry no-comments'><p>hello, there.</p></div>": "hello, there.",
        "<article><header><h1>Title</h1></header><p>hello, there. More of it.</p></article>": "Title\n\nhello, there. More of it.",
        "<head><title>no</title><p>hello, &<b>amp;</b> there.": "hello, &amp; there.",
        "<!--><p>hello, there.": "hello, there.",
        "<svg><text>no, no.</text></svg><p hidden>no, no.</p><p>hello, there.": "hello, there.",
    }.items():
        assert html_text.main_text(page) == want, page


def scores_in_full(paths, window):
    """The scores of path_scores from (tag path, text, linked) triples without doubts, pair by pair."""
    from math import log, sqrt

    order = list(dict.fromkeys(p for p, _, _ in paths))
    ratio, prose = {}, {}
    for p in order:
        own = [(t, n) for q, t, n in paths if q == p]
        c, marks = sum(len(t) - n for t, n in own), sum(t.count(".") + t.count(",") for t, _ in own)
        prose[p] = sum(n for _, n in own) <= c
        ratio[p] = c / len(own) * (1 + log(1 + marks / len(own))) * sqrt(c) if prose[p] else 0.0

    def kin(a, b):
        found = [max(len(a), len(b)) - k for k in range(1, max(len(a), len(b))) if a[:k] == b[:k] and len(a) >= k and len(b) >= k and min(len(a), len(b)) == k + 1]
        return 1 / found[0] if found and found[0] <= html_text.REACH and {a[-1], b[-1]} <= html_text._PROSE else 0.0

    out = []
    for i, p in enumerate(order):
        near = [(kin(p, q), ratio[q]) for q in order[max(0, i - window) : i + window + 1] if q != p] if prose[p] else []
        out.append(max(ratio[p], (ratio[p] + sum(k * x for k, x in near)) / (1 + sum(k for k, _ in near))))
    heavy = max(order, key=lambda p: prose[p] * sum(len(t) - n for q, t, n in paths if q == p))
    shared = {p: (ratio[p] + ratio[heavy]) / 2 if prose[p] else 0.0 for p in order}
    return dict(zip(order, out, strict=True)), shared, heavy


def nested(r, depth, paths, at=("", "body")):
    """A random well-formed page as html; its blocks go to ``paths``."""
    out = ""
    for _ in range(r.randint(1, 4)):
        if depth and r.random() < 0.5:
            tag = r.choice(["div", "section", "ul"])
            out += f"<{tag}>{nested(r, depth - 1, paths, (*at, tag))}</{tag}>"
        else:
            tag = r.choice(["p", "h2", "blockquote", "div"])
            text = " ".join(r.choice(["one", "two,", "three."]) for _ in range(r.randint(1, 30))).strip()
            link = text if r.random() < 0.3 else ""
            body = f"<a href='x'>{text}</a>" if link else text
            paths.append(((*at, tag), text, len(link)))
            out += f"<{tag}>{body}</{tag}>"
    return out


def test_path_scores_against_brute_force():
    r = random.Random(6)
    for _ in range(60):
        paths = []
        page = f"<body>{nested(r, 3, paths)}</body>"
        read = html_text.Page(page)
        assert [t for _, _, t in read.blocks] == [t for _, t, _ in paths]
        got, each = html_text.path_scores(read)
        want, shared, heavy = scores_in_full(paths, html_text.WINDOW)
        assert np.allclose(list(got.values()), list(want.values()))
        # The container is the innermost element that is no section around the heaviest path; here elements are told apart by where they open.
        tree, marks = re.split(r"(<[^>]*>)", page), []
        stack, number = [], 0
        for piece in tree:
            if piece.startswith("</"):
                stack.pop() if piece != "</a>" else None
            elif piece.startswith("<"):
                number += 1
                stack += [(piece[1:-1], number)] if not piece.startswith("<a ") else []
            elif piece:
                marks.append(list(stack))
        around = [heavy[:k] for k in range(len(heavy) - 1, 2, -1)]
        home = next((a for a in around if a[-1] != "section"), around[-1] if around else None)
        holder = [m[len(home) - 2][1] if home and p[: len(home)] == home else None for (p, _, _), m in zip(paths, marks, strict=True)]
        weight = {}
        for (p, t, n), h in zip(paths, holder, strict=True):
            if p == heavy and h:
                weight[h] = weight.get(h, 0) + len(t) - n
        most = max(weight, key=lambda h: (weight[h], -h)) if weight else 0
        score = [max(want[p], shared[p]) if h == most else want[p] for (p, _, _), h in zip(paths, holder, strict=True)]
        assert np.allclose(each, score)
        assert html_text.main_text(page) == "\n\n".join(t for (p, t, _), x in zip(paths, score, strict=True) if x >= html_text.SHARE * max(score) * (1 - 1e-12) and x > 0)


def made_page(r):
    """A page without an article element, and its main text."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    title, body = sentence(6), [" ".join(sentence(r.randint(6, 14)) for _ in range(r.randint(2, 5))) for _ in range(r.randint(3, 8))]
    items = [sentence(5) for _ in range(r.choice([0, 4]))]
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body) + ("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if items else "")
    for _ in range(r.randint(0, 3)):
        inner = f"<div class='{r.choice(['wrap', 'has-sidebar', 'row no-ads', 'content'])}'>{inner}</div>"
    links = "".join(f"<li><a href='/x'>{word()}, {word()}.</a></li>" for _ in range(6))
    beside = [f"<nav><ul>{links}</ul></nav>", f"<div><div>{sentence(4)}</div></div>", f"<div class='sidebar'><p>{sentence(9)}</p></div>"]
    below = [f"<div id='comments'>{''.join(f'<p>{sentence(8)}</p>' for _ in range(3))}</div>", f"<footer><p>&copy; {sentence(4)}</p></footer>"]
    return f"<html><head><title>t</title></head><body>{''.join(beside)}<div>{inner}</div>{''.join(below)}</body></html>", "\n\n".join([title, *body, *items])


def test_made_pages_and_what_the_threshold_does():
    r = random.Random(7)
    pages = [made_page(r) for _ in range(200)]
    assert all(html_text.main_text(p) == want for p, want in pages)
    assert sum(html_text.main_text(p, doubt=1.0) == want for p, want in pages) > 150  # the ratios alone
    assert not any(html_text.main_text(p, share=0.0) == want for p, want in pages)
    assert not any(html_text.main_text(p, share=0.0, doubt=1.0) == want for p, want in pages)


_P = "A sentence of the text, which is long enough to weigh something. And here is one more of them, so that it has punctuation, too."


def test_nothing_of_the_article_is_lost():
    table_ = "<table><thead><tr><th>Year</th></tr></thead><tbody><tr><td>1990</td><td>12</td></tr></tbody></table>"
    for page, want in {
        f"<article><h1>Title</h1><div>{_P}</div><div>{_P}</div></article>": ["Title", _P, _P],
        f"<body><div id=x><h1>Title</h1><div>{_P}</div><div>{_P}</div></div></body>": ["Title", _P, _P],
        f"<article><p>{_P}</p><p>{_P}</p>{table_}</article>": [_P, _P, "Year", "1990", "12"],
        f"<article><p>{_P}</p><div><div><ul><li>One</li><li>Two</li></ul></div></div></article>": [_P, "One", "Two"],
        f"<main><section><h2>Intro</h2><p>{_P}</p><p>{_P}</p></section><section class=end><h2>End</h2><p>Short end.</p></section></main>": ["Intro", _P, _P, "End", "Short end."],
        f"<article><p>{_P} <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> ends.</p></article>": [f"{_P} x=1 ends."],
        f"<article><p>{_P}</p><noscript><p>An image of it.</p></noscript></article>": [_P, "An image of it."],
        f"<noscript>Please turn on scripts.</noscript><article><p>{_P}</p></article>": [_P],
        f"<article><p>{_P}</p><aside class=pull-quote><p>It has punctuation.</p></aside><aside><p>Read more, elsewhere.</p></aside></article>": [_P, "It has punctuation."],
        f"<div class='news-related'><article><p>{_P}</p></article></div><div class=footer><p>{_P}</p><p>{_P}</p></div>": [_P],
        f"<div class='related'><article><p>Short, one.</p></article><article><p>Short, two.</p></article></div><div class=text><p>{_P}</p></div>": [_P],
        f"<article><p>{_P}</p><nav><p>Menu, of it.</p></nav><div class=comments><p>{_P}</p></div></article>": [_P],
        f"<article><p>{_P}<br>Next line.</p></article>": [_P, "Next line."],
    }.items():
        assert html_text.main_text(page) == "\n\n".join(want), page


def test_repeated_pages_and_ties(spark):
    page = f"<div><p>{_P}</p></div><section><p>{_P}</p></section>"
    got = html_text.extract(spark.createDataFrame([(1, page)] * 3, "page_id long, html string")).collect()
    assert {r.text for r in got} == {f"{_P}\n\n{_P}"} and len(got) == 3


def test_html_edges(spark):
    odd = [None, "", "<", "<p", "plain, text.", "<div>" * 5000 + "deep, text.", "<p>a<script>never ends", "<!-- open", "</p></div>", "<p>" + "word, " * 50_000, "<a href='x'>only</a>"]
    pages = spark.createDataFrame([(i, "u", t, "old") for i, t in enumerate(odd)], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got]
    assert [r.text for r in got[:6]] == ["", "", "<", "", "plain, text.", "deep, text."]
    assert got[9].text == ("word, " * 50_000).strip()
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pages_against_their_template(spark):
    import html
    import re

    alone = []
    for r in html_text.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert r.text == want
        alone.append(html_text.main_text(r.html, doubt=1.0) == want)
        assert html_text.main_text(r.html, share=0.0) != want
    assert sum(alone) > 0.85 * len(alone)  # without a word about tags or classes


# ---- top-k


def nearest(rows, k, wanted):
    use = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(use):
        if wanted(i):
            best = sorted(((-int(q @ c), j) for m, (j, c) in enumerate(use) if m != n and len(c) == len(q)))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("queries", "candidates", "drawn"), [(4096, 16_384, 1024), (3, 40, 60), (7, 50, 0)])
def test_top_k(spark, monkeypatch, queries, candidates, drawn):
    monkeypatch.setattr(top_k, "DRAWN", drawn)
    monkeypatch.setattr(top_k, "LONGEST", drawn // 10)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", queries)
    monkeypatch.setattr(top_k, "CANDIDATE_BLOCK", candidates)
    r = np.random.default_rng(5)
    base = r.normal(size=(8, 24))
    rows = [(i, [float(np.float32(x)) for x in (base[r.integers(8)] + r.choice([0, 0.2]) * r.normal(size=24))]) for i in range(300)]
    rows += [(300, None), (310, [None] * 24), (320, [float("nan")] * 24), (330, [1.0, 2.0]), (340, [3.0, 1.0]), (350, []), (None, rows[0][1]), (7, rows[7][1]), (10, rows[10][1]), (10, rows[11][1])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int")
    got = top_k.top_k(spark, df, F.col("vec_id") % 10 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == nearest(rows, 5, lambda i: i % 10 == 0)
    assert top_k.top_k(spark, df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline
    from gatewise.llm.common import stash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "123 456", "en", "s", 7)], docs.schema)
    now = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stash(stage(spark, now, "/root/testdata/sf0.001"), "test")
        assert now.columns == docs.columns, name
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        gone = {r.doc_id for r in before.select("doc_id").collect()} - ids
        assert len(ids) == now.count()
        if name == "language ID":
            assert gone == {10_000, 10_001}
        if name == "line dedup":
            assert not gone
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001")
    assert {r.doc_id for r in packed.collect()} == ids
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_pipeline_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    same, other = "one two three four five six seven eight", "quite another text of more than five words"
    rows = [(7, same), (7, same), (3, same), (None, same), (None, other), (None, other), (5, other), (5, other), (5, "a third text under the id of another"), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_filter(spark, docs.repartition(3), "").collect()]
    assert sorted(got, key=repr) == sorted([(3, same), (5, other), (5, "a third text under the id of another"), (9, None), (9, "")], key=repr)


def test_pipeline_stages_on_odd_tables(spark):
    """Empty tables, repeated rows, null columns, and columns named like those of the operators."""
    import corpus_pipeline

    line, text = "a line that many documents share", "some words of a text that is long enough to be a document of its own "
    rows = [(i, f"{text}{i} {i * 7} {i * 13}\n{line}") for i in range(12)] + [(3, f"{text}3 21 39\n{line}")] * 2 + [(None, None), (50, ""), (51, "12 34"), (None, "only this")]
    odd = ["score", "held_out", "lang_pred", "n_lines", "n_dropped", "n_words", "items", "n_hit", "row", "_row", "_w", "group", "n", "cid"]
    docs = spark.createDataFrame([(i, t, "en" if i else None, "s", 0, *(f"{c}!" for c in odd)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in odd))
    where, now = "/root/testdata/sf0.001", docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, where)
        assert now.columns == docs.columns, name
        got = now.collect()
        assert all(r[c] == f"{c}!" for r in got for c in odd), name
        if name == "language ID":
            assert len(got) == 15
        if name == "line dedup":
            assert len(got) == 15
            assert not any(line in r.text for r in got)
            assert all(r.n_chars == len(r.text) for r in got)
        if name == "MinHash near-dedup":
            assert sorted((r.doc_id for r in got), key=str) == [*sorted(range(12), key=str), None]
        assert stage(spark, docs.limit(0), where).count() == 0
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, where).collect()} == {*range(12), None}
