"""Language identification by unigram piece models, summed over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary, learned by
expectation-maximisation over all segmentations of its training words: Spark sums the
expected counts of the pieces, the driver divides them. A word's likelihood is the forward
sum over its segmentations, in logarithms; a text's is the product over its words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, by_value, held_out, map_texts, mix64, release, stash, with_fields

by_value(__name__)

#: The model is fitted on a sample of about this many labelled documents a language.
TRAIN_DOCS = 1000
#: More languages than this are refused: the model holds a number for each piece of each.
MOST_LANGUAGES = 256
EM_ROUNDS = 4
SMOOTH = 0.02
_ASCII, _LETTERS = re.compile(r"[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words whose likelihoods a task remembers, the bytes these may take, and the longest of them; others are worked out again.
_REMEMBERED, _REMEMBERED_BYTES, _REMEMBERED_LETTERS = 300_000, 32 << 20, 64
#: Letters of a stretch of words that is looked up at once.
_STRETCH = 1 << 18
_START = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _spells(piece: str) -> bool:
    return bool(piece) and all(unicodedata.category(c)[0] in "LM" for c in piece)


def vocabulary(path: str) -> list[str]:
    """Distinct lower-cased pieces of letters, some led by the word-start mark; the file is only read."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == _START or _spells(p.removeprefix(_START)))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters (general category L, with the marks on them), whole."""
    text = (text or "").lower()
    return (_ASCII if text.isascii() else _LETTERS).findall(text)


class Lattice:
    """All segmentations of words into pieces of ``vocab``; any single character is a piece, unknown ones too.

    Pieces are numbered as in ``vocab``; ``size`` stands for unknown characters.
    """

    def __init__(self, vocab: list[str]):
        self.size, self.deep = len(vocab), max(map(len, vocab), default=1)
        hashes = np.array([self._hash(p) for p in vocab], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int64)
        self.logs = self.probs = None
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes & U64((1 << 20) - 1)).astype(np.int64)] = True

    def _least(self, logs: np.ndarray) -> float:
        """The smallest of ``logs``; keeps ``probs``, their exponentials, for the next calls with the same ones."""
        if self.logs is not logs:
            self.logs, self.probs, self.least = logs, np.exp(logs), float(logs.min(initial=0.0))
        return self.least

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = mix64(h * U64(31) + U64(ord(c) + 1))
        return h[0]

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """Characters of words of one length, led by the start mark."""
        return np.frombuffer("".join(_START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)

    def stretches(self, n: int, width: int) -> list[tuple[int, int]]:
        step = max(1, _STRETCH // n)
        return [(lo, min(width, lo + step)) for lo in range(0, width, step)]

    def arcs(self, codes: np.ndarray, lo: int, hi: int) -> list[list[tuple[int, np.ndarray | None, np.ndarray]]]:
        """For each start from ``lo`` up to ``hi`` its arcs (length, rows that have one or None for all, pieces), length 1 first."""
        part = codes[:, lo : min(codes.shape[1], hi + self.deep - 1)]
        n, width = part.shape
        out: list[list] = [[] for _ in range(hi - lo)]
        h = np.zeros((n, hi - lo), np.uint64)
        for k in range(min(self.deep, width)):
            starts = min(hi - lo, width - k)
            h = mix64(h[:, :starts] * U64(31) + part[:, k : k + starts] + U64(1))
            flat = h.T.reshape(-1)  # by start, then by row
            at = np.flatnonzero(self.maybe[(flat & U64((1 << 20) - 1)).astype(np.int64)])
            pos = np.minimum(np.searchsorted(self.hashes, flat[at]), max(self.size - 1, 0))
            good = self.hashes[pos] == flat[at] if self.size else np.zeros(0, bool)
            at, ids = at[good], self.ids[pos[good]] if self.size else at[good]
            if k == 0:
                every = np.full(len(flat), self.size, np.int64)
                every[at] = ids
                for s, one in enumerate(every.reshape(-1, n)):
                    out[s].append((1, None, one))
                continue
            start, row = at // n, at % n
            cut = np.searchsorted(start, np.arange(starts + 1))
            for s in np.flatnonzero(np.diff(cut)):
                mine = slice(cut[s], cut[s + 1])
                out[s].append((k + 1, row[mine], ids[mine]))
        return out

    def _sum(self, at_one: np.ndarray, pending: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """log of the sum of what arrives: ``at_one`` over arcs of one character, ``pending`` over longer ones."""
        if not pending:
            return at_one
        total = np.ones_like(at_one)
        for rows, value in pending:
            total[rows] += np.exp(value - at_one[rows])
        return at_one + np.log(total)

    def _plain(self, codes: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """The forward sum without logarithms, for words too short to leave the range of numbers."""
        n, width = codes.shape
        now = np.ones((n, probs.shape[1]))
        coming: dict[int, list] = {}
        for i, own in enumerate(self.arcs(codes, 0, width)):
            for k, rows, ids in own[1:]:
                coming.setdefault(i + k, []).append((rows, now[rows] * probs[ids]))
            now = now * probs[own[0][2]]
            for rows, value in coming.pop(i + 1, []):
                now[rows] += value
        return now

    def forward(self, words: list[str], logs: np.ndarray, keep: bool = False) -> np.ndarray:
        """Log-likelihood[word, model] of words of one length for logs[piece, model]; of every prefix if ``keep``."""
        codes = self.codes(words)
        n, width = codes.shape
        if not keep and n * width <= _STRETCH and self._least(logs) * width > -600:
            return np.log(self._plain(codes, self.probs))
        now = np.zeros((n, logs.shape[1]))
        every = [now]
        coming: dict[int, list] = {}
        for lo, hi in self.stretches(n, width):
            for i, own in enumerate(self.arcs(codes, lo, hi), lo):
                for k, rows, ids in own[1:]:
                    coming.setdefault(i + k, []).append((rows, now[rows] + logs[ids]))
                now = self._sum(now + logs[own[0][2]], coming.pop(i + 1, []))
                if keep:
                    every.append(now)
        return np.stack(every, 1) if keep else now

    def expected(self, words: list[str], logs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of each piece over all segmentations of words of one length, for one model."""
        codes = self.codes(words)
        n, width = codes.shape
        ahead = self.forward(words, logs[:, None], keep=True)[:, :, 0]
        behind = np.zeros((n, width + 1))
        out = np.zeros(self.size + 1)
        whole = ahead[:, width]
        for lo, hi in reversed(self.stretches(n, width)):
            for i, own in reversed(list(enumerate(self.arcs(codes, lo, hi), lo))):
                arrive = [(rows, logs[ids] + behind[rows, i + k]) for k, rows, ids in own[1:]]
                behind[:, i] = self._sum(logs[own[0][2]] + behind[:, i + 1], arrive)
                for k, rows, ids in own:
                    r = slice(None) if rows is None else rows
                    np.add.at(out, ids, weight[r] * np.exp(ahead[r, i] + logs[ids] + behind[r, i + k] - whole[r]))
        return out


def by_length(words: list[str], most: int = 20_000) -> Iterator[list[int]]:
    """Positions of words of one length, at most ``most`` at once and fewer of long ones."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, where in groups.items():
        step = max(1, min(most, _STRETCH // (length + 1)))
        for lo in range(0, len(where), step):
            yield where[lo : lo + step]


class Scorer:
    """Log-likelihoods of texts under every language."""

    def __init__(self, vocab: list[str], langs: list[str], logs: np.ndarray, prior: np.ndarray):
        self.lattice, self.langs, self.logs, self.prior = Lattice(vocab), langs, logs, prior
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def _rows(self, words: list[str]) -> np.ndarray:
        rows = np.zeros((len(words), len(self.langs)))
        for where in by_length(words):
            rows[where] = self.lattice.forward([words[i] for i in where], self.logs)
        return rows

    def _learn(self, words: list[str]) -> None:
        self.known.update(zip(words, range(len(self.table), len(self.table) + len(words)), strict=True))
        self.table = np.concatenate([self.table, self._rows(words)])

    def likelihood(self, words: list[str]) -> np.ndarray:
        """Of all words together, for each language; they must be known but for long ones."""
        long_ = [w for w in words if len(w) > _REMEMBERED_LETTERS]
        at = np.fromiter((self.known[w] for w in words if len(w) <= _REMEMBERED_LETTERS), np.int64, len(words) - len(long_))
        return self.table[at].sum(0) + (self._rows(long_).sum(0) if long_ else 0.0)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for lo in range(0, len(texts), 400):
            own = [words_of(t) for t in texts[lo : lo + 400]]
            every = {w for w in set().union(*own) if len(w) <= _REMEMBERED_LETTERS}
            new = every.difference(self.known)
            if len(self.known) + len(new) > min(_REMEMBERED, _REMEMBERED_BYTES // (8 * max(1, len(self.langs)))):
                self.known, self.table, new = {}, self.table[:0], every
            if new and self.langs:
                self._learn(sorted(new))
            for words in own:
                if not words or not self.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = self.prior + self.likelihood(words)
                top = int(np.argmax(total))
                langs.append(self.langs[top])
                scores.append(float(1 / np.exp(total - total[top]).sum()))
        return langs, scores


def count_words(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text)."""

    def count(batches):
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in words_of(text):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"]
            )

    return labelled.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, vocab: list[str], langs: list[str], rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log-probabilities[piece, language] from (lang, word, n); the last row is unknown characters.

    In every round the tasks sum the expected counts of their words; what reaches the
    driver is a number for each piece and language.
    """
    size, number = len(vocab), {lang: i for i, lang in enumerate(langs)}
    logs = np.full((size + 1, len(langs)), -np.log(size + 1))
    spark = words.sparkSession
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((vocab, logs))

        def expect(batches, held=held):
            lattice, now = None, held.value[1]
            soft: dict[str, np.ndarray] = {}
            for batch in batches:
                lattice = lattice or Lattice(held.value[0])
                lang, word, n = (batch.column(i).to_pylist() for i in range(3))
                for name in set(lang):
                    mine = [i for i, x in enumerate(lang) if x == name]
                    own, weight = [word[i] for i in mine], np.array([n[i] for i in mine], float)
                    total = soft.setdefault(name, np.zeros(size + 1))
                    for where in by_length(own):
                        total += lattice.expected([own[i] for i in where], np.ascontiguousarray(now[:, number[name]]), weight[where])
            for name, total in soft.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "piece", "soft"])

        sums = words.mapInArrow(expect, "lang string, piece int, soft double").groupBy("lang", "piece").agg(F.sum("soft").alias("soft"))
        soft = np.full((size + 1, len(langs)), SMOOTH)
        for batch in sums.toArrow().to_batches():  # at most pieces times languages
            lang, piece, value = (batch.column(i) for i in range(3))
            np.add.at(soft, (np.asarray(piece), np.array([number[x] for x in lang.to_pylist()], np.int64)), np.asarray(value))
        logs = np.log(soft / soft.sum(0))
        held.destroy()
    return logs


def train(labelled: DataFrame, vocab: list[str], text_col: str, lang_col: str, id_col: str, train_docs: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Fit on a sample of ``labelled`` drawn by a hash of the id, about ``train_docs`` rows a language."""
    sizes = dict(labelled.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect())
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return [], np.zeros((len(vocab) + 1, 0)), np.zeros(0)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, train_docs / n))]), F.col(lang_col))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    words = stash(count_words(sample).repartition(2 * labelled.sparkSession.sparkContext.defaultParallelism), "words")
    langs = sorted(sizes)
    logs = fit(words, vocab, langs)
    release(words)
    return langs, logs, np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))


def identify(
    spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", path: str | None = None, train_docs: int = TRAIN_DOCS
) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``.

    Learns from rows with a language whose crc32(id) mod 4 is not 2 and predicts from the
    text alone. ``lang_pred`` is ``und`` with score 0 for texts that are null or without a
    letter, and for all if nothing is labelled. ``score`` is the posterior of the language
    named; of equal ones the first by name wins. Words of any length are summed whole. A
    null id is never held out. Input columns named like an output give way, others pass
    unchanged; repeated rows stay, and an empty table gives an empty one. More than ``MOST_LANGUAGES`` languages are an error.
    """
    vocab = vocabulary(path or default_vocabulary())
    out = held_out(F.col(id_col))
    labelled = docs.where(~out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    model = train(labelled, vocab, text_col, lang_col, id_col, train_docs)
    held = spark.sparkContext.broadcast((vocab, *model))  # bounded by vocabulary and languages
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def make():
        scorer = Scorer(*held.value)

        def step(texts, batch):
            names, scores = scorer(texts)
            return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

        return step

    marked = docs.drop("held_out", "lang_pred", "score").withColumn("held_out", out)
    return map_texts(marked, text_col, with_fields(marked.schema, new), make)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(spark, docs).select("doc_id", "held_out", "lang_pred", "score")
