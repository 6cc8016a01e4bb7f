"""Language ID by unigram pieces, marginalised over segmentations.

The pieces are those of a fixed public vocabulary. Each language has a
probability per piece; the probability of a word is the sum over all ways to
cut it into pieces, by a forward pass over its letters. Expectation
maximisation over the words of a bounded sample sets the probabilities. A
text's score is the posterior of its best language.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import documents
from noticeflow.llm.quality import crc_of
from noticeflow.runtime import map_arrow, release, staged

UNKNOWN = "und"
PER_LANGUAGE, STEPS, CACHE = 1_500, 3, 300_000
LONG = 48  # letters; longer words are learned in parts of so many and scored whole, in scaled form
VERY_LONG = 1000  # letters; longer words are scored one by one
GRAIN = 1 << 20  # parts of a count
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = regex.compile(r"\p{L}+").findall
SCALE = 24.0  # keeps products of piece probabilities near 1


class Pieces:
    """The vocabulary's pieces by a hash of their letters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        names = sorted(p for p in names if p.lower() == p and _LETTERS(p.lstrip("▁")) in ([p.lstrip("▁")], []))
        self.longest = max(map(len, names))
        self.names = names
        hashes = np.array([self.hashes(np.array([[ord(c) for c in p]], np.uint64))[0, -1] for p in names], np.uint64)
        order = np.argsort(hashes)
        self.sorted, self.ids = hashes[order], order.astype(np.int32)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.slot(hashes)] = True
        self.powers = np.cumprod(np.full(self.longest + 1, _MUL, np.uint64), dtype=np.uint64) // np.uint64(1)
        self.powers = np.concatenate([np.ones(1, np.uint64), self.powers])

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(42)).astype(np.int64)

    @staticmethod
    def hashes(codes: np.ndarray) -> np.ndarray:
        """Hash of each prefix of each row, the empty one first."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _MUL + codes[:, i] + np.uint64(1)
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        out = np.full(h.shape, -1, np.int32)
        maybe = np.nonzero(self.seen[self.slot(h)])[0]
        at = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        out[maybe] = np.where(self.sorted[at] == h[maybe], self.ids[at], -1)
        return out


def grouped(words: list[str]):
    """(places in the list, codes) for words of one length each, with a word mark in front."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, at in sorted(by.items()):
        flat = "".join("▁" + words[i] for i in at).encode("utf-32-le", "surrogatepass")
        yield np.array(at), np.frombuffer(flat, np.uint32).reshape(len(at), n + 1).astype(np.uint64)


def edges(pieces: Pieces, codes: np.ndarray):
    """For each end of a piece: (end, start, rows, piece ids). Single letters that are no piece have id -1."""
    h = pieces.hashes(codes)
    for e in range(1, codes.shape[1] + 1):
        for s in range(max(0, e - pieces.longest), e):
            ids = pieces.find(h[:, e] - h[:, s] * pieces.powers[e - s])
            rows = np.arange(len(ids)) if e - s == 1 else np.nonzero(ids >= 0)[0]
            if len(rows):
                yield e, s, rows, ids[rows]


@dataclass
class Model:
    langs: list[str]
    prob: np.ndarray  # piece x language, the last row for letters that are no piece

    def words(self, pieces: Pieces, words: list[str]) -> np.ndarray:
        """log probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        for at, codes in grouped(words):
            n = codes.shape[1]
            if n > VERY_LONG:
                for i, one in zip(at, codes, strict=True):
                    out[i] = self.very_long(pieces, one)
                continue
            alpha = np.zeros((n + 1, len(at), len(self.langs)))
            alpha[0] = 1.0
            shift = np.zeros(len(at))
            for e, s, rows, ids in edges(pieces, codes):
                alpha[e, rows] += alpha[s, rows] * (self.prob[ids] * SCALE ** (e - s))
                if n > LONG and s == e - 1:
                    # all pieces that end here are in: bring the window back to a middle size
                    top = alpha[e].max(1)
                    top[top == 0] = 1.0
                    alpha[max(0, e - pieces.longest) : e + 1] /= top[None, :, None]
                    shift += np.log(top)
            out[at] = np.log(np.maximum(alpha[n], 1e-300)) + shift[:, None] - n * np.log(SCALE)
        return out


    def very_long(self, pieces: Pieces, codes: np.ndarray) -> np.ndarray:
        """The same forward sum for one word: pieces are looked up for a block of places at once, and the
        last few sums are brought back to a middle size every few letters."""
        n, back = len(codes), pieces.longest
        h, value = np.zeros(n + 1, np.uint64), 0
        mul, mask = int(_MUL), (1 << 64) - 1
        for i, c in enumerate(codes.tolist(), 1):
            value = (value * mul + c + 1) & mask
            h[i] = value
        alpha, shift = np.zeros((n + 1, len(self.langs))), 0.0
        alpha[0] = 1.0
        scale = SCALE ** np.arange(back + 1.0)
        for a in range(1, n + 1, 20_000):
            b = min(n + 1, a + 20_000)
            ends, starts, ids = [], [], []
            for d in range(1, back + 1):
                e = np.arange(max(a, d), b)
                got = pieces.find(h[e] - h[e - d] * pieces.powers[d])
                keep = np.ones(len(e), bool) if d == 1 else got >= 0
                ends.append(e[keep])
                starts.append(e[keep] - d)
                ids.append(got[keep])
            e, s, k = (np.concatenate(x) for x in (ends, starts, ids))
            order = np.argsort(e, kind="stable")
            e, s, k = e[order], s[order], k[order]
            p = self.prob[k] * scale[e - s][:, None]
            bounds = np.searchsorted(e, np.arange(a, b + 1)).tolist()
            for i in range(a, b):
                x, y = bounds[i - a], bounds[i - a + 1]
                alpha[i] = (alpha[s[x:y]] * p[x:y]).sum(0)
                if i % 8 == 0:
                    top = alpha[i].max() or 1.0
                    alpha[max(0, i - back) : i + 1] /= top
                    shift += np.log(top)
        return np.log(np.maximum(alpha[n], 1e-300)) + shift - n * np.log(SCALE)


def even(pieces: Pieces, langs: int) -> np.ndarray:
    """Where learning starts: a probability for each piece by its length, the same in all languages."""
    lengths = np.array([*map(len, pieces.names), 1], float)
    prob = (4.0**-lengths)[:, None] * np.ones((1, langs))
    return prob / prob.sum(0)


def expected(pieces: Pieces, prob: np.ndarray, words: list[str], lang: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words (of LONG letters at most) of a language that occur so many
    times: over all segmentations of a word, by their probability. The last row is for letters that are no piece."""
    got = np.zeros(prob.shape)
    for at, codes in grouped(words):
        for a in range(0, len(at), 10_000):
            own, c = at[a : a + 10_000], codes[a : a + 10_000]
            n, where = c.shape[1], lang[own]
            alpha, beta = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
            alpha[0] = beta[n] = 1.0
            arcs = []
            for e, s, r, ids in edges(pieces, c):
                p = prob[ids, where[r]] * SCALE ** (e - s)
                alpha[e, r] += alpha[s, r] * p
                arcs.append((e, s, r, ids, p))
            for e, s, r, ids, p in sorted(arcs, key=lambda x: (-x[0], -x[1])):
                beta[s, r] += beta[e, r] * p
            total = np.maximum(alpha[n], 1e-300)
            for e, s, r, ids, p in arcs:
                np.add.at(got, (ids, where[r]), alpha[s, r] * p * beta[e, r] / total[r] * count[own][r])
    return got


def shares(got: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts; pieces that are never expected keep a little."""
    return (got + 0.01) / (got + 0.01).sum(0)


def fit(pieces: Pieces, counts: list[tuple[str, str, int]], steps: int = STEPS) -> Model:
    """Of (language, word, count) rows, whose words have LONG letters at most, in one process."""
    langs = sorted({r[0] for r in counts})
    code = {x: i for i, x in enumerate(langs)}
    words, lang, count = [r[1] for r in counts], np.array([code[r[0]] for r in counts], int), np.array([r[2] for r in counts], float)
    prob = even(pieces, len(langs))
    for _ in range(steps):
        prob = shares(expected(pieces, prob, words, lang, count))
    return Model(langs, prob)


def training_words(text: str) -> list[str]:
    """Runs of letters of a text as scoring takes them, in parts of LONG."""
    return [w[i : i + LONG] for w in _LETTERS(text.lower()) for i in range(0, len(w), LONG)]


def word_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """lang (its number), word, n over all rows of docs (text, lang)."""
    code = {x: i for i, x in enumerate(langs)}

    def run(batches):
        for b in batches:
            held, size = Counter(), 0
            texts, own = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, (t, x) in enumerate(zip(texts, own, strict=True)):
                for w in training_words(t):
                    held[code[x], w] += 1
                size += len(t)
                if held and (size >= 1 << 22 or i == len(texts) - 1):
                    keys = list(held)
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([held[k] for k in keys], pa.int64())], names=["lang", "word", "n"])
                    held, size = Counter(), 0

    return map_arrow(docs.select("text", "lang"), run, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learned(counts: DataFrame, path: str, langs: list[str], steps: int = STEPS) -> Model:
    """The model of a stored table of ``word_counts``, as ``fit`` makes it.

    Expected counts are summed up on the executors, in whole parts of 1 / GRAIN, so that their order does not
    matter. What comes to the driver in each step is a number for each piece of the vocabulary and language.
    """
    prob = even(pieces_of(path), len(langs))

    def step(prob: np.ndarray) -> DataFrame:
        def run(batches):
            for b in batches:
                got = expected(pieces_of(path), prob, b.column(1).to_pylist(), b.column(0).to_numpy(), b.column(2).to_numpy().astype(float))
                whole = np.rint(got * GRAIN).astype(np.int64)
                piece, lang = np.nonzero(whole)
                yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(whole[piece, lang])], names=["piece", "lang", "n"])

        return map_arrow(counts, run, "piece int, lang int, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n"))

    for _ in range(steps):
        got = np.zeros(prob.shape)
        for r in step(prob).collect():
            got[r.piece, r.lang] = r.n / GRAIN
        prob = shares(got)
    return Model(langs, prob)


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def train(docs: DataFrame, path: str, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` documents of each language at most, taken by a hash of the id, of those
    whose crc32 mod 3 is not 1: the one bound of the fit. All their words are learned from, whatever language
    they are of; they stay on the executors."""
    own = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(crc_of(F.col("doc_id")) % 3 != 1)
    sizes = own.groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return Model([], np.zeros((0, 0)))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, per_language / r["count"]) * (1 << 20)))))
    chosen = own.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lang")), F.lit(1 << 20)) < share[F.col("lang")])
    langs = sorted(r["lang"] for r in sizes)
    tasks = max(4, docs.sparkSession.sparkContext.defaultParallelism)
    counts = staged(word_counts(chosen, langs).repartition(tasks, "lang", "word"), "words")
    model = learned(counts, path, langs)
    release(counts)
    return model


class Scorer:
    """Sums of word scores over texts, with a bounded memory of tokens."""

    def __init__(self, pieces: Pieces, model: Model):
        self.pieces, self.model, self.known = pieces, model, {}
        self.table: list[np.ndarray] = []

    def learn(self, tokens: list[str]) -> None:
        parts = [_LETTERS(t.lower()) for t in tokens]
        words = list({w for p in parts for w in p})
        code = {w: i for i, w in enumerate(words)}
        score = self.model.words(self.pieces, words) if words else np.zeros((0, len(self.model.langs)))
        one = np.fromiter((code[p[0]] if len(p) == 1 else -1 for p in parts), np.int64, len(parts))
        rows = np.zeros((len(parts), len(self.model.langs) + 1))
        rows[one >= 0, :-1] = score[one[one >= 0]]
        rows[one >= 0, -1] = 1
        for i in np.nonzero(one < 0)[0]:
            for w in parts[i]:
                rows[i, :-1] += score[code[w]]
                rows[i, -1] = 1
        n = len(self.known)
        self.known.update(zip(tokens, range(n, n + len(tokens)), strict=True))
        self.table.append(rows)

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        each = [t.split() for t in texts]
        every = [w for x in each for w in x]
        new = list(set(every).difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known, self.table = {}, []
            new = list(set(every))
        if new:
            self.learn(new)
        self.table = [np.concatenate(self.table)] if self.table else [np.zeros((0, len(self.model.langs) + 1))]
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        ends = np.cumsum([len(x) for x in each]) if each else np.zeros(0, int)
        sums = np.concatenate([np.zeros((1, self.table[0].shape[1])), np.cumsum(self.table[0][at], 0)])
        total = sums[ends] - sums[np.concatenate([[0], ends[:-1]])] if each else sums[:0]
        z, has = total[:, :-1], total[:, -1] > 0.5
        best = z.argmax(1)
        score = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
        return [self.model.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def predict(docs: DataFrame, model: Model, path: str) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``."""

    def run(batches):
        scorer = Scorer(pieces_of(path), model) if model.langs else None
        for b in batches:
            texts = b.column(1).to_pylist()
            for a in range(0, len(texts), 500):
                own = texts[a : a + 500]
                langs, score = scorer.texts(own) if scorer else ([UNKNOWN] * len(own), np.zeros(len(own)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 500), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    base = documents(docs)
    return map_arrow(base, run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_id(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, or where no
    language could be learned. Ties go to the first language by name. Rows
    that repeat a doc_id have a result each; extra columns are ignored. An
    empty table gives an empty result.
    """
    out = predict(docs, train(docs, path), path)
    return out.select("doc_id", (crc_of(F.col("doc_id")) % 3 == 1).alias("held_out"), "lang_pred", "score")
