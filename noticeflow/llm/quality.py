"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; each visit fits a shallow tree to
the gradient over the feature's bins and adds it to that feature's table. Then
the pairs of features that explain most of what is left get tables of their
own in the same way. A score is the sum of table entries, one per feature and
pair, through the logistic function.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.common import unpacked
from noticeflow.runtime import map_arrow, maybe_broadcast

FEATURES = ["log_chars", "log_words", "mean_word", "letters", "upper", "digits", "white", "sentence", "symbols", "distinct_words", "top_word", "repeats", "distinct_lines", "words_line", "odd_ends", "longest"]
SAMPLE, BINS, PAIR_BINS, ROUNDS, RATE, PAIRS = 20_000, 32, 8, 60, 0.15, 6
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.uint8)  # 0 other symbol, 1 lower, 2 upper, 3 digit, 4 white, 5 sentence mark
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[128:] = 1
#: Runs of other marks before a blank or the end; only the start of a run is tried, so that long runs cost no more than others.
_ODD = re.compile(r"(?<![^\w\s.,;:?!'\")-])[^\w\s.,;:?!'\")-]++(?=\s|$)")


def features(text: str) -> list[float]:
    """Of a whole text; of an empty one all but the sizes are 0."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6) / n
    words = text.split()
    m = len(words)
    if not m:
        return [float(np.log1p(len(text))), 0.0, 0.0, float(c[1] + c[2]), 0.0, float(c[3]), float(c[4]), float(c[5]), float(c[0]), *[0.0] * 7]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split("\n")
    same = sum(map(str.__eq__, words, words[1:])) if m > 1 else 0
    size = len(text) - text.count(" ") - text.count("\n")
    letters = float(c[1] + c[2])
    return [
        float(np.log1p(len(text))), float(np.log1p(m)), size / m, letters, float(c[2]) / max(letters, 1e-9), float(c[3]), float(c[4]), float(c[5]), float(c[0]),
        len(counts) / m, max(counts.values()) / m, same / m, len(set(lines)) / len(lines), m / len(lines), len(_ODD.findall(text)) / m, float(np.log1p(max(map(len, counts)))),
    ]


def _tree(g: np.ndarray, h: np.ndarray, splits: int = 3) -> np.ndarray:
    """Step per bin of a tree with at most ``splits`` splits over ordered bins."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    edges = [0, len(g)]
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    for _ in range(splits):
        best, at = 1e-6, None
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                k = np.arange(a + 1, b)
                v = gain(a, k) + gain(k, b) - gain(a, b)
                if v.max() > best:
                    best, at = v.max(), int(k[v.argmax()])
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Step per cell of the best cut of a grid into four, and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, found = -1.0, np.zeros_like(g)
    n, m = g.shape
    for i in range(1, n):
        for j in range(1, m):
            total, step = 0.0, np.zeros_like(g)
            for a, b in ((0, i), (i, n)):
                for c, d in ((0, j), (j, m)):
                    gs = cg[b, d] - cg[a, d] - cg[b, c] + cg[a, c]
                    hs = ch[b, d] - ch[a, d] - ch[b, c] + ch[a, c]
                    total += gs * gs / (hs + 1.0)
                    step[a:b, c:d] = gs / (hs + 1.0)
            if total > best:
                best, found = total, step
    return found, best


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, j], "right")]
        for i, j, table in self.pairs:
            z += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Of rows of features and labels 0 or 1. Without both labels the score is constant: 1 without any row or any 0, else 0."""
    k = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return Model(20.0 if len(y) == 0 or y[0] == 1 else -20.0, [np.zeros(0)] * k, [np.zeros(1)] * k, [np.zeros(0)] * k, [])
    def cuts(n: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, j], np.arange(1, n) / n, method="higher")) for j in range(k)]
    fine, coarse = cuts(BINS), cuts(PAIR_BINS)
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(fine)]
    tables = [np.zeros(len(c) + 1) for c in fine]
    base = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j in range(k):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(at[j], y - p, len(tables[j])), np.bincount(at[j], p * (1 - p), len(tables[j])))
            tables[j] += step
            z += step[at[j]]
    low = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]

    def grid(i: int, j: int):
        p = 1 / (1 + np.exp(-z))
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = low[i] * shape[1] + low[j]
        return cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    ranked = sorted(((_quadrants(*grid(i, j)[1:])[1], i, j) for i in range(k) for j in range(i)), reverse=True)[:PAIRS]
    pairs = {(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for _, i, j in ranked}
    for _ in range(ROUNDS // 4):
        for i, j in pairs:
            cell, g, h = grid(i, j)
            step = RATE * _quadrants(g, h)[0]
            pairs[i, j] += step
            z += step.ravel()[cell]
    return Model(base, fine, tables, coarse, [(i, j, t) for (i, j), t in pairs.items()])


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id as text; of a null id that of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` labelled rows whose crc32 mod 4 is not 2, taken by a hash of the id."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null").filter(crc_of(F.col("_id")) % 4 != 2)
    share = min(1.0, sample / max(1, own.count()))
    own = own.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(maybe_broadcast(own), F.col("doc_id") == F.col("_id")).select("_y", "text")

    def run(batches):
        for b in batches:
            x = [features(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = map_arrow(rows, run, "y int, x array<double>").collect()
    x = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, np.array([r["y"] for r in got])))
    return fit(x[order], np.array([r["y"] for r in got], float)[order])


def with_score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows``, whose one column is a struct with a field text, and their quality_score."""
    kind = rows.schema[0].dataType
    field = kind.names.index("text")

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                x = np.array([features(t or "") for t in part.column(0).field(field).to_pylist()]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x))], names=["row", "quality_score"])

    return map_arrow(rows, run, T.StructType([T.StructField("row", kind), T.StructField("quality_score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null texts count as empty and are scored as such. Labels other than 0 and 1
    and labels without an id are not learned from. Rows that repeat a doc_id
    are scored each. Without labels every score is 1: what was never learned
    rejects nothing. Extra columns are ignored.
    """
    out = with_score(docs.select(F.struct("doc_id", "text").alias("row")), train(docs, labels)).select("row.doc_id", "quality_score")
    return out.select("doc_id", (crc_of(F.col("doc_id")) % 4 == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, with all their columns as they are, whatever their names.

    Null texts are scored as empty ones; rows that repeat a doc_id each by
    their own text. Without labels all rows stay; an empty table gives an
    empty result.
    """
    return unpacked(with_score(docs.select(F.struct("*").alias("row")), train(docs, labels)).filter(F.col("quality_score") >= THRESHOLD))
