"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut the same bytes, so their cumulative token ends are two
rising lists. Merging them with two pointers gives the places where either has
an end: between two such places there is one token of each side, which is a
link; a place where both have an end closes a group. Texts are worked on in
chunks; a chunk is one row with its documents' links as numbers of the chunk's
own different id pairs, so what Spark groups and joins is a row for each chunk
and different pair and not for each link.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.bpe import CACHE, Bpe
from noticeflow.runtime import map_arrow, release, ship, staged

CHUNK = 3 << 20  # bytes of texts in a chunk, but for longer texts
SHIFT = np.int64(1) << np.int64(32)


class ByteLevel(Bpe):
    """A byte-level vocabulary whose special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.special, self.specials = {}, None
        self.reset()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, ends = self.encode([" " + t for t in texts])
        return flat.astype(np.int64), np.diff(ends, prepend=0)


class Pieces:
    """A vocabulary of pieces with byte fallback.

    Where no piece goes on after its letters with a blank, what stands between a blank and the next letters' end is
    cut for itself, so each different run of blanks and letters is encoded once and remembered.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        every = [piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(every)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.cut = re.compile(" +[^ ]*" if all("▁" not in p.lstrip("▁") for p in every) else "(?s).+").findall
        self.blank = self.model.piece_to_id("▁")
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends, self.whole = np.zeros(0, np.uint16 if len(self.bytes) <= 1 << 16 else np.int64), np.zeros(1, np.int64), np.zeros(0, bool)

    def learn(self, runs: list[str]) -> None:
        """Encode runs not known yet; each begins with the blank that the model adds. Whole: the pieces' bytes are the run."""
        rows = self.model.encode([r[1:] for r in runs], num_threads=1)
        rows = [x if len(r) > 1 else [self.blank] for r, x in zip(runs, rows, strict=True)]  # a text's last blank
        whole = [b"".join(map(self.bytes.__getitem__, x)) == r.encode() for r, x in zip(runs, rows, strict=True)]
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs)), strict=True))
        self.flat = np.concatenate([self.flat, np.array(list(chain.from_iterable(rows)), self.flat.dtype)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in rows])])
        self.whole = np.concatenate([self.whole, np.array(whole, bool)])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, how many each has, and whether its pieces are the bytes of a blank and the text."""
        each = [self.cut(" " + t) for t in texts]
        every = list(chain.from_iterable(each))
        new = list(set(every).difference(self.known))
        if len(self.known) + len(new) > CACHE and self.known:
            self.reset()
            new = list(set(every))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        starts, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        upto = np.cumsum(n)
        flat = self.flat[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - (upto - n), n)]
        last = np.cumsum([len(x) for x in each])
        whole = np.array([w.all() for w in np.split(self.whole[at], last[:-1])], bool) if len(last) else np.zeros(0, bool)
        return flat.astype(np.int64), np.diff(np.concatenate([[0], upto])[last], prepend=0) if len(last) else np.zeros(0, np.int64), whole


_LOADED: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def load(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """Both vocabularies, loaded once in a process."""
    if (a, b) not in _LOADED:
        _LOADED[a, b] = ByteLevel(a), Pieces(b)
    return _LOADED[a, b]


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of a, token of b, whether both end there) at each place where either side has an end.

    A stable sort of two sorted runs is their two-pointer merge; an end that both have stands twice in it.
    """
    both = np.concatenate([ends_a, ends_b])
    order = np.argsort(both, kind="stable")
    place = both[order]
    of_a = order < len(ends_a)
    last = np.append(place[1:] != place[:-1], True) if len(place) else np.zeros(0, bool)
    # pointers: how many ends of each side lie before a place
    a, b = np.cumsum(of_a), np.cumsum(~of_a)
    shared = np.zeros(len(place), bool)
    shared[1:] = ~last[:-1]
    shared, a, b = shared[last], a[last], b[last]
    # a token that ends at the place is the pointer's last; one that goes on is the next
    ends_here_a = np.where(shared, True, of_a[last])
    ends_here_b = np.where(shared, True, ~of_a[last])
    return a - ends_here_a, b - ends_here_b, shared


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, names: list[str]) -> list[str]:
    """The pieces of ``a1,a2|b1;a3|b2,b3`` in order, of groups numbered from 0; names has each id with each of its marks."""
    n = len(names) // 4
    ends_a = np.append(group_a[1:] != group_a[:-1], True)
    ends_b = np.append(group_b[1:] != group_b[:-1], True)
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    before_b, upto_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    out[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + n * ends_a
    out[np.arange(len(ids_b)) + upto_a[group_b]] = ids_b + n * (2 + ends_b)
    return list(map(names.__getitem__, out.tolist()))


@lru_cache(1)
def names(n: int) -> list[str]:
    """Each id with the mark after it: , or | on the left side, , or ; on the right."""
    plain = [str(i) for i in range(n)]
    return [x + mark for mark in (",", "|", ",", ";") for x in plain]


def squeezed(values: np.ndarray) -> tuple[int, bytes]:
    """How many bytes, and the compressed bytes of values below 2^32."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # bytes of one weight together
    return len(raw), pa.compress(raw, "zstd", asbytes=True) if raw else b""


def unsqueezed(size: int, raw: bytes) -> np.ndarray:
    if not size:
        return np.zeros(0, np.int64)
    return np.frombuffer(pa.decompress(raw, size, "zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _whole(texts: list[str], a: ByteLevel, b: Pieces):
    """(numbers of the texts that have tokens, ids of a, how many, ids of b, how many)."""
    some = np.flatnonzero([bool(t) for t in texts])
    ids_b, n_b, whole = b.ids([texts[i] for i in some])
    ids_b, n_b, some = ids_b[np.repeat(whole, n_b)], n_b[whole], some[whole]
    ids_a, n_a = a.ids([texts[i] for i in some])
    return some, ids_a, n_a, ids_b, n_b


def chunk_row(ids: list, texts: list[str], a: ByteLevel, b: Pieces, marks: list[str]) -> dict:
    """A chunk: per document its id, numbers of tokens, groups and links and the hash of its groups; the
    chunk's different pairs with the numbers of their links; and per document its pairs as numbers among those.

    The groups' tokens are written out a document at a time.
    """
    some, ids_a, n_a, ids_b, n_b = _whole(texts, a, b)
    n = len(texts)
    at_a, at_b, shared = merged(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]))
    group = np.cumsum(shared) - shared
    group_a, group_b = np.empty(len(ids_a), np.int64), np.empty(len(ids_b), np.int64)
    group_a[at_a], group_b[at_b] = group, group
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    doc = np.searchsorted(ends_a, at_a, "right")  # of each link
    digest = [""] * n
    for k, i in enumerate(some):
        x, y = slice(ends_a[k] - n_a[k], ends_a[k]), slice(ends_b[k] - n_b[k], ends_b[k])
        first = group_a[x.start]
        digest[i] = sha256("".join(group_texts(ids_a[x], ids_b[y], group_a[x] - first, group_b[y] - first, marks))[:-1].encode()).hexdigest()
    pair = ids_a[at_a] * SHIFT + ids_b[at_b]
    keys, number = np.unique(pair, return_inverse=True)
    # of each document its different pairs in order, as steps, and how often it has them
    own = np.sort(doc * np.int64(len(keys)) + number) if len(keys) else number
    new = np.append(True, own[1:] != own[:-1])[: len(own)]
    times = np.diff(np.append(np.flatnonzero(new), len(own)))
    own = own[new]
    size, steps = squeezed(np.diff(own, prepend=0))  # below twice the number of keys
    _, counts = squeezed(times)
    place = some
    per = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    per["n_a"][place], per["n_b"][place] = n_a, n_b
    per["n_links"][place] = np.bincount(doc, minlength=len(some))
    per["n_groups"][place] = np.bincount(doc, shared, minlength=len(some)).astype(np.int64)
    key_steps = np.diff(keys, prepend=0)
    return {
        "doc_ids": ids, **per, "groups_sha256": digest, "n_keys": len(keys), "key_high": squeezed(key_steps >> 32)[1], "key_low": squeezed(key_steps & (SHIFT - 1))[1],
        "key_counts": squeezed(np.bincount(number, minlength=len(keys)))[1], "size": size, "steps": steps, "times": counts,
    }


CHUNK_SCHEMA = "doc_ids array<string>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, n_keys long, key_high binary, key_low binary, key_counts binary, size long, steps binary, times binary"


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each chunk of documents, see ``chunk_row``."""

    def run(frames):
        a, b = load(path_a, path_b)
        marks = names(max(a.size, len(b.bytes)))
        for frame in frames:
            ids, texts = ([x if isinstance(x, str) else None for x in frame[c]] for c in ("doc_id", "text"))
            texts, start, size = [t or "" for t in texts], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= CHUNK or i == len(texts) - 1:
                    yield pd.DataFrame([chunk_row(ids[start : i + 1], texts[start : i + 1], a, b, marks)])
                    start, size = i + 1, 0

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, CHUNK_SCHEMA)


def _keys(row: dict) -> np.ndarray:
    n = 4 * row["n_keys"]
    return np.cumsum((unsqueezed(n, row["key_high"]) << 32) + unsqueezed(n, row["key_low"]))


def chunk_pairs(made: DataFrame) -> DataFrame:
    """chunk, a_id, b_id, n: the links of each chunk by id pair."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = _keys(row)
                values = [np.full(len(keys), row["chunk"], np.int64), (keys >> 32).astype(np.int32), (keys & (SHIFT - 1)).astype(np.int32), unsqueezed(4 * row["n_keys"], row["key_counts"])]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["chunk", "a_id", "b_id", "n"])

    return map_arrow(made.select("chunk", "n_keys", "key_high", "key_low", "key_counts"), run, "chunk long, a_id int, b_id int, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a_id, b_id, n, best_a, best_b: the links of each id pair, and whether no other pair of its a or of its b id has more."""
    counts = staged(pairs.groupBy("a_id", "b_id").agg(F.sum("n").alias("n")), "pairs")
    most = lambda side: staged(counts.groupBy(side).agg(F.max("n").alias(f"most_{side}")), "most")  # noqa: E731  a row per id of a vocabulary
    out = counts.join(most("a_id"), "a_id").join(most("b_id"), "b_id")
    return out.select("a_id", "b_id", "n", (F.col("n") == F.col("most_a_id")).alias("best_a"), (F.col("n") == F.col("most_b_id")).alias("best_b"))


def token_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a_at, b_at, a_id, b_id, group: every link of every text, by places of the tokens in the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        a, b = load(path_a, path_b)
        for batch in batches:
            for i in range(batch.num_rows):
                some, ids_a, _, ids_b, _ = _whole([batch.column(1)[i].as_py() or ""], a, b)
                at_a, at_b, shared = merged(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]))
                own = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(at_a), np.int64)))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x.astype(np.int64)) for x in (at_a, at_b, ids_a[at_a], ids_b[at_b], np.cumsum(shared) - shared))], names=["doc_id", "a_at", "b_at", "a_id", "b_id", "group"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, a_at long, b_at long, a_id long, b_id long, `group` long")


def vocabulary_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a_id, b_id, n, best_a, best_b over all texts: which tokens of two vocabularies stand for each other."""
    made = staged(chunks(docs, path_a, path_b).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    return pair_counts(chunk_pairs(made))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs``.

    n_best counts the links whose pair has the most links of its b id in the
    whole corpus, ties included; count_sum adds up the pairs' links over a
    text's links. Null and empty texts, and those whose tokens' bytes are not a
    space and the text, have zeros and an empty groups_sha256. Rows that repeat
    a doc_id are texts of their own; a null doc_id stays null. An empty table
    gives an empty result; extra columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = staged(chunks(docs, path_a, path_b).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    pairs = staged(chunk_pairs(made), "chunk_pairs")
    counts = staged(pair_counts(pairs), "counts")
    # both sides are staged tables: a pair that every chunk has can be split
    known = staged(pairs.drop("n").join(counts, ["a_id", "b_id"]).select("chunk", "a_id", "b_id", "n", "best_b"), "known")
    release(pairs, counts)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        a, b, n, best = (right.column(c).to_numpy() for c in ("a_id", "b_id", "n", "best_b"))
        order = np.argsort(a * SHIFT + b)  # as the chunk's keys are
        n, best = n[order], best[order].astype(np.int64)
        own, times = np.cumsum(unsqueezed(row["size"], row["steps"])), unsqueezed(row["size"], row["times"])
        ids = row["doc_ids"]
        has = np.flatnonzero(np.array(row["n_links"]))
        keys = max(1, len(n))
        doc, at = has[own // keys], own % keys
        sums, bests = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(sums, doc, times * n[at])
        np.add.at(bests, doc, times * best[at])
        return pa.table({"doc_id": pa.array(ids, pa.string()), **{k: pa.array(row[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": pa.array(bests), "count_sum": pa.array(sums), "groups_sha256": pa.array(row["groups_sha256"], pa.string())})

    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    ship(docs.sparkSession)
    mine = made.drop("key_high", "key_low", "key_counts")
    out = mine.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(finish, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
