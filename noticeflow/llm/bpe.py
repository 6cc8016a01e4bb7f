"""Byte-level BPE: encoding by a segment tree over adjacent pair ranks, and decoding.

A piece of text is a list of byte symbols. The leaves of its tree hold, for
each symbol, the rank of the pair that it forms with the next one; the root is
the leftmost least rank. A merge changes three leaves (the merged symbol, the
one it takes in and the one before it), each in a logarithmic number of steps.
Short pieces of a batch share one array of trees, so that a step of all of
them is a few array operations; long pieces have a tree each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.runtime import map_arrow

#: The split pattern of the vocabulary file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE, CHUNK_CHARS, WIDE = 200_000, 500_000, 64
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _check_form(spec: dict) -> None:
    """Raises where a file asks for a form of BPE that this module does not have."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    ok = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    ok = ok and not any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word", "normalized"))
    if not ok or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        raise ValueError("only byte-level BPE without normaliser, prefix space, dropout, word marks or added tokens that take in blanks is supported")


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check_form(spec)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {**vocab, **self.special}
        self.bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.of_byte = np.array([vocab[s] for s in symbols], np.int32)
        self.size = len(self.bytes)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.split = regex.compile(SPLIT).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.ends = [np.zeros(1, np.int64)]
        for s, i in self.special.items():
            self._learn([s], np.array([i], np.int32), np.array([1], np.int64))

    def _learn(self, pieces: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.flat.append(flat)
        self.ends.append(self.ends[-1][-1] + np.cumsum(lengths))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _merge_many(self, raw: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes, a power of two."""
        n, none = len(raw), np.int64(NONE) * width
        size = np.array([len(r) for r in raw])
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :width][np.arange(width) < size[:, None]] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        nxt = np.tile(np.arange(1, width + 2), (n, 1))
        nxt[np.arange(n), size - 1] = width
        prv = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), none, np.int64)
        leaf = ids[:, :-1]
        both = (leaf >= 0) & (ids[:, 1:] >= 0)
        row, col = np.nonzero(both)
        rank = self._rank(leaf[row, col], ids[row, col + 1]).astype(np.int64)
        tree[row, width + col] = np.where(rank < NONE, rank * width + col, none)
        for level in range(width.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])

        def put(rows, cols, values):
            at = cols + width
            tree[rows, at] = values
            while at.size and at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        def value(rows, cols):
            right = ids[rows, nxt[rows, cols]]
            r = self._rank(ids[rows, cols], right).astype(np.int64)
            return np.where((right >= 0) & (r < NONE), r * width + cols, none)

        live = np.nonzero(tree[:, 1] < none)[0]
        while live.size:
            root = tree[live, 1]
            at, rank = root % width, root // width
            taken = nxt[live, at]
            ids[live, at] = self.made[rank]
            ids[live, taken] = -1
            after = nxt[live, taken]
            nxt[live, at] = after
            prv[live, np.minimum(after, width - 1)] = np.where(after < width, at, prv[live, np.minimum(after, width - 1)])
            put(live, taken, none)
            put(live, at, value(live, at))
            before = prv[live, at]
            has = before >= 0
            if has.any():
                put(live[has], before[has], value(live[has], before[has]))
            live = live[tree[live, 1] < none]
        body = ids[:, :width]
        flat = body[body >= 0]
        return flat, (body >= 0).sum(1)

    def _merge_long(self, raw: bytes) -> list[int]:
        ids = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        width = 1 << (n - 1).bit_length()
        none = (1 << 62)
        rank_of, size, made = self.rank_of, self.size, self.made
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = rank_of.get(ids[i] * size + ids[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i, v):
            k = width + i
            tree[k] = v
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                m = a if a < b else b
                if tree[k] == m:
                    break
                tree[k] = m
                k >>= 1

        def value(i):
            j = nxt[i]
            r = rank_of.get(ids[i] * size + ids[j]) if j < n else None
            return none if r is None else r * width + i

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = nxt[i]
            ids[i] = int(made[rank])
            ids[j] = -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            put(j, none)
            put(i, value(i))
            if prv[i] >= 0:
                put(prv[i], value(prv[i]))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces not known yet."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw])
        width = 4
        while width <= WIDE:
            own = np.nonzero((size <= width) & (size > (width // 2 if width > 4 else 0)))[0]
            for a in range(0, len(own), 50_000):
                part = own[a : a + 50_000]
                flat, n = self._merge_many([raw[i] for i in part], width)
                self._learn([pieces[i] for i in part], flat, n)
            width *= 2
        for i in np.nonzero(size > WIDE)[0]:
            ids = self._merge_long(raw[i])
            self._learn([pieces[i]], np.array(ids, np.int32), np.array([len(ids)], np.int64))

    def pieces(self, text: str) -> list[str]:
        if self.specials and any(s in text for s in self.special):
            out: list[str] = []
            for k, part in enumerate(self.specials.split(text)):
                out += [part] if k % 2 else self.split(part)
            return out
        return self.split(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text ends."""
        each = [self.pieces(t) for t in texts]
        every = [p for x in each for p in x]
        new = list(set(every).difference(self.known))
        if len(self.known) + len(new) > CACHE and len(self.known) > len(self.special):
            self.reset()
            new = list(set(every).difference(self.known))
        if new:
            self.learn(new)
        self.flat, self.ends = [np.concatenate(self.flat)], [np.concatenate(self.ends)]
        flat, ends = self.flat[0], self.ends[0]
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        starts, n = ends[at], ends[at + 1] - ends[at]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        ids = flat[np.arange(total) + np.repeat(starts - (upto - n), n)]
        piece_ends = np.cumsum([len(x) for x in each]) if each else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], upto])[piece_ends]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, path: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` with n_tokens (long) and ids (binary: little-endian unsigned 32-bit
    integers), and decoded (what the ids decode to) if asked for.

    Null texts count as empty: no ids. Columns of ``df`` that have the names of
    the new ones are replaced. Rows are independent of one another; long texts
    are encoded whole.
    """
    new = ["n_tokens", "ids", *(["decoded"] if decoded else [])]
    keep = df.drop(*new)
    kinds = {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.StringType()}
    schema = T.StructType([*keep.schema.fields, *(T.StructField(c, kinds[c]) for c in new)])

    def run(batches):
        bpe = load(path)
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col))
            texts = [t or "" for t in column.to_pylist()]
            for a, b in _runs(texts):
                ids, ends = bpe.encode(texts[a:b])
                starts = np.concatenate([[0], ends[:-1]])
                raw = ids.astype("<u4")
                out = [pa.array(ends - starts, pa.int64()), pa.array([raw[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())]
                if decoded:
                    out.append(pa.array([bpe.decode(ids[s:e].tolist()) for s, e in zip(starts, ends, strict=True)], pa.string()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *new])

    return map_arrow(keep, run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``. Null texts count as empty, rows that repeat a
    doc_id have a result each; an empty table gives an empty result and extra columns are ignored."""
    out = encode(docs.select("doc_id", "text"), path, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
