"""LM scoring with an Elias-Fano n-gram trie.

The model is of order three, smoothed by hierarchical Dirichlet priors over
additive unigrams: p(w | h) = (c(h, w) + M p(w | h')) / (c(h) + M), h' being h
without its first word; contexts h that occur once in training are left to the
lower order, p(w | h) = p(w | h'). A text's first word follows START. Counts
are those of all training documents.

The trie is kept in shards. A shard of a level holds its contexts, the
monotone pointers to their successors (both Elias-Fano coded), the successors
in as few bytes as they need, and a code of two bytes for each successor's
smoothed probability. A context of level three is the node of level two that
it continues. A look-up finds the context, then the successor within that
context's range; it reads the compact arrays where they lie (a buffer or a
memory-mapped file) and unpacks none of them.

Texts become chunks of tokens. For each level a chunk asks each shard once for
all different n-grams that it has there, with its own training counts and the
lower order's codes; the shard adds up the counts, makes its part of the level
and answers from it. Contexts that are frequent, which every chunk can tell
from their counts, are dealt out by the n-gram's hash instead of the
context's, so that no shard has all of one. Nothing but two sums comes to the
driver.

Words are told apart by 128 bits of hash, and get exact numbers from then on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import ascii_lower, documents, hash_pair
from noticeflow.llm.quality import crc_of
from noticeflow.runtime import held, map_arrow, release, ship, staged

#: Tokens of a chunk; n-grams that a shard is asked for, all chunks together; training count from which a context is dealt out.
CHUNK, SHARD, HOT = 500_000, 1_000_000, 125_000
ALPHA, PRIOR, LEAST_CONTEXT = 0.1, 2.0, 2
END = (0x0A0A0A0A0A0A0A0A, 0x0D0D0D0D0D0D0D0D)
START = 0  # as a context; words are numbered from 1
#: Different bigrams and trigrams that a chunk asks for, for each different word: a measure of the shards that are needed.
ASKED = (4, 2.5)
STEP, EXACT, COUNT_STEP = 1024.0, 4096, 1024.0
LEAST_SHARDS, BATCH = 12, 1 << 16


# codes


def code_of(p: np.ndarray) -> np.ndarray:
    """Two bytes for a probability, in steps of 1/1024 of its logarithm to base 10; 0 stands for 'not there'."""
    return np.clip(np.rint(-np.log10(p) * STEP), 0, 65534).astype(np.uint16) + np.uint16(1)


def log_of(code: np.ndarray) -> np.ndarray:
    return (code.astype(float) - 1) / -STEP


def count_code(c: np.ndarray) -> np.ndarray:
    """Two bytes for a count: exact below 4096, then within 0.04 percent."""
    far = EXACT + np.rint(COUNT_STEP * np.log2(np.maximum(c, EXACT) / EXACT))
    return np.where(c < EXACT, c, np.minimum(far, 65535)).astype(np.uint16)


def count_of(code: np.ndarray) -> np.ndarray:
    c = code.astype(float)
    return np.where(c < EXACT, c, EXACT * 2.0 ** ((c - EXACT) / COUNT_STEP))


def smoothed(count: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return (count + PRIOR * lower) / (context + PRIOR)


# orders


def ordered(key: np.ndarray) -> np.ndarray:
    """The stable order of numbers that are not negative. A number and its place are sorted as one, which takes a fraction
    of the time; of numbers that leave no room for that as many upper bits as fit, where those tell them apart."""
    if not len(key):
        return np.zeros(0, np.int64)
    k, place = key.astype(np.uint64, copy=False), np.uint64(len(key).bit_length())
    over = max(0, int(k.max()).bit_length() + int(place) - 64)
    both = ((k >> np.uint64(over)) << place) | np.arange(len(k), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << int(place)) - 1)).astype(np.int64)
    if over:
        k = k[order]
        if (k[1:] < k[:-1]).any():
            return np.argsort(key, kind="stable")
    return order


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different numbers in order, the first place of each, and the number of each key among them."""
    order = ordered(key)
    k = key[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return k[new], order[new], inverse


def bit_places(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th bit that is set, from 0, in each word of 64 bits: by halves."""
    at, k = np.zeros(len(words), np.uint64), k.astype(np.uint8)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((words >> at) & np.uint64((1 << half) - 1))
        above = k >= low
        k = k - low * above
        at += above * np.uint64(half)
    return at.astype(np.int64)


# packed arrays


def bundle(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each at a multiple of eight bytes."""
    head, body = [struct.pack("<q", len(arrays))], []
    for a in arrays:
        raw = a.tobytes()
        head.append(struct.pack("<4sqq", a.dtype.str[1:].encode().ljust(4), len(a), len(raw)))
        body.append(raw + b"\0" * (-len(raw) % 8))
    head_ = b"".join(head)
    return head_ + b"\0" * (-len(head_) % 8) + b"".join(body)


def unbundle(buffer) -> list[np.ndarray]:
    """Views of the arrays in a bytes-like object or a memory-mapped file; nothing is copied."""
    view = memoryview(buffer)
    (n,) = struct.unpack_from("<q", view)
    at, out = 8 + 20 * n + (-(8 + 20 * n)) % 8, []
    for k in range(n):
        kind, length, size = struct.unpack_from("<4sqq", view, 8 + 20 * k)
        out.append(np.frombuffer(view, "<" + kind.decode().strip(), length, at))
        at += size + (-size) % 8
    return out


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays with their bytes sorted by place in the number, compressed."""
    planes = [a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.ravel() for a in arrays]
    head = struct.pack(f"<q{'4sq' * len(arrays)}", len(arrays), *(x for a in arrays for x in (a.dtype.str[1:].encode().ljust(4), len(a))))
    return held("squeeze", lambda: zstandard.ZstdCompressor(4)).compress(head + b"".join(p.tobytes() for p in planes))


def unsqueezed(blob: bytes) -> list[np.ndarray]:
    raw = held("unsqueeze", zstandard.ZstdDecompressor).decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    at, out = 8 + 12 * n, []
    for k in range(n):
        kind, length = struct.unpack_from("<4sq", raw, 8 + 12 * k)
        t = np.dtype("<" + kind.decode().strip())
        planes = np.frombuffer(raw, np.uint8, length * t.itemsize, at).reshape(t.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += length * t.itemsize
    return out


def _steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


# the trie


class EliasFano:
    """A non-decreasing sequence of unsigned integers over the arrays as stored: low parts in whole bytes,
    high parts in unary in words of 64 bits, and the zeros before each word. Nothing else is built from them."""

    def __init__(self, low: np.ndarray, words: np.ndarray, zeros: np.ndarray, n: int):
        self.words, self.zeros, self.n = words, zeros, n
        self.width = len(low) // n if n else 0
        self.low = low.reshape(n, self.width)
        self.top = int(zeros[-1]) - 1  # the last high part

    @staticmethod
    def pack(values: np.ndarray) -> list[np.ndarray]:
        n = len(values)
        last = int(values[-1]) if n else 0
        width = min(7, max(0, (max(1, last // max(1, n))).bit_length() // 8))
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].ravel()
        high = (values >> np.uint64(8 * width)).astype(np.int64)
        top = int(high[-1]) if n else 0
        bits = np.zeros(-(-(top + n + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        bits[top + n + 1 :] = 1  # after the end no zeros
        words = np.packbits(bits, bitorder="little").view("<u8")
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))]).astype("<u4" if len(bits) < 1 << 32 else "<u8")
        return [low, words, zeros]

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th zero, or one."""
        out = np.empty(len(k), np.int64)
        before = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros if ones else self.zeros
        for a in range(0, len(k), BATCH):
            want = k[a : a + BATCH]
            word = np.searchsorted(before, want, "right") - 1
            bits = self.words[word]
            out[a : a + BATCH] = word * 64 + bit_places(bits if ones else ~bits, want - before[word])
        return out

    def _start(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below the bucket."""
        inside = (bucket > 0) & (bucket <= self.top)
        out = np.where(bucket > 0, self.n, 0)
        b = bucket[inside] - 1
        out[inside] = self._select(b, False) - b
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at, True) - at).astype(np.uint64)
        return (high << np.uint64(8 * self.width)) | packed_ids(self.low, at)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that is not less than x; n if there is none."""
        bucket = np.minimum(x >> np.uint64(8 * self.width), np.uint64(self.top + 1)).astype(np.int64)
        lo, hi = self._start(bucket), self._start(bucket + 1)
        return lower_bound(self.low, lo, hi, x & np.uint64((1 << (8 * self.width)) - 1))


def packed_ids(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(raw.shape[1]):
        out |= raw[at, k].astype(np.uint64) << np.uint64(8 * k)
    return out


def lower_bound(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """First place in [lo, hi) whose number is not less than wanted, hi if there is none; numbers rise within each range."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        less = packed_ids(raw, mid) < want[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


class Level:
    """One shard of a level over its stored form, a bytes-like object or a memory-mapped file."""

    def __init__(self, buffer):
        a = unbundle(buffer)
        n, m = a[0].tolist()
        self.contexts, self.pointers = EliasFano(*a[1:4], n), EliasFano(*a[4:7], n + 1)
        self.successors = a[7].reshape(m, -1) if m else a[7].reshape(0, 1)
        self.codes, self.counts = a[8], a[9]

    @staticmethod
    def pack(context: np.ndarray, word: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> bytes:
        """Of n-grams sorted by context and word: their probabilities' and counts' codes."""
        new = np.append(True, context[1:] != context[:-1]) if len(context) else np.zeros(0, bool)
        pointers = np.append(np.flatnonzero(new), len(context)).astype(np.uint64)
        width = max(1, (int(word.max()).bit_length() + 7) // 8) if len(word) else 1
        ids = word.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].ravel()
        sizes = np.array([int(new.sum()), len(word)], "<i8")
        return bundle(sizes, *EliasFano.pack(context[new]), *EliasFano.pack(pointers), ids, codes, counts)

    def look_up(self, contexts: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of the n-grams of ``contexts``, each with so many of ``word``; -1 for those that are not there."""
        if not len(self.successors):
            return np.full(len(word), -1, np.int64)
        c = np.minimum(self.contexts.find(contexts), self.contexts.n - 1)
        known = self.contexts.get(c) == contexts
        lo, hi = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
        lo, hi = np.repeat(np.where(known, lo, 0), sizes), np.repeat(np.where(known, hi, 0), sizes)
        s = lower_bound(self.successors, lo, hi, word)
        hit = s < hi
        at = np.minimum(s, len(self.successors) - 1)
        return np.where(hit & (packed_ids(self.successors, at) == word), s, -1)


# chunks


def _unique128(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of the different pairs in order, and the number of each pair among them."""
    u, first, inverse = distinct(a)
    if (b[first][inverse] == b).all():
        return u, b[first], inverse
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return x[new], y[new], inverse


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, doc_ids, held_out, words, tokens.

    Words are both hashes of the different words and their training counts, in
    the order of the hash that deals them out. Tokens are each text's size, the
    words by frequency as places in that order, and the tokens as places in those.
    """
    base = documents(docs)
    kind = base.schema["doc_id"].dataType.simpleString()
    tokens = F.filter(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = base.select("doc_id", (crc_of(F.col("doc_id")) % 10 == 0).alias("held_out"), tokens.alias("w"))
    rows = rows.select("doc_id", "held_out", F.transform("w", lambda w: hash_pair(w)[0]).alias("a"), F.transform("w", lambda w: hash_pair(w)[1]).alias("b"))

    def close(ids, held, parts, number, id_type):
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        u, v, inverse = _unique128(a, b)
        dealt = np.lexsort((v, u, _mix(u)))
        place = np.empty(len(dealt), np.int64)
        place[dealt] = np.arange(len(dealt))
        token = place[inverse]
        sizes = np.array([len(p[0]) for p in parts], "<u4")
        trained = np.bincount(token[np.repeat(~np.array(held, bool), sizes)], minlength=len(u))
        frequent = np.argsort(-np.bincount(token, minlength=len(u)), kind="stable")
        rank = np.empty(len(frequent), np.int64)
        rank[frequent] = np.arange(len(frequent))
        body = squeezed(sizes, frequent.astype("<u4"), rank[token].astype("<u4"))
        words = bundle(u[dealt], v[dealt], trained.astype("<u4"))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([words], pa.binary()), pa.array([body], pa.binary())], names=["chunk", "doc_ids", "held_out", "words", "tokens"])

    def run(batches):
        ids, held, parts, size = [], [], [], 0
        number = TaskContext.get().partitionId() << 32
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            flat = []
            for k in (2, 3):
                column = batch.column(k)
                flat.append((column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)))
            for i, (d, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids.append(d)
                held.append(h)
                parts.append([np.append(f[o[i] : o[i + 1]], np.uint64(e)) for (o, f), e in zip(flat, END, strict=True)])
                size += len(parts[-1][0])
                if size >= CHUNK:
                    yield close(ids, held, parts, number, id_type)
                    ids, held, parts, size, number = [], [], [], 0, number + 1
        if ids:
            yield close(ids, held, parts, number, id_type)

    return map_arrow(rows, run, f"chunk long, doc_ids array<{kind}>, held_out array<boolean>, words binary, tokens binary")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _cuts(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(shard, range) for each run of equal numbers."""
    if not len(shard):
        return
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    for a, b in zip(cut, [*cut[1:], len(shard)], strict=True):
        yield int(shard[a]), slice(a, b)


def _word_shards(a: np.ndarray, n: int) -> np.ndarray:
    """Shards of words that are sorted by their mixed hash: ranges of it, in order."""
    return ((_mix(a) >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


class Grams:
    """The different n-grams of a chunk whose context is known, in the order in which they are asked for: by shard, context and word."""

    def __init__(self, have: np.ndarray, context: np.ndarray, word: np.ndarray, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, train: np.ndarray, n_shards: int):
        """Per token: whether it asks, and the ranks of its context and word; then the numbers of contexts and words and
        the contexts' counts, by rank, in which numbers rise; and which tokens train."""
        self.tokens = np.flatnonzero(have)
        key, first, place = distinct(context[self.tokens] * len(words) + word[self.tokens])
        c, w = np.divmod(key, max(1, len(words)))
        context_number, word_number, context_count = contexts[c], words[w], counts[c]
        trained = np.bincount(place[train[self.tokens]], minlength=len(key))
        shard = (_mix(np.where(context_count >= HOT, context_number ^ _mix(word_number), context_number)) % np.uint64(n_shards)).astype(np.uint16 if n_shards <= 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.place, self.first, self.shard = back[place], self.tokens[first][order], shard[order]
        self.context, self.word, self.context_count, self.counts = context_number[order], word_number[order], context_count[order], trained[order]

    def requests(self, lower: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(shard, packed request) with the codes of the lower order's probabilities, given by token."""
        code = code_of(lower[self.first])
        for shard, at in _cuts(self.shard):
            c = self.context[at]
            new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            sizes = np.diff(np.append(new, len(c)))
            yield shard, squeezed(_steps(c[new]), sizes.astype("<u4"), self.word[at], self.counts[at].astype("<u4"), code[at], self.context_count[at][new].astype("<u8"))

    def answers(self, got: dict[int, bytes]) -> list[np.ndarray]:
        """Arrays of the answers, by n-gram."""
        parts = [unsqueezed(got[shard]) for shard, _ in _cuts(self.shard)]
        for x in parts:
            if len(x) == 3:  # places, of those that are contexts of the next level
                places = np.zeros(len(x[0]), np.int64)
                places[x[1] >= LEAST_CONTEXT] = np.cumsum(x[2])
                x[2] = places
        return [np.concatenate(x) for x in zip(*parts, strict=True)]


class Chunk:
    """A row of chunks with what the shards have answered so far."""

    def __init__(self, row: dict, answers: dict[int, dict[int, bytes]], stats: tuple[int, int], shards: tuple[int, int, int]):
        self.sizes, frequent, tokens = unsqueezed(row["tokens"])
        self.ends = np.cumsum(self.sizes.astype(np.int64))
        self.tokens = frequent.astype(np.int64)[tokens]
        self.train = np.repeat(~np.array(row["held_out"], bool), self.sizes)
        self.shards = shards
        if 1 in answers:
            self._unigrams(answers[1], *stats)
        if 2 in answers:
            self._bigrams(answers[2])
        if 3 in answers:
            self._raise(self.trigrams.answers(answers[3])[0] if len(self.trigrams.word) else np.zeros(0, np.uint16), self.trigrams)

    def _unigrams(self, got: dict[int, bytes], n: int, v: int) -> None:
        counts, numbers = [], []
        for shard in sorted(got):
            c, rank = unsqueezed(got[shard])
            counts.append(c.astype(np.int64))
            numbers.append(rank.astype(np.uint64) * np.uint64(self.shards[0]) + np.uint64(shard + 1))
        count, number = np.concatenate(counts), np.concatenate(numbers)
        self.known = (count > 0)[self.tokens]
        self.base = np.log10((count + ALPHA) / (n + ALPHA * (v + 1)))[self.tokens]
        self.score = self.base.copy()
        order = ordered(number)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        starts = count[self.tokens[self.ends[0] - 1]]  # as many texts start as end
        self.numbers, contexts = np.concatenate([[np.uint64(START)], number[order]]), np.concatenate([[starts], count[order]])
        self.word = rank[self.tokens]
        self.first = np.concatenate([[0], self.ends[:-1]])
        before = np.roll(self.word, 1)
        before[self.first] = 0
        self.context_count = contexts[before]
        self.bigrams = Grams(self.context_count >= LEAST_CONTEXT, before, self.word, self.numbers, self.numbers, contexts, self.train, self.shards[1])

    def _raise(self, codes: np.ndarray, grams: Grams) -> None:
        """Raises the order of the scores: what the trie has, else the backed-off probability."""
        if not len(grams.tokens):
            return
        t = grams.tokens
        code = codes[grams.place]
        backed = self.score[t] + np.log10(PRIOR / (self.context_count[t] + PRIOR))
        self.score[t] = np.where(code > 0, log_of(code), backed)

    def _bigrams(self, got: dict[int, bytes]) -> None:
        g = self.bigrams
        codes, counts, places = g.answers(got) if len(g.word) else (np.zeros(0, np.uint16), np.zeros(0, np.uint16), np.zeros(0, np.int64))
        self._raise(codes, g)
        count = np.where(codes > 0, np.rint(count_of(counts)), 0).astype(np.int64)
        node = places.astype(np.uint64) * np.uint64(self.shards[1]) + g.shard.astype(np.uint64)
        order = ordered(node)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # the bigram that ends at the token before is the context of this one
        context, seen = np.zeros(len(self.word), np.int64), np.zeros(len(self.word), np.int64)
        context[g.tokens], seen[g.tokens] = rank[g.place], count[g.place]
        context, seen = np.roll(context, 1), np.roll(seen, 1)
        seen[self.first] = 0
        self.context_count = seen
        self.trigrams = Grams(seen >= LEAST_CONTEXT, context, self.word, node[order], self.numbers, count[order], self.train, self.shards[2])


SCHEMA = "shard int, chunk long, body binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    pa.default_memory_pool().release_unused()  # what the group before left over: a worker has many of them
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([r[1] for r in rows], pa.int64()), "body": pa.array([r[2] for r in rows], pa.binary())})


def word_answers(table: DataFrame, n_shards: int) -> DataFrame:
    """shard, chunk, body, total, different: training counts and numbers of the words that a chunk asked for, and on a shard's first row its sums."""

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b, trained = unbundle(r["words"])
                for shard, at in _cuts(_word_shards(a, n_shards)):
                    yield _batch([(shard, r["chunk"], squeezed(a[at], b[at], trained[at]))]).to_batches()[0]

    def answer(t: pa.Table) -> pa.Table:
        asked = [unsqueezed(x) for x in t.column("body").to_pylist()]
        a, b, inverse = _unique128(np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked]))
        total = np.bincount(inverse, np.concatenate([x[2] for x in asked]), len(a)).astype(np.int64)
        # frequent words have small numbers, which pack well
        order = np.lexsort((b, a, -total))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        own = np.split(inverse, np.cumsum([len(x[0]) for x in asked])[:-1])
        out = _batch([(t.column("shard")[0].as_py(), c, squeezed(total[i].astype("<u8"), number[i].astype("<u4"))) for c, i in zip(t.column("chunk").to_pylist(), own, strict=True)])
        rest = [0] * (len(own) - 1)
        return out.append_column("total", pa.array([int(total.sum()), *rest], pa.int64())).append_column("different", pa.array([int((total > 0).sum()), *rest], pa.int64()))

    asked = map_arrow(table.select("chunk", "words"), ask, SCHEMA)
    return asked.groupBy("shard").applyInArrow(answer, SCHEMA + ", total long, different long")


def gram_level(asked: list[list[np.ndarray]]) -> bytes:
    """A shard of a level of all chunks' requests: n-grams that any of them has in training."""
    context, _, rank = distinct(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked]))
    rank = np.repeat(rank, np.concatenate([x[1] for x in asked]))
    word, counts, code = (np.concatenate([x[k] for x in asked]) for k in (2, 3, 4))
    held = np.concatenate([np.repeat(x[5], x[1]) for x in asked])
    bits = np.uint64(int(word.max()).bit_length() if len(word) else 0)  # no more than there are: see ordered
    key = (rank.astype(np.uint64) << bits) | word
    some = np.flatnonzero(counts)
    order = some[ordered(key[some])]
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(order) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    context, word = context[(key[at] >> bits).astype(np.int64)], key[at] & np.uint64((1 << int(bits)) - 1)
    p = smoothed(total, held[order][at].astype(float), 10.0 ** log_of(code[order][at]))
    return Level.pack(context, word, code_of(np.minimum(p, 1.0)), count_code(total))


def gram_answers(requests: DataFrame, order: int) -> DataFrame:
    """shard, chunk, body: codes of the n-grams that a chunk asked for; of order 2 also their counts and places."""

    def answer(t: pa.Table) -> pa.Table:
        asked = [unsqueezed(x) for x in t.column("body").to_pylist()]
        level = Level(gram_level(asked))
        out = []
        for chunk, x in zip(t.column("chunk").to_pylist(), asked, strict=True):
            at = level.look_up(np.cumsum(x[0], dtype=np.uint64), x[1], x[2])
            there, at = at >= 0, np.maximum(at, 0)
            codes = np.where(there, level.codes[at], 0).astype("<u2") if len(level.codes) else np.zeros(len(at), "<u2")
            if order == 2:
                counts = np.where(there, level.counts[at], 0).astype("<u2") if len(level.counts) else codes
                out.append((t.column("shard")[0].as_py(), chunk, squeezed(codes, counts, _steps(at[counts >= LEAST_CONTEXT]).astype("<i8"))))
            else:
                out.append((t.column("shard")[0].as_py(), chunk, squeezed(codes)))
        return _batch(out)

    return requests.groupBy("shard").applyInArrow(answer, SCHEMA)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Null texts count as empty: their one token is the end. A null doc_id has
    the crc32 of the empty text. Rows that repeat a doc_id are texts of their
    own, in training too. An empty table gives an empty result; extra columns
    are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = staged(chunks(docs), "chunks")
    words = made.agg(F.sum(F.length("words"))).first()[0] or 0
    # different words of all chunks, in twenties of bytes: a measure of the n-grams that needs no unpacking
    shards = tuple(max(LEAST_SHARDS, int(words // 20 * k // SHARD)) for k in (1, *ASKED))
    by_word = staged(word_answers(made, shards[0]), "words")
    table = staged(made.drop("words"), "tokens")
    release(made)
    sums = by_word.agg(F.sum("total"), F.sum("different")).first()
    stats = (sums[0] or 0, sums[1] or 0)
    n = stats[0]

    def opened(left: pa.Table, right: pa.Table, levels: int) -> Chunk:
        """A chunk with the answers of so many levels; one without any n-gram of this chunk has none."""
        answers: dict[int, dict[int, bytes]] = {level: {} for level in range(1, levels + 1)}
        for level, shard, body in zip(*(right.column(c).to_pylist() for c in ("level", "shard", "body")), strict=True):
            answers[level][shard] = body
        return Chunk(left.select(["held_out", "tokens"]).to_pylist()[0], answers, stats, shards)

    def requests(level: int, answers: DataFrame) -> DataFrame:
        def ask(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _batch([])
            c = opened(left, right, level - 1)
            grams = c.bigrams if level == 2 else c.trigrams
            number = left.column("chunk")[0].as_py()
            return _batch([(shard, number, body) for shard, body in grams.requests(10.0**c.score)])

        own = table.select("chunk", "held_out", "tokens")
        return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, SCHEMA)

    ship(docs.sparkSession)
    answers = by_word.select("chunk", F.lit(1).alias("level"), "shard", "body")
    for level in (2, 3):
        # what the third level's requests are made of is shuffled, and gone before they are: the most that lies on disk at a time
        asked = requests(level, answers) if level == 2 else staged(requests(level, answers), "asked")
        got = staged(gram_answers(asked, level), f"level{level}")
        release(asked)
        answers = answers.unionByName(got.select("chunk", F.lit(level).alias("level"), "shard", "body"))

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            kinds = {"doc_id": left.schema.field("doc_ids").type.value_type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        c = opened(left, right, 3)
        def each(x):
            return np.add.reduceat(x, c.first)
        return pa.table({
            "doc_id": left.column("doc_ids").combine_chunks().flatten(), "held_out": left.column("held_out").combine_chunks().flatten(), "n_tokens": pa.array(c.sizes.astype(np.int64)),
            "n_known": pa.array(each(c.known.astype(np.int64))), "train_tokens": pa.array([n] * len(c.sizes), pa.int64()), "base_score": pa.array(each(c.base)), "score": pa.array(each(c.score)),
        })

    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
