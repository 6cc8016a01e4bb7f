"""Near-duplicates by SimHash with bit-sliced comparison.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a
text's word shingles. Fingerprints that differ in few bits agree in some of the
parts that they are cut into, so each distinct fingerprint is dealt into one
bucket for every choice of parts that must agree; rows of one bucket are
compared. For that the fingerprints of a block stand as bit planes, 64 of them
in a word: one exclusive or compares a bit of a fingerprint with that of 64
others, carry-save counters add up 64 distances at once, and a word of 64 goes
as soon as all its distances exceed the radius.

Buckets of more than BLOCK fingerprints are cut into finer ones by the bits
that the bucket leaves open, and what is still larger is compared in pairs of
blocks, so no task holds more than two blocks of a bucket. A task gives back a
tree of what it found linked, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.plans.graph import components
from noticeflow.runtime import map_arrow, maybe_broadcast, release, ship, staged

SHINGLE, RADIUS, BITS, SEED = 3, 2, 64, 42
BLOCK, BIN, JOBS = 4096, 20_000, 1 << 15
PIECE = 1 << 16
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``size`` words of a text in UTF-8, A-Z lower-cased; of all its words if it has fewer."""
    words = text.translate(_LOWER).split()  # bytes split at 0x20 and 0x09 to 0x0D
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    runs = words if size == 1 else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.fromiter((digest(r, SEED) for r in runs), np.uint64, len(words) - size + 1)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    count = np.zeros(BITS, np.int64)
    for a in range(0, len(h), PIECE):
        part = h[a : a + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row; null texts count as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = [majority(shingle_hashes(t.as_py() or b"", shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, f"doc_id {kind}, fp long")


def _fields(bits: list[int], parts: int) -> list[list[int]]:
    """The bit numbers cut into so many runs of about equal length."""
    ends = [len(bits) * k // parts for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    """A signed 64-bit mask of bits."""
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def choices(radius: int) -> list[list[int]]:
    """Sets of bits one of which has no difference where at most ``radius`` bits differ: all pairs of radius + 2 parts."""
    return [[*a, *b] for a, b in combinations(_fields(list(range(BITS)), radius + 2), 2)]


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words: bit i of word w of plane b is bit b of fingerprint 64 * w + i."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def close_words(planes_: np.ndarray, masks: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(job, lanes) of those jobs of which lanes are within the radius.

    A job compares the fingerprint ``query`` with the 64 of ``word`` as far as ``lanes`` has them; masks
    (64, n) is all ones where a fingerprint has a bit. Counters have a plane for each bit of a distance
    up to the radius, and one for what is over it.
    """
    job = np.arange(len(query))
    width = radius.bit_length()
    count = np.zeros((width, len(job)), np.uint64)
    over = ~lanes
    for k, bit in enumerate(order):
        carry = planes_[bit][word[job]] ^ masks[bit][query[job]]
        for j in range(width):
            count[j], carry = count[j] ^ carry, count[j] & carry
        over = over | carry
        # a distance over the radius that the counters still hold is over for good
        if k % 4 == 3 or k == len(order) - 1:
            over = over | _exceeds(count, radius)
            alive = over != _ONES
            if not alive.all():
                job, over, count = job[alive], over[alive], count[:, alive]
                if not len(job):
                    break
    return job, ~over


def _exceeds(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is greater than the radius, by comparing from the highest bit."""
    more, same = np.zeros(count.shape[1], np.uint64), np.full(count.shape[1], _ONES)
    for j in range(len(count) - 1, -1, -1):
        if radius >> j & 1:
            same = same & count[j]
        else:
            more, same = more | (same & count[j]), same & ~count[j]
    return more


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, lanes) of a job for every row and word of lanes lo .. hi - 1."""
    some = np.flatnonzero(hi > lo)
    first, last = lo[some] // 64, (hi[some] - 1) // 64
    n = last - first + 1
    row = np.repeat(some, n)
    word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    from_, to = np.maximum(lo[row] - 64 * word, 0), np.minimum(hi[row] - 64 * word, 64)
    lanes = (_ONES << from_.astype(np.uint64)) & (_ONES >> (64 - to).astype(np.uint64))
    return row, word, lanes


def linked(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The least row that each row is connected with by links; row i is compared with rows lo[i] .. hi[i] - 1."""
    root = np.arange(len(fps))
    p = planes(fps)
    m = np.where((fps[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1), _ONES, np.uint64(0))
    order = np.argsort(-np.minimum(x := np.array([int(np.bitwise_count(q).sum()) for q in p]), len(fps) - x), kind="stable").tolist()  # bits that tell most first
    ends = np.cumsum(np.where(hi > lo, (hi - 1) // 64 - lo // 64 + 1, 0))
    start = 0
    while start < len(fps):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + JOBS, "right")))
        row, word, lanes = _spread(lo[start:stop], hi[start:stop])
        row += start
        job, hit = close_words(p, m, row, word, lanes, radius, order)
        if len(job):
            which, lane = np.nonzero(np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            _join(root, row[job][which], 64 * word[job][which] + lane)
        start = stop
    return root


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts the rows that the links a - b connect under their least row."""
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low < high
        if not apart.any():
            return
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _within(table: pa.Table, radius: int) -> pa.Table:
    """u, v: links that join what the tasks of a bin find connected. A task's rows are compared with each
    other (one block), or the rows of its left block with those of its right one."""
    columns = [table.column(c).to_numpy() for c in ("task", "side", "fp")]
    order = np.lexsort((columns[2], columns[1], columns[0]))
    task, side, fp = (c[order] for c in columns)
    fp = fp.view(np.uint64)
    new = np.flatnonzero(np.append(True, task[1:] != task[:-1])) if len(task) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(task)))
    start, end = np.repeat(new, size), np.repeat(new + size, size)
    left = np.repeat(np.add.reduceat((side < 2).astype(np.int64), new), size) if len(new) else side
    at = np.arange(len(task))
    # side 0: the only block of its task; 1 and 2: the left and the right of two
    lo = np.where(side == 0, at + 1, start + left)
    root = linked(fp, lo, np.where(side == 2, lo, end), radius)
    more = root != at
    return pa.table({"u": pa.array(fp[more].view(np.int64)), "v": pa.array(fp[root[more]].view(np.int64))})


def _buckets(distinct: DataFrame, sets: list[list[int]]) -> DataFrame:
    """table, key, fp: the bucket of each fingerprint for each set of bits."""
    keys = F.array(*(F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("key")) for k, s in enumerate(sets)))
    return distinct.select("fp", F.explode(keys).alias("b")).select("b.table", "b.key", "fp")


def _sized(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` of buckets of more than one, with size. Both sides of the join are staged, so that a large bucket can be split."""
    sizes = staged(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    return rows.join(sizes, list(by))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links between fingerprints (distinct fp) within the radius, enough of them to join all that such links join."""
    sets = choices(radius)
    first = staged(_buckets(distinct, sets), "buckets")
    sized = staged(_sized(first, "table", "key"), "sized")
    name = lambda *c: F.xxhash64(F.lit(BLOCK), *c)
    # in a large bucket the differences are among the open bits: one of radius + 1 parts of them agrees
    finer = []
    for k, s in enumerate(sets):
        for j, part in enumerate(_fields([b for b in range(BITS) if b not in s], radius + 1)):
            finer.append(F.when(F.col("table") == k, F.struct(F.lit(j).alias("piece"), F.col("fp").bitwiseAND(F.lit(_mask(part))).alias("value"))))
    large = sized.filter(F.col("size") > BLOCK).drop("size")
    split = large.select("table", "key", "fp", F.explode(F.filter(F.array(*finer), lambda x: x.isNotNull())).alias("p")).select("table", "key", "p.*", "fp")
    split = staged(split, "finer")
    small = sized.filter(F.col("size") <= BLOCK).select(name("table", "key").alias("bucket"), "fp", "size")
    every = small.unionByName(_sized(split, "table", "key", "piece", "value").select(name("table", "key", "piece", "value").alias("bucket"), "fp", "size"))
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    each = every.select("bucket", "fp", parts.alias("parts")).withColumn("own", F.pmod(F.xxhash64("fp", "bucket"), "parts").cast("int"))
    # a task for each two parts of a bucket and one for each part alone
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    tasks = each.select("bucket", "fp", "own", F.explode(other).alias("with"))
    tasks = tasks.select("fp", F.xxhash64("bucket", F.least("own", "with"), F.greatest("own", "with")).alias("task"), F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2).alias("side"))
    tasks = staged(tasks, "tasks")
    bins = max(1, tasks.count() // BIN)  # a bin has many small tasks
    ship(distinct.sparkSession)
    found = tasks.withColumn("bin", F.pmod("task", F.lit(bins))).groupBy("bin").applyInArrow(lambda t: _within(t, radius), "u long, v long")
    found = staged(found.distinct(), "links")
    release(first, sized, split, tasks)
    return found


def simhash(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for each row of ``docs``.

    component_id is the least doc_id that can be reached over links between
    fingerprints of at most ``radius`` differing bits. Null and empty texts and
    texts without words have fingerprint zero and are linked like any other.
    A text of fewer words than a shingle is one shingle. Rows that repeat a
    doc_id have a row each; component_id is null where no row of a component
    has an id. An empty table gives an empty result; extra columns are ignored.
    """
    each = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = staged(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = links(distinct.select("fp"), radius)
    labels = components(found)
    named = staged(distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labels")
    least = staged(named.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    of_fp = staged(named.join(least, "label").select("fp", "component_id"), "classes")
    release(distinct, found, labels, named, least)
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(maybe_broadcast(of_fp), "fp").select("doc_id", hex_.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, that of the least doc_id, with all its columns as they are, whatever their names;
    of rows that share it the first by fingerprint and number of the row."""
    rows = staged(docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("given"), "text").withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    found = simhash(rows.select("doc_id", "text"), shingle, radius)
    best = F.min(F.struct(F.col("given").isNull().alias("none"), "given", "fingerprint", "doc_id"))
    kept = staged(rows.select("doc_id", "given").join(found, "doc_id").groupBy("component_id").agg(best.alias("best")).select(F.col("best.doc_id").alias("doc_id")), "kept")
    return rows.join(maybe_broadcast(kept), "doc_id", "left_semi").select("row.*")
