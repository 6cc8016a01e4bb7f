"""Near-duplicates by improved consistent weighted sampling.

A text is a weighted set of five-word shingles; a weight is the shingle's
count times its inverse document frequency. Consistent samples of the weighted
set, in bands, bring similar texts into one bucket. In a bucket the most
central texts (those whose buckets are the fullest) are compared with the
others first, which joins most classes at a cost in proportion to the bucket's
size; then all pairs of a bucket that are still apart are compared, block by
block. Every comparison is a weighted Jaccard similarity over all shingles.
Classes are the connected components of the links.

Document frequencies are counted over all documents, by shingle. Samples are
drawn by a table of a fixed number of cells, chosen by hash, whose size does
not grow with the input; comparisons take each shingle's own frequency, which
is looked up for the texts that are compared.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import packed, unpacked
from noticeflow.llm.decontam import words
from noticeflow.plans.graph import components
from noticeflow.runtime import map_arrow, maybe_broadcast, release, ship, staged

SHINGLE, SIMILAR = 5, 0.8
CELLS = 1 << 20
PART, FLUSH, CHUNK = 1 << 20, 1 << 18, 8 << 20
PIECE = 1 << 16  # words of texts that are worked on at once, but for longer texts
BANDS, ROWS = 20, 4
DRAWS = 1 << 14
CENTRES, SHARE = 4, 1000
BLOCK, BLOCK_BYTES = 1000, 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _node(text: Column, words_: Column) -> Column:
    """16 bytes: equal for texts of equal words; of texts without words, for equal texts."""
    return F.unhex(F.md5(F.when(F.size(words_) > 0, F.array_join(words_, " ")).otherwise(F.concat(F.lit("\x00"), text))))


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text as it is), node and word hashes."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words(F.col("text")))
    return d.select("doc_id", F.xxhash64("text").alias("th"), _node(F.col("text"), F.col("words")).alias("node"), F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each row's word hashes, sorted by row and hash.

    A text of one to four words has one shingle, of all its words.
    """
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
    offsets = offsets.astype(np.int64) - offsets[0]
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - offsets[row]
    start = np.nonzero(place <= np.maximum(size[row] - SHINGLE, 0))[0]
    h = np.zeros(len(start), np.uint64)
    for j in range(SHINGLE):
        at = start + j
        inside = at < offsets[row[start] + 1]
        h = np.where(inside, _mix(h * _ODD + flat[np.minimum(at, len(flat) - 1)] + np.uint64(j + 1)), h)
    owner = row[start]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.nonzero(new)[0]
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    """Weight, between 1 and 2, of what df of n rows hold."""
    return 1.0 + np.maximum(0.0, np.log((n + 1.0) / (df + 1.0))) / np.log(n + 2.0)


def _summed(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their counts."""
    order = np.argsort(h)
    h, count = h[order], count[order]
    at = np.nonzero(np.append(True, h[1:] != h[:-1]))[0] if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(count, at) if len(at) else count


def part_bits(chars: int) -> int:
    """Leading bits of a hash that name its part, so that a part has about PART of a corpus of so many
    characters; 4 at least and 20 at most (10^13 shingles), as many as cells have."""
    return min(20, max(4, (chars // 6 // PART).bit_length()))


def _parts(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, bounds) of the parts that sorted hashes have, bounds with one more at the end."""
    part = (h >> np.uint64(64 - bits)).astype(np.int64)
    at = np.nonzero(np.append(True, part[1:] != part[:-1]))[0] if len(h) else np.zeros(0, np.int64)
    return part[at], np.append(at, len(h))


def _blobs(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def frequencies(base: DataFrame, bits: int) -> DataFrame:
    """part, hashes, dfs, cells: by ranges of hashes the frequency over all rows of each shingle that more
    than one row has (all others have 1), and of the cells."""

    def count(batches):
        held, size = [], 0
        for b in batches:
            for part in _slices(b.column(0)):
                _, h, _ = shingles(part)
                held.append(h)
                size += len(h)
                if size >= FLUSH:
                    yield dealt(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield dealt(np.concatenate(held))

    def dealt(h):
        h, df = _summed(h, np.ones(len(h), np.int64))
        some, ends = _parts(h, bits)
        hs, ds = ([x[a:b].astype(t).tobytes() for a, b in zip(ends, ends[1:], strict=False)] for x, t in ((h, "<u8"), (df, "<u4")))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(hs, pa.binary()), pa.array(ds, pa.binary())], names=["part", "hashes", "dfs"])

    def add(table: pa.Table) -> pa.Table:
        h, df = _summed(_blobs(table.column("hashes"), "<u8"), _blobs(table.column("dfs"), "<u4").astype(np.int64))
        width = CELLS >> bits
        cells = np.bincount(_cell(h) & (width - 1), df, minlength=width)
        h, df = h[df > 1], df[df > 1]
        return pa.table({"part": table.column("part").slice(0, 1), "hashes": pa.array([h.astype("<u8").tobytes()], pa.binary()), "dfs": pa.array([df.astype("<i8").tobytes()], pa.binary()), "cells": pa.array([cells.astype("<i8").tobytes()], pa.binary())})

    found = map_arrow(base.select("wh"), count, "part int, hashes binary, dfs binary")
    return found.groupBy("part").applyInArrow(add, "part int, hashes binary, dfs binary, cells binary")


def idf_table(freq: DataFrame, n: int, bits: int) -> np.ndarray:
    """Weight of each cell; a row counts once for each of its shingles in the cell. The cells come to the driver: 8 MB, whatever the input."""
    df = np.zeros((1 << bits, CELLS >> bits), np.int64)
    for r in freq.select("part", "cells").collect():
        df[r.part] = np.frombuffer(r.cells, "<i8")
    return _idf(n, df.ravel()).astype(np.float32)


@lru_cache(1)
def _draws() -> tuple[np.ndarray, ...]:
    """Per sample and draw: 1 / r, r, beta and ln c - r, where r and c are Gamma(2, 1) and beta is uniform."""
    rng = np.random.RandomState(20240101)
    shape = (BANDS * ROWS, DRAWS)
    r, c, beta = rng.gamma(2.0, 1.0, shape), rng.gamma(2.0, 1.0, shape), rng.uniform(0.0, 1.0, shape)
    odd = rng.randint(0, 1 << 62, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return (1 / r).astype(np.float32), r.astype(np.float32), beta.astype(np.float32), (np.log(c) - r).astype(np.float32), odd


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows, BANDS * ROWS) consistent samples: a hash of the chosen shingle and its level. Rows without shingles have 0."""
    inv, r, beta, lead, odd = _draws()
    out = np.zeros((n_rows, BANDS * ROWS), np.uint64)
    if not len(row):
        return out
    first = np.nonzero(np.append(True, row[1:] != row[:-1]))[0]
    owners, length = row[first], np.diff(np.append(first, len(row)))
    lw = np.log(weight).astype(np.float32)
    for k in range(BANDS * ROWS):
        i = ((h * odd[k]) >> np.uint64(50)).view(np.int64)
        b = beta[k].take(i, mode="clip")
        t = np.floor(lw * inv[k].take(i, mode="clip") + b)
        value = lead[k].take(i, mode="clip") - r[k].take(i, mode="clip") * (t - b)
        least = np.minimum.reduceat(value, first)
        at = np.nonzero(value == np.repeat(least, length))[0]
        at = at[np.append(True, row[at][1:] != row[at][:-1])]  # of ties the least hash: rows are sorted by it
        out[owners, k] = _mix(h[at] ^ (t[at].astype(np.int64).view(np.uint64) * _ODD))
    return out


def bands(sampled: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes of ROWS samples each, apart for each band."""
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sampled), 1))
    for j in range(ROWS):
        h = _mix(h * _ODD + sampled[:, j::ROWS])
    return h


def _cuts(column: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows of about PIECE words, and of 1000 rows at most."""
    ends = column.offsets.to_numpy()[1:].astype(np.int64)
    start, out = 0, []
    base = int(column.offsets[0].as_py()) if len(column) else 0
    while start < len(ends):
        stop = min(max(start + 1, int(np.searchsorted(ends, base + PIECE, "right"))), start + 1000)
        out.append((start, stop))
        start, base = stop, int(ends[stop - 1])
    return out


def _slices(column: pa.Array):
    for a, b in _cuts(column):
        yield column.slice(a, b - a)


def _pieces(batches, column: str):
    for batch in batches:
        k = batch.schema.names.index(column)
        for a, b in _cuts(batch.column(k)):
            part = batch.slice(a, b - a)
            yield part, *shingles(part.column(k))


def signatures(base: DataFrame, idf: np.ndarray) -> DataFrame:
    """rid, doc_id, th, node, bands (empty for texts without words) for each row."""
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, row, h, count in _pieces(batches, "wh"):
            b = bands(samples(row, h, count * idf[_cell(h)], part.num_rows))
            has = np.zeros(part.num_rows, bool)
            has[row] = True
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32()), pa.array(b[has].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.select(["rid", "doc_id", "th", "node"]).columns, values], names=["rid", "doc_id", "th", "node", "bands"])

    return map_arrow(base.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "th", "node", "wh"), run, f"rid long, doc_id {kind}, th long, node binary, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes, counts (little-endian arrays) of the wanted nodes, whose texts are picked by their
    hash before they are cut into words."""

    def run(batches):
        for part, row, h, count in _pieces(batches, "wh"):
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            hs = [h[a:b].astype("<u8").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            cs = [count[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hs, pa.binary()), pa.array(cs, pa.binary())], names=["node", "hashes", "counts"])

    picked = docs.select("doc_id", "text").withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).join(maybe_broadcast(wanted), "th", "left_semi")
    return map_arrow(nodes(picked).select("node", "wh"), run, "node binary, hashes binary, counts binary").dropDuplicates(["node"])


def _frequency(h: np.ndarray, known: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Frequencies of h by the sorted known hashes; 1 where it is not among them."""
    if not len(known):
        return np.ones(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, df[at], 1)


def _weighted(sets: DataFrame, freq: DataFrame, n: int, bits: int) -> DataFrame:
    """node, hashes, weights, total of the sets: count times the idf of the shingle's own frequency, and their sum.

    Sets are dealt into chunks of about CHUNK bytes of hashes; a chunk asks each part of ``freq`` once.
    """
    chunks = max(1, -(-(sets.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // CHUNK))
    s = sets.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks)))

    def ask(table: pa.Table) -> pa.Table:
        h = np.unique(_blobs(table.column("hashes"), "<u8"))
        some, ends = _parts(h, bits)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int64()), "part": pa.array(some, pa.int32()), "hashes": pa.array([h[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        """Of what a chunk asked for the hashes that more than one row has, and their frequencies."""
        h, df = _blobs(known.column("hashes"), "<u8"), _blobs(known.column("dfs"), "<i8")
        hs, got = [], []
        for x in asked.column("hashes").to_pylist():
            x = np.frombuffer(x, "<u8")
            f = _frequency(x, h, df)
            hs.append(x[f > 1].tobytes())
            got.append(f[f > 1].tobytes())
        return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), "hashes": pa.array(hs, pa.binary()), "dfs": pa.array(got, pa.binary())})

    def weigh(sets_: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        h, df = _blobs(answers.column("hashes"), "<u8"), _blobs(answers.column("dfs"), "<i8")
        weights = []
        for x, c in zip(sets_.column("hashes").to_pylist(), sets_.column("counts").to_pylist(), strict=True):
            weights.append((np.frombuffer(c, "<u4") * _idf(n, _frequency(np.frombuffer(x, "<u8"), h, df))).astype("<f8").tobytes())
        total = [float(np.frombuffer(w, "<f8").sum()) for w in weights]
        return pa.table({"node": sets_.column("node"), "hashes": sets_.column("hashes"), "weights": pa.array(weights, pa.binary()), "total": pa.array(total, pa.float64())})

    ship(sets.sparkSession)
    asked = s.groupBy("chunk").applyInArrow(ask, "chunk long, part int, hashes binary")
    known = freq.select("part", "hashes", "dfs")
    answers = staged(asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(lambda a, k: answer(a, k), "chunk long, part int, hashes binary, dfs binary"), "answers")
    out = staged(s.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda x, a: weigh(x, a), "node binary, hashes binary, weights binary, total double"), "sets")
    release(answers)
    return out


def _weights(h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(h, "<u8"), np.frombuffer(w, "<f8")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, similarity of the pairs (u, v)."""

    def run(batches):
        for b in (batch.slice(a, 100) for batch in batches for a in range(0, batch.num_rows, 100)):
            out = []
            for ha, ca, hb, cb in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                (x, wx), (y, wy) = _weights(ha, ca), _weights(hb, cb)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = y[at] == x
                least = np.minimum(wx[both], wy[at[both]]).sum()
                out.append(float(least / (wx.sum() + wy.sum() - least)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["u", "v", "similarity"])

    a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("hu"), F.col("weights").alias("cu"))
    c = sets.select(F.col("node").alias("v"), F.col("hashes").alias("hv"), F.col("weights").alias("cv"))
    joined = pairs.join(a, "u").join(c, "v").select("u", "v", "hu", "cu", "hv", "cv")
    return map_arrow(joined, run, "u binary, v binary, similarity double")


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, label) of the components that ``more`` links (u, v) make of those of ``labels``.

    The graph that is searched has the components as its nodes, so that what was found before is not gone through again.
    """
    of = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    ends = more.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    top = staged(components(ends.filter("u != v").distinct()).select(F.col("node").alias("own"), F.col("label").alias("top")), "classes")
    raised = labels.join(top, labels["label"] == top["own"], "left").select("node", F.coalesce("top", "label").alias("label"))
    new = top.join(labels.select("node"), top["own"] == labels["node"], "left_anti").select(F.col("own").alias("node"), F.col("top").alias("label"))
    return staged(raised.unionByName(new), "classes")


def links(docs: DataFrame, sigs: DataFrame, freq: DataFrame, n: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, similarity: links between distinct texts that are similar, enough of them to join every class of
    similar texts that share a bucket; node, label: the classes of those that have links)."""
    each = staged(sigs.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("bucket")), "buckets")
    full = staged(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "full")
    members = staged(each.join(full, "bucket"), "members")
    central = staged(members.groupBy("node").agg(F.sum("size").alias("central")), "central")
    release(each, full)
    ranked = members.join(central, "node")
    top = staged(_tops(ranked), "tops")
    placed = ranked.join(top, "bucket")
    first = placed.select("node", F.col("best")[0]["node"].alias("v")).filter("node != v").select(F.col("node").alias("u"), "v").distinct()
    pairs = staged(first, "pairs")
    # one text of each node that is compared with another or has others compared with it
    met = placed.select("node").union(placed.select(F.explode("best.node"))).distinct()
    texts = sigs.groupBy("node").agg(F.min("th").alias("th"))
    wanted = staged(texts.join(met, "node", "left_semi").select("th").distinct(), "wanted")
    counted = staged(_sets(docs, wanted), "sets")
    sets = _weighted(counted, freq, n, bits)
    release(counted)
    found = staged(_verified(pairs, sets).filter(F.col("similarity") >= SIMILAR), "links")
    labels = staged(components(found), "classes")

    own = placed.select("node", F.slice("best", 2, CENTRES - 1).alias("best"), F.col("central").alias("c"))
    later = own.select("node", "c", F.explode("best").alias("b")).filter(F.struct("b.central", "b.node") > F.struct("c", "node"))
    later = later.select(F.col("node").alias("u"), F.col("b.node").alias("v")).distinct()
    lu, lv = labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    later = later.join(lu, "u", "left").join(lv, "v", "left").filter(F.coalesce("lu", "u") != F.coalesce("lv", "v")).select("u", "v")
    later = staged(later.join(pairs, ["u", "v"], "left_anti"), "pairs")
    more = staged(_verified(later, sets).filter(F.col("similarity") >= SIMILAR), "links")
    labels = joined(labels, more)
    rest = staged(_rest(members, labels, sets), "links")
    labels = joined(labels, rest)
    release(sets, members, central, top, later, wanted, pairs)
    return found.unionByName(more).unionByName(rest), labels


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, similarity: links between texts of one bucket that ``labels`` has in different components.

    All such pairs are compared, each in the least of the buckets that it shares, but for those whose total
    weights are too far apart: a similarity is at most the less total over the greater one. A bucket is dealt
    into ranges of total weight, each a factor of 1 / SIMILAR wide, and these into blocks by hash; a task has
    two blocks of one range or of two that follow each other, and tasks whose texts are all joined are left
    out. Of the links that a task finds, those that join the same components are left out. Buckets of
    CENTRES + 1 texts have no pair without a centre.
    """
    m = members.filter(F.col("size") > CENTRES + 1).join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    span = F.floor(F.log("total") / -float(np.log(SIMILAR))).cast("long")
    m = m.join(sets.select("node", F.octet_length("hashes").alias("bytes"), span.alias("span")), "node")
    apart = staged(m.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("bucket"), "apart")
    m = staged(m.join(apart, "bucket"), "open")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES))
    sizes = staged(m.groupBy("bucket", "span").agg(blocks.alias("blocks")), "spans")
    part = F.shiftleft("span", 32) + F.pmod(F.xxhash64("node", "bucket"), "blocks")
    dealt = staged(m.join(sizes, ["bucket", "span"]).select("bucket", "node", "label", "span", part.alias("part")), "dealt")
    each = staged(dealt.groupBy("bucket", "span", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "blocks")
    a, c = (each.select("bucket", *(F.col(x).alias(f"{x}_{k}") for x in ("span", "part", "lo", "hi"))) for k in "ij")
    tasks = a.join(c, "bucket").filter("part_i <= part_j AND span_j - span_i <= 1").filter(F.least("lo_i", "lo_j") != F.greatest("hi_i", "hi_j"))
    tasks = tasks.select("bucket", F.col("part_i").alias("i"), F.col("part_j").alias("j"))
    tasks = staged(tasks.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part")), "tasks")
    own = dealt.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, i, j = (k.as_py() for k in key)
        nodes_, part = table.column("node").to_pylist(), table.column("part").to_numpy()
        left, right = np.nonzero(part == i)[0], np.nonzero(part == j)[0]
        xs = [_weights(h, k) for h, k in zip(table.column("hashes").to_pylist(), table.column("weights").to_pylist(), strict=True)]
        total = np.array([w.sum() for _, w in xs])
        names: dict = {}
        comp = np.array([names.setdefault(x, len(names)) for x in table.column("label").to_pylist()])
        # the shared buckets below this one, padded with this one
        less = [[x for x in b if x < bucket] for b in table.column("buckets").to_pylist()]
        lower = np.full((len(xs), max(map(len, less)) + 1), bucket)
        for k, b in enumerate(less):
            lower[k, : len(b)] = b
        h, w = np.concatenate([xs[k][0] for k in right]), np.concatenate([xs[k][1] for k in right])
        owner = np.repeat(np.arange(len(right)), [len(xs[k][0]) for k in right])
        order = np.argsort(h, kind="stable")
        h, w, owner = h[order], w[order], owner[order]
        u, v, similarity = [], [], []
        for k in left:
            other = comp[right] != comp[k]
            if i == j:
                other &= right > k
            if less[k]:
                other &= ~np.isin(lower[right], less[k]).any(axis=1)
            if not other.any():
                continue
            x, wx = xs[k]
            start = np.searchsorted(h, x, "left")
            n = np.searchsorted(h, x, "right") - start
            at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            least = np.bincount(owner[at], np.minimum(np.repeat(wx, n), w[at]), minlength=len(right))
            alike = least / (total[k] + total[right] - least)
            for r in np.nonzero(other & (alike >= SIMILAR))[0]:
                if comp[right[r]] != comp[k]:
                    comp[comp == comp[right[r]]] = comp[k]
                    u.append(nodes_[k])
                    v.append(nodes_[right[r]])
                    similarity.append(float(alike[r]))
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()), "similarity": pa.array(similarity, pa.float64())})

    rows = dealt.join(tasks, ["bucket", "part"]).join(own, "node").join(sets, "node").select("bucket", "i", "j", "part", "node", "label", "buckets", "hashes", "weights")
    ship(rows.sparkSession)
    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "u binary, v binary, similarity double")


def _tops(ranked: DataFrame) -> DataFrame:
    """bucket, best: its most central members, at most CENTRES, the best first.

    A bucket is dealt into parts of about SHARE members by hash, the best of each part go on to the next
    level, and so forth until a bucket is one part: no task ever holds more of a bucket than a few parts.
    """
    best = F.slice(F.sort_array(F.collect_list(F.struct("central", "node")), asc=False), 1, CENTRES)
    level, left = ranked.select("bucket", "size", "central", "node"), ranked.agg(F.max("size")).first()[0] or 0
    while left > SHARE:
        parts = F.ceil(F.col("size") / SHARE)
        some = level.groupBy("bucket", "size", F.pmod(F.xxhash64("node", F.lit(left)), parts).alias("part")).agg(best.alias("best"))
        level = some.select("bucket", (F.ceil(F.col("size") / SHARE) * CENTRES).alias("size"), F.explode("best").alias("p")).select("bucket", "size", "p.*")
        left = -(-left // SHARE) * CENTRES
    return level.groupBy("bucket").agg(best.alias("best"))


def classes(docs: DataFrame) -> DataFrame:
    """rid, doc_id, th, node, class_id, class_size, kept for each row of ``docs`` (rid numbers the rows, kept is true once in each class)."""
    base = nodes(docs)
    n, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    bits = part_bits(chars)
    freq = staged(frequencies(base, bits), "frequencies")
    sigs = staged(signatures(base, idf_table(freq, n, bits)), "signatures")
    _, labels = links(docs, sigs, freq, n, bits)
    release(freq)
    labelled = sigs.select("rid", "doc_id", "th", "node").join(labels, "node", "left").select("rid", "doc_id", "th", "node", F.coalesce("label", "node").alias("label"))
    labelled = staged(labelled, "classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid")))
    groups = staged(labelled.groupBy("label").agg(best.alias("best"), F.count(F.lit(1)).alias("class_size")), "groups")
    return labelled.join(groups, "label").select("rid", "doc_id", "th", "node", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("best.rid")).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept for each row of ``docs``.

    Texts are alike where the weighted Jaccard similarity of their five-word
    shingles is 0.8 or more; class_id is the least doc_id of a class and that
    row stays. Null texts count as empty. Texts without any word are alike
    only if equal; a text of one to four words is one shingle. Rows that
    repeat a doc_id are classed each; class_id is null where no row of a class
    has an id. An empty table gives an empty result.
    """
    return classes(docs).drop("rid", "th", "node")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns as they are, whatever their names.

    The row that stays is the one with the least doc_id, as in ``near_dedup``;
    of rows that share doc_id and text any one. Null texts count as empty. An
    empty table gives an empty result.
    """
    each = staged(classes(docs).select("doc_id", "th", "node", "kept"), "kept")
    kept = each.groupBy("doc_id", "th", "node").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("kept")
    kept = staged(kept.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("node").alias("_node"), "n"), "kept")
    text = F.coalesce("text", F.lit(""))
    d = packed(docs).withColumns({"th": F.xxhash64(text), "node": _node(text, words(text))})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")) & (F.col("node") == F.col("_node"))
    once = unpacked(d.join(maybe_broadcast(kept.filter("n = 1")), same, "left_semi"))
    if kept.filter("n > 1").isEmpty():
        return once
    repeated = d.join(maybe_broadcast(kept.filter("n > 1")), same, "left_semi").dropDuplicates(["doc_id", "th", "node"])
    return once.unionByName(unpacked(repeated))
