"""Importance resampling towards a target corpus, over hashed n-gram buckets.

A text's features are its runs of 1 to n words. One scan of a text keeps a ring
of the zlib states of the last n starts: each word extends every state by a
space and itself, opens a state of its own, and every state that results is the
hash of a feature. What the scan emits are bucket numbers, two or four bytes
each, and they are written once; counts of the corpus, gains and weights come
from them, so no text is read again. Tables of buckets have a fixed number of
rows whatever the input. The draw is without replacement, by adding Gumbel
noise to the weights and taking the greatest sums.
"""

from __future__ import annotations

import math
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.runtime import map_arrow, release, staged

BUCKETS, NGRAM, LEAST_WORDS, SEED = 10_000, 2, 20, 7
#: A-Z lower-cased, all other ASCII but letters and digits as blanks; bytes of other code points as they are.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
OUT_BYTES = 4 << 20


def word_bytes(text: bytes) -> list[bytes]:
    """Runs of digits, letters and code points above 0x7F of a text in UTF-8, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def feature_hashes(words: list[bytes], n: int = NGRAM) -> np.ndarray:
    """crc32 of every run of 1 to n consecutive words, joined by spaces, in order of their last word, the longest first."""
    out, ring = array("I"), []
    for w in words:
        more = b" " + w
        ring = [crc32(more, state) for state in ring[-(n - 1) :]] if n > 1 else []
        ring.append(crc32(w))
        out.extend(ring)
    return np.frombuffer(out, np.uint32)


def features(df: DataFrame, buckets: int = BUCKETS, n: int = NGRAM, *keep: str) -> DataFrame:
    """The ``keep`` columns, n_words, n_features (long) and buckets (binary: little-endian integers of two
    bytes, or four where there are more than 65,536 buckets) for each row's text; null has no words."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    names = [*keep, "n_words", "n_features", "buckets"]

    def run(batches):
        for batch in batches:
            start, held, counts, size = 0, [], [], 0
            texts = batch.column(len(keep))
            for i in range(batch.num_rows):
                words = word_bytes(texts[i].as_py() or b"")
                held.append((feature_hashes(words, n) % buckets).astype(kind).tobytes())
                counts.append((len(words), len(held[-1]) // np.dtype(kind).itemsize))
                size += len(held[-1])
                if size >= OUT_BYTES or i == batch.num_rows - 1:
                    columns = [batch.column(k).slice(start, i + 1 - start) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)), pa.array(held, pa.binary())], names=names)
                    start, held, counts, size = i + 1, [], [], 0

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields)
    return map_arrow(df.select(*keep, F.col("text").cast("binary").alias("text")), run, f"{kept}n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket. A task adds up its own rows first: what is shuffled and what
    comes to the driver is a row per bucket at most."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    summed = map_arrow(found.filter("n_features > 0").select("buckets"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():  # a row per bucket, whatever the input
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in target and source, floored."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(found: DataFrame, gain: np.ndarray, *keep: str) -> DataFrame:
    """The ``keep`` columns, n_words, n_features, weight: the floored mean gain of a row's features, 0 for none."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches):
        for batch in batches:
            sums = [int(gain[np.frombuffer(raw.as_buffer(), kind)].sum()) for raw in batch.column(batch.num_columns - 1)]
            n = batch.column(len(keep) + 1).to_pylist()
            weight = pa.array([a // b if b else 0 for a, b in zip(sums, n, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], weight], names=[*keep, "n_words", "n_features", "weight"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in found.select(*keep).schema.fields)
    return map_arrow(found.select(*keep, "n_words", "n_features", "buckets"), run, f"{kept}n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """rid (a number of the row), doc_id, n_words, n_features, weight, score for each row of ``docs``.

    ``docs`` as a whole is the source; ``target`` needs a column text only.
    """
    own = staged(features(docs.select("doc_id", "text"), buckets, n, "doc_id"), "features")
    wanted = staged(features(target.select("text"), buckets, n), "target")
    gain = gains(bucket_counts(own, buckets), bucket_counts(wanted, buckets))
    found = _weights(own, gain, "doc_id").withColumn("rid", F.monotonically_increasing_id())
    scored = staged(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    release(own, wanted)
    return scored


def drawn(scored: DataFrame, percent: int, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with rank: 1, 2, ... of the floor(percent * N / 100) greatest scores of the N rows of
    least_words words or more, null for all others; ties go to the smaller doc_id (null last).

    The rows are range-partitioned in the order of the draw and a row's rank is its place in its
    partition plus the rows of those before it, so no task holds them all. The order ends with the
    row's number, by which rows that share score and doc_id spread too.
    """
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("rid")]
    ranged = scored.filter(fit).select("rid", "doc_id", "score").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = staged(ranged.select("rid", F.monotonically_increasing_id().alias("at")), "ranked")
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    upto = sizes.select("part", "n", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per partition
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()[0]
    ranks = ranged.join(F.broadcast(upto.select("part", "before")), part == F.col("part")).select("rid", (F.col("before") + F.expr("at & 8589934591") + 1).alias("rank"))
    return scored.join(ranks.filter(F.col("rank") <= percent * total // 100), "rid", "left")


def importance_resampling(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of ``docs``.

    Null and empty texts have no features and weight 0; like all texts of fewer
    than ``least_words`` words they are not drawn. Ties in score go to the
    smaller doc_id; a null doc_id takes the noise of the word ``null`` and comes
    last. Rows that repeat a doc_id are texts of their own. With an empty target
    all buckets count as equally frequent there; an empty table gives an empty
    result. Extra columns are ignored.
    """
    return drawn(weighted(docs, target, buckets, n, seed), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns as they are, whatever their names.

    Rows that repeat both doc_id and text are drawn or left each for itself.
    """
    packed = staged(docs.select(F.struct("*").alias("row"), "doc_id", "text").withColumn("key", F.monotonically_increasing_id()), "rows")
    scored = weighted(packed.select(F.col("key").alias("doc_id"), "text"), target, buckets, n, seed).withColumnRenamed("doc_id", "key")
    named = scored.join(packed.select("key", "row.doc_id"), "key").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    keys = staged(drawn(named, percent, least_words).filter("rank IS NOT NULL").select("key"), "drawn")
    return packed.join(keys, "key", "left_semi").select("row.*")
