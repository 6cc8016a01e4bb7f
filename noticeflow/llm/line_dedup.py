"""Line dedup over range-partitioned line hashes.

Every line becomes (hash, document, position). The rows are range-partitioned
on hash and document and sorted by hash, document and position, so a hash with
very many lines spreads over many partitions; streaming each run yields the
first occurrence of a line in a document and how often it follows. What comes
back is a sparse bitmap of kept lines per document, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import ascii_lower, documents, hash_pair, packed, unpacked
from noticeflow.runtime import maybe_broadcast, release, staged

WHITE = "\t\n\x0b\x0c\r "


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _base(docs: DataFrame) -> DataFrame:
    """Rows are told apart by doc_id and a hash of the text: rows that agree in both have one result."""
    return documents(docs).withColumn("th", F.xxhash64("text"))


def line_occurrences(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, th, pos, a, b: a row for each line whose key has min_chars code points; (a, b) hash the key."""
    keys = F.transform(_lines(F.col("text")), line_key)
    out = _base(docs).select("doc_id", "th", F.posexplode(keys).alias("pos", "key")).filter(F.char_length("key") >= min_chars)
    a, b = hash_pair(F.col("key"))
    return out.select("doc_id", "th", "pos", a.alias("a"), b.alias("b"))


def first_occurrences(lines: DataFrame) -> DataFrame:
    """a, b, doc_id, first_pos, times for each line hash and document.

    The range partitioning on (a, b, doc_id) serves the grouping as it is: no further shuffle.
    """
    ranged = lines.repartitionByRange("a", "b", "doc_id").sortWithinPartitions("a", "b", "doc_id", "th", "pos")
    return ranged.groupBy("a", "b", "doc_id").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("times"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, th, keep: an array of 64-bit words, bit p of word w says that line 64 * w + p stays.

    Words after the last that drops a line, and documents that drop none, are left out.
    Lines found in ``min_docs`` documents go everywhere; with ``keep_first``
    they stay in the document with the smallest id, at their first place.
    Documents with one doc_id (null too) count once.
    """
    lines = staged(line_occurrences(docs, min_chars), "lines")
    first = first_occurrences(lines)
    # staged, so that both sides of the join are plain exchanges and a line with very many occurrences can be split
    common = staged(first.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "first_pos")).alias("first")).filter(F.col("n_docs") >= min_docs), "common")
    if keep_first:
        gone = lines.join(common, ["a", "b"]).filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.first_pos"))))
    else:
        gone = lines.join(common.select("a", "b"), ["a", "b"])
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = gone.groupBy("doc_id", "th", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("drop_bits"))
    entries = words.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("drop_bits").alias("bits")))).alias("entries"))
    entries = staged(entries, "entries")  # so that a look at the entry before is one step
    full = lambda e, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), e["word"] - F.coalesce(F.get("entries", i - 1)["word"], F.lit(-1)) - 1), F.array(e["bits"]))
    keep = staged(entries.select("doc_id", "th", F.flatten(F.transform("entries", full)).alias("keep")), "bitmaps")
    release(lines, common, entries)
    return keep


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row (the columns of ``docs``), doc_id, text, kept_text, n_lines, n_dropped. Where the bitmaps are
    small they are broadcast and no text is moved; else texts and bitmaps meet by document."""
    d = packed(docs).withColumn("whole", F.coalesce("text", F.lit(""))).withColumn("th", F.xxhash64("whole"))
    m = maybe_broadcast(bitmaps.select(F.col("doc_id").alias("_id"), F.col("th").alias("_mth"), "keep"))
    j = d.join(m, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_mth")), "left")
    bits = lambda i: F.coalesce(F.get("keep", F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
    kept = F.filter(_lines(F.col("whole")), lambda line, i: F.getbit(bits(i), i % 64) == 1)
    j = j.withColumn("kept", F.when(F.col("keep").isNull(), _lines(F.col("whole"))).otherwise(kept))
    n = F.size(_lines(F.col("whole")))
    return j.select("row", "doc_id", "text", F.array_join("kept", "\n").alias("kept_text"), n.cast("long").alias("n_lines"), (n - F.size("kept")).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of ``docs``.

    Null and empty texts are one empty line, whose key is too short to go.
    Rows that repeat a doc_id count as one document when lines are counted and
    get a row each in the result; so do rows without a doc_id, which are one
    document among those counted. An empty table gives an empty result; extra
    columns are ignored.
    """
    out = apply_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, min_docs, min_chars))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the lines found in ``min_docs`` documents taken out of text.

    All other columns stay as they are, whatever their names; n_chars, if it is
    there, follows the text. Null texts stay null, empty ones empty. Rows that
    repeat a doc_id count as one document and each lose their own lines. An
    empty table gives an empty result.
    """
    done = apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.coalesce(F.char_length(text).cast(docs.schema["n_chars"].dataType), F.col("row.n_chars")))
    return unpacked(done.withColumn("row", row))
