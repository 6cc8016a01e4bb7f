"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of code points. The distinct
blocks are sorted and get integer names; then adjacent names are paired and
the distinct pairs named again, level by level, until every text has one
name. Equal names at one level mean equal substrings, so (number of blocks,
last name) is an identity without collisions.

Blocks move through one shuffle only, after a map-side distinct. Where an
occurrence looks up its block's name, a 128-bit hash stands for the block;
the distinct blocks show whether any two share a hash, and if so the whole
lookup goes by block text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import documents, hash_pair
from noticeflow.runtime import release, scratch, staged

BLOCK = 8192


def _blocks(text: Column, size: int) -> Column:
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0)))


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """An integer name for each row, in the order of the keys within each part of the key space."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _regroup(df: DataFrame) -> DataFrame:
    """Names of each row's parts, in order of position. A row's parts all come from its one text."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return df.groupBy("rid", "n_blocks").agg(F.transform(parts, lambda p: p["name"]).alias("names"))


def identities(docs: DataFrame, block: int = BLOCK, keyer: Callable[[Column], tuple[Column, Column]] = hash_pair) -> tuple[DataFrame, DataFrame]:
    """(rows, identity): rows has rid, doc_id, text_sha256 for each input row;
    identity has rid, n_blocks, name, equal exactly for equal texts."""
    base = documents(docs)
    def keyed(parts):
        return F.transform(parts, lambda b: F.struct(keyer(b)[0].alias("a"), keyer(b)[1].alias("b")))
    rows = staged(base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("text", 256).alias("text_sha256"), keyed(_blocks(F.col("text"), block)).alias("keys")), "rows")

    blocks = base.select(F.explode(_blocks(F.col("text"), block)).alias("block")).withColumns({"a": keyer(F.col("block"))[0], "b": keyer(F.col("block"))[1]})
    names = staged(_named(blocks.select("a", "b", "block").distinct(), "a", "b", "block").drop("block"), "names")

    if names.groupBy("a", "b").count().filter("count > 1").isEmpty():
        occurrences = rows.select("rid", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("pos", "key")).select("rid", "n_blocks", "pos", "key.a", "key.b")
        level = _regroup(occurrences.join(names, ["a", "b"]))
    else:
        release(rows, names)
        text = staged(base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("text", 256).alias("text_sha256"), _blocks(F.col("text"), block).alias("keys")), "rows")
        rows = text
        occurrences = text.select("rid", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("pos", "block"))
        names = staged(_named(occurrences.select("block").distinct(), "block"), "names")
        level = _regroup(occurrences.join(names, "block"))

    rounds = max(0, (rows.agg(F.max(F.size("keys"))).first()[0] or 0) - 1).bit_length()
    done = []
    for r in range(rounds):
        now = staged(level, f"level{r}")
        done.append(now.filter(F.size("names") == 1).select("rid", "n_blocks", F.col("names")[0].alias("name")))
        pairs = F.transform(F.sequence(F.lit(0), F.expr("cast((size(names) - 1) / 2 as int)")), lambda i: F.struct(F.get("names", i * 2).alias("l"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("r")))
        open_ = now.filter(F.size("names") > 1).select("rid", "n_blocks", F.posexplode(pairs).alias("pos", "p")).select("rid", "n_blocks", "pos", "p.l", "p.r")
        # staged, so that both sides of the join are plain exchanges and a pair with very many rows can be split
        pair_names = staged(_named(open_.select("l", "r").distinct(), "l", "r"), f"pairs{r}")
        level = _regroup(open_.join(pair_names, ["l", "r"]))
    done.append(level.select("rid", "n_blocks", F.col("names")[0].alias("name")))
    ident = done[0]
    for d in done[1:]:
        ident = ident.unionByName(d)
    return rows.select("rid", "doc_id", "text_sha256"), ident


def exact_dedup(docs: DataFrame, block: int = BLOCK, keyer=hash_pair) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the largest doc_id
    stays; among rows that share it, exactly one. A null doc_id is smaller than
    any other: keep_id is null only where all of a group are. Other columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    with scratch() as keep:
        rows, ident = identities(docs, block, keyer)
        found = keep(staged(rows.join(ident, "rid"), "identity"))
    # staged, so that both sides of the join are plain exchanges and a name with very many rows can be split
    groups = staged(found.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return found.join(groups, ["n_blocks", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")
