"""Column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other code points as they are.

    ``lower`` is the fast path; texts with other upper-case letters, which it
    would change too, take ``translate``.
    """
    return F.when(c.rlike(r"[\p{IsUppercase}\p{IsTitlecase}&&[^A-Z]]"), F.translate(c, _UPPER, _UPPER.lower())).otherwise(F.lower(c))


def hash_pair(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a string, together a 128-bit key."""
    return F.xxhash64(c), F.xxhash64(F.lit(0x5BD1E995), c)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null as empty) and the named columns only, so that no extra column can clash."""
    return df.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *(F.col(c) for c in more))


def packed(df: DataFrame, *more: str) -> DataFrame:
    """row (all columns of ``df``), doc_id, text and the named columns: helper columns that are added can clash with none of the user's."""
    return df.select(F.struct("*").alias("row"), "doc_id", "text", *more)


def unpacked(df: DataFrame) -> DataFrame:
    """The rows that ``packed`` put away, as they were."""
    return df.select("row.*")


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
