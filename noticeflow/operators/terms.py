"""Terms of a glossary table in texts: rows of texts and the terms that they contain.

Terms stand in Aho-Corasick automata, which read a text once whatever their
number. A glossary is dealt into parts of bounded size. One part is broadcast
and texts stay where they are. With more, each text goes to every part: a task
is a part and a share of the texts, reads its terms first and then lets the
texts pass, so it holds one automaton and one batch of texts. The number of
shares follows from the cluster's cores and not from the texts, so that few
copies of the terms are made.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.text import strip
from noticeflow.runtime import map_arrow, maybe_broadcast, staged

#: Letters of the terms in one automaton, and how many terms are looked for one by one instead.
PART, FEW = 1 << 20, 32


def automaton(terms: list[str]):
    """Of different, non-empty terms."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    if terms:
        a.make_automaton()
    return a


def found_in(a, text: str | None) -> list[str]:
    """The automaton's terms in a text, each once, in order."""
    return sorted({t for _, t in a.iter(text)}) if text and len(a) else []


def usable(glossary: DataFrame, term: str = "korean", preferred: str = "preferred") -> DataFrame:
    """Rows with a term and a preferred translation."""
    return glossary.filter((strip(F.coalesce(preferred, F.lit(""))) != "") & (F.coalesce(term, F.lit("")) != ""))


def _by_broadcast(texts: DataFrame, terms: list[str], found: str) -> DataFrame:
    """Adds the terms of one part, which the driver holds and every worker gets."""
    held = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        a = automaton(held.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                got = [found_in(a, t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.list_(pa.string()))], names=[*part.schema.names[:-1], found])

    schema = T.StructType([*texts.schema.fields[:-1], T.StructField(found, T.ArrayType(T.StringType()))])
    return map_arrow(texts, run, schema)


def _by_parts(texts: DataFrame, terms: DataFrame, parts: int, shares: int, id_: str, text: str) -> DataFrame:
    """id and term of each text and term in it: part and share name a task, whose terms come before its texts."""
    t = terms.select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(None).cast("long").alias("id"), F.col("term").alias("text"))
    d = texts.filter(F.col(text) != "").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64(id_), F.lit(shares)).cast("int").alias("share"), F.col(id_).alias("id"), F.col(text).alias("text"))

    def run(batches):
        task, terms_, a = None, [], None
        for b in batches:
            ids, found = [], []
            for part, share, number, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (part, share) != task:
                    task, terms_, a = (part, share), [], None
                if number is None:
                    terms_.append(words)
                    continue
                a = a if a is not None else automaton(terms_)
                got = found_in(a, words)
                ids += [number] * len(got)
                found += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["id", "term"])

    rows = t.unionByName(d).repartition(parts * shares, "part", "share").sortWithinPartitions("part", "share", F.col("id").asc_nulls_first())
    return map_arrow(rows, run, "id long, term string")


def term_rows(texts: DataFrame, glossary: DataFrame, text_col: str = "text", term: str = "korean", preferred: str = "preferred", part: int = PART) -> DataFrame:
    """A row per text and glossary row whose term is in it: the columns of both. Terms without a preferred
    translation and null texts have none; glossary rows that repeat a term give a row each.

    The glossary is stored first, so that the size of its terms is known. ``part`` is the number of letters
    that one automaton has at most, but for a longer term.
    """
    g = staged(usable(glossary, term, preferred), "glossary")
    terms = staged(g.select(F.col(term).alias("term")).distinct(), "terms")
    n, letters = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("term")), F.lit(0))).first()
    names = [f.name for f in texts.schema.fields], [f.name for f in glossary.schema.fields]
    if n <= FEW and letters <= part:
        return texts.join(F.broadcast(g), F.col(text_col).contains(F.col(term)))
    packed = texts.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    known = g.select(F.struct("*").alias("entry"), F.col(term).alias("term"))
    if letters <= part:
        held = [r.term for r in terms.collect()]  # ``part`` letters at most
        rows = _by_broadcast(packed, held, "found").select("row", F.explode("found").alias("term"))
    else:
        parts = -(-letters // part)
        shares = max(1, -(-2 * texts.sparkSession.sparkContext.defaultParallelism // parts))
        numbered = staged(packed.withColumn("id", F.monotonically_increasing_id()), "texts")
        hits = staged(_by_parts(numbered, terms, parts, shares, "id", "text"), "hits")
        rows = hits.join(numbered.select("id", "row"), "id").select("row", "term")
    out = rows.join(maybe_broadcast(known), "term")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in names[0]), *(F.col(f"entry.`{c}`").alias(c) for c in names[1]))
