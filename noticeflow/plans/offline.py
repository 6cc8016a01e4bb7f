"""Offline notice pipeline: source rows to easy text, translation input, glossary checks and a review label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import glossary as G
from noticeflow.functions import patterns as P
from noticeflow.functions import rules, slots
from noticeflow.functions.text import flatten, keyword_list, replace_phrases, sentences, sentences_by_mark, shortened, strip
from noticeflow.operators.corpus import defaults, greedy_chunks, select_sentences

MAX_SENTENCES = 5


def baseline(rows: DataFrame, glossary: Column) -> DataFrame:
    """id, original_text, category (kept if it is one of the six, else guessed), keywords, hits, action_required."""
    d = defaults(rows, ["id", "source_type", "original_text", "easy_ko_text", "easy_korean", "category", "keywords", "action_required"])
    text, cat = strip(F.col("original_text")), strip(F.col("category"))
    d = d.withColumn("original_text", text)
    return d.withColumns({"category": F.when(cat.isin(*P.CATEGORIES), cat).otherwise(rules.guess_category(F.col("original_text"))), "keywords": keyword_list(F.col("keywords")), "hits": G.hits(F.col("original_text"), glossary)})


def easy_text(d: DataFrame) -> Column:
    """The given easy text, else the original with its set phrases made simple, a sentence a line."""
    simple = flatten(replace_phrases(F.col("original_text"), P.PHRASES))
    lines = F.array_join(sentences_by_mark(simple), "\n")
    return F.coalesce(F.nullif(strip(F.col("easy_ko_text")), F.lit("")), F.nullif(strip(F.col("easy_korean")), F.lit("")), lines)


def run(rows: DataFrame, glossary: list[tuple[str, str]], translated: str | None = None, budget: int = 384) -> DataFrame:
    """One row per source row: baseline fields, easy_text (five sentences at most, those with a term first),
    chunks for a translator, translated_text, checks, quality_label, note, errors.

    ``translated`` names a column that a translator has filled; without it the
    easy text stands in. A row without any visible text has an error instead
    of a label; the other rows go on.
    """
    g = G.literal(list(glossary))
    d = baseline(rows, g)
    d = d.withColumn("_easy", easy_text(d))
    terms = F.transform("hits", lambda h: h["korean"])
    d = d.withColumn("_s", select_sentences(sentences_by_mark(F.col("_easy")), terms, MAX_SENTENCES)).withColumn("easy_text", F.array_join("_s", "\n"))
    d = d.withColumn("translated_text", F.coalesce(F.col(translated) if translated else F.col("easy_text"), F.lit("")))
    d = d.withColumns({"chunks": greedy_chunks(F.col("_s"), budget), "checks": G.checks(F.col("easy_text"), F.col("translated_text"), G.hits(F.col("easy_text"), g))})
    d = d.withColumn("_r", G.roll_up(F.col("checks")))
    empty = F.col("easy_text") == ""
    d = d.withColumns({"quality_label": F.when(empty, "error").otherwise(F.col("_r.label")), "note": F.when(empty, "").otherwise(F.col("_r.note")), "errors": F.when(empty, F.array(F.lit("easy_ko_text is required."))).otherwise(F.array().cast("array<string>"))})
    return d.drop("_easy", "_s", "_r")


def legacy_todos(notices: DataFrame, id_col: str, year: int = 2026, category=rules.category, confidence: Column | None = None) -> DataFrame:
    """The first form of to-do extraction: id, pos, text (100 characters at most), category, importance, due_date.

    Sentences by their marks only; money is a category of its own at full
    confidence; a confidence or importance under 0.25 drops a sentence.
    """
    parts = notices.select(id_col, F.posexplode(sentences(F.col("text"), plain=True, drop_lines=False)).alias("pos", "s"))
    s = F.col("s")
    d = parts.filter(~rules.rejected(s)).withColumn("due_date", slots.due_date(s, year)).withColumn("category", F.when(rules.has_money(s), "비용").otherwise(category(s)))
    d = d.withColumn("_c", F.when(rules.has_money(s), 1.0).otherwise(confidence if confidence is not None else F.lit(0.5)))
    d = d.withColumn("importance", rules.importance_legacy(s, F.col("category"), F.col("due_date")))
    return d.filter((F.col("_c") >= 0.25) & (F.col("importance") >= 0.25)).select(id_col, "pos", shortened(s).alias("text"), "category", "importance", "due_date")


def legacy_todo_lists(notices: DataFrame, id_col: str, **more) -> DataFrame:
    """id and todos of every notice: the rows of ``legacy_todos`` in order as one array of structs
    (category, text_ko, text_vi: '' until it is translated, importance, due_date); empty without any."""
    rows = legacy_todos(notices, id_col, **more)
    item = F.struct("category", F.col("text").alias("text_ko"), F.lit("").alias("text_vi"), "importance", "due_date")
    lists = rows.groupBy(F.col(id_col).alias("own")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))), lambda x: x["item"]).alias("todos"))
    kind = lists.schema["todos"].dataType
    ids = notices.select(F.col(id_col).alias("id"))
    return ids.join(lists, F.col("id").eqNullSafe(F.col("own")), "left").select(F.col("id").alias(id_col), F.coalesce("todos", F.array().cast(kind)).alias("todos"))
