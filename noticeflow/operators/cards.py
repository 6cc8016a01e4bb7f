"""Slot cards: header and value of to-dos, cards from slots, dedup and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.functions import glossary as G
from noticeflow.functions import patterns as P
from noticeflow.functions import rules, slots
from noticeflow.functions.easy import easy_korean
from noticeflow.functions.i18n import format_amount, format_date, format_time
from noticeflow.functions.text import for_compare, join_broken_lines, let, sentences, strip, strip_markers

_HEAD = "|".join(rf"\Q{h}\E" for h in sorted(P.HEADERS, key=lambda h: (-len(h), P.HEADERS.index(h))))
HEADED = rf"(?Us)\A\s*({_HEAD})\s*[|:：]?\s*(.+)\z"
CARD = "struct<header_ko:string,header_translated:string,value_ko:string,value_easy_ko:string,value_translated:string,chip:string,importance:double>"
MAX_CARDS = 8


def header(text: Column) -> Column:
    """The standard header at the start of a text, or null."""
    return F.nullif(F.regexp_extract(strip(text), HEADED, 1), F.lit(""))


def value(text: Column) -> Column:
    """What follows the header; the text itself where there is none."""
    found = F.regexp_extract(strip(text), HEADED, 2)
    return F.when(header(text).isNotNull(), strip(found)).otherwise(strip(text))


def with_slots(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Adds dates, times, amounts, urls, phones: arrays of (ko, translated, source) of a text."""
    entry = lambda ko, shown: F.struct(ko.alias("ko"), shown.alias("translated"), F.lit("regex").alias("source"))
    same, own = lambda x: entry(x, x), F.lit(lang)
    shown = {"dates": lambda d: format_date(d, own), "times": lambda t: format_time(t, own), "amounts": lambda a: format_amount(a["value"], own)}
    made = {k: (lambda f: lambda x: entry(x["ko"], f(x)))(f) for k, f in shown.items()}
    return slots.with_found(df, text, {**made, "urls": same, "phones": same})


def slot_rows(notices: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, slot (dates, times, amounts, urls, phones), pos, ko: a row for each value found in a text; null texts have none."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = {"dates": slots.dates(t), "times": slots.times(t), "amounts": slots.amounts(t)}
    lists = {**{k: F.transform(v, lambda x: x["ko"]) for k, v in found.items()}, "urls": slots.urls(t), "phones": slots.phones(t)}
    rows = notices.select(id_col, F.explode(F.array(*(F.struct(F.lit(k).alias("slot"), v.alias("values")) for k, v in lists.items()))).alias("s"))
    return rows.select(id_col, "s.slot", F.posexplode("s.values").alias("pos", "ko"))


def from_first_form(todos: DataFrame) -> DataFrame:
    """To-dos of the first form (text_ko, due_date, importance) in the present one: the importance is the confidence,
    0.5 if it is missing, and the amount is read from the text."""
    text = F.coalesce(F.col("text_ko"), F.lit(""))
    return todos.withColumns({"text": text, "amount": slots.amount(text), "confidence": F.coalesce(F.col("importance").cast("double"), F.lit(0.5)), "action_hint": F.lit(None).cast("string")}).drop("text_ko", "importance")


def when_text(text: Column, lang: Column) -> Column:
    """First date and first time in the reader's language, or null."""
    # each is found once, however often its form asks for its parts
    day = let(slots.first_date(text), lambda d: format_date(d, lang))
    hour = let(slots.first_time(text), lambda t: format_time(t, lang))
    return F.nullif(F.concat_ws(" ", day, hour), F.lit(""))


def todo_cards(todo: DataFrame, id_col: str, lang: str, glossary: list[tuple[str, str]], translated: str | None = None) -> DataFrame:
    """Adds to to-do rows (text, confidence) the fields of a card. ``translated`` names a column with what a
    translator made of the value; without one the value stays."""
    d = todo.withColumn("_t", strip(F.col("text"))).withColumn("_h", F.nullif(F.regexp_extract("_t", HEADED, 1), F.lit("")))
    rest = F.when(F.col("_h").isNotNull(), strip(F.regexp_extract("_t", HEADED, 2))).otherwise(F.col("_t"))
    d = d.withColumns({"value_ko": rest, "header_ko": F.coalesce("_h", F.lit(P.OTHER))}).withColumn("_c", rules.category(F.col("value_ko")))
    shown = F.coalesce(F.nullif(F.col(translated), F.lit("")), "value_ko") if translated else F.col("value_ko")
    d = d.withColumn("value_easy_ko", easy_korean(F.col("value_ko")))
    d = d.withColumns({"header_translated": G.term_of(F.col("header_ko"), glossary, F.lit(lang)), "value_translated": shown, "chip": F.when(F.col("_c") != P.OTHER, F.col("_c")), "importance": F.col("confidence")})
    return d.drop("_t", "_h", "_c")


def with_slot_cards(df: DataFrame, lang: str, glossary: list[tuple[str, str]], name: str) -> DataFrame:
    """Adds to rows with the columns of ``with_slots`` and heads (the headers of their to-do cards, an array) the cards, at importance 0.7, of the
    slots that have values and that no such header covers. Joined values are columns first: they are computed once each."""
    def joined(slot: str, field: str) -> Column:
        return F.array_join(F.array_remove(F.col(slot)[field], ""), ", ")
    df = df.withColumns({f"_{slot}_{field}": joined(slot, field) for slot, _ in P.SLOT_HEADERS for field in ("ko", "translated")})
    def card(slot: str, head: str) -> Column:
        ko, head_ko = F.col(f"_{slot}_ko"), F.lit(head)
        shown = F.coalesce(F.nullif(F.col(f"_{slot}_translated"), F.lit("")), ko)
        made = F.struct(head_ko.alias("header_ko"), G.term_of(head_ko, glossary, F.lit(lang)).alias("header_translated"), ko.alias("value_ko"), easy_korean(ko).alias("value_easy_ko"), shown.alias("value_translated"), F.lit(None).cast("string").alias("chip"), F.lit(0.7).alias("importance"))
        covered = reduce(lambda a, h: a | F.array_contains("heads", h), P.SLOT_COVERED_BY[slot], F.lit(False))
        return F.when((ko != "") & ~covered, F.array(made).cast(f"array<{CARD}>")).otherwise(F.array().cast(f"array<{CARD}>"))
    cards = F.concat(*(card(slot, head) for slot, head in P.SLOT_HEADERS))
    return df.withColumn(name, cards).drop(*(f"_{slot}_{field}" for slot, _ in P.SLOT_HEADERS for field in ("ko", "translated")))


def dedup(cards: Column) -> Column:
    """Per header, values that are part of a longer kept value go; the rest by header's first
    appearance, then the longest value first. A kept card keeps its own importance. Cards whose headers
    all differ are those already."""
    def numbers(cards: Column, heads: Column) -> Column:
        return F.transform(cards, lambda c, i: F.struct(F.array_position(heads, c["header_ko"]).alias("h"), (-F.char_length(c["value_ko"])).alias("n"), i.alias("i"), for_compare(c["value_ko"]).alias("norm"), c.alias("card")))
    cards = cards.cast(f"array<{CARD}>")
    numbered = let(F.array_distinct(cards["header_ko"]), lambda heads: numbers(cards, heads))
    kind = "struct<h:bigint,n:int,i:int,norm:string,card:%s>" % CARD
    ordered = F.sort_array(numbered).cast(f"array<{kind}>")
    def step(kept, x):
        inside = F.exists(kept, lambda k: (k["h"] == x["h"]) & k["norm"].contains(x["norm"]))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(x)))
    some = F.aggregate(ordered, F.array().cast(f"array<{kind}>"), step, lambda kept: kept["card"])
    # of two cards with the same header the lengths tell which one may be within the other
    size = lambda i: F.char_length(F.get(cards, F.lit(i))["value_ko"])
    def of_two(longer: int, shorter: int) -> Column:
        a, b = F.get(cards, F.lit(longer)), F.get(cards, F.lit(shorter))
        return F.when(for_compare(a["value_ko"]).contains(for_compare(b["value_ko"])), F.array(a)).otherwise(F.array(a, b))
    pair = F.when(size(0) < size(1), of_two(1, 0)).otherwise(of_two(0, 1))
    two = (F.size(cards) == 2) & (size(0) + size(1)).isNotNull()
    return F.when(F.size(F.array_distinct(cards["header_ko"])) == F.size(cards), cards).when(two, pair).otherwise(some)


def ranked(cards: Column, most: int | None = MAX_CARDS) -> Column:
    """Cards by importance, the highest first; equals as they stand."""
    # without a lambda: the greatest importance first, then the greatest of -1, -2, ...
    keyed = F.arrays_zip(cards["importance"].alias("k"), F.sequence(F.lit(-1), -F.size(cards), F.lit(-1)).alias("i"), cards.alias("card"))
    out = F.when(F.size(cards) < 2, cards).otherwise(F.sort_array(keyed, False)["card"])
    return F.slice(out, 1, most) if most else out


def speech(cards: Column, easy: bool) -> Column:
    """Text to be spoken: a line for each card, its header and its value without list marks; cards without value go."""
    def line(c) -> Column:
        head = c["header_ko"] if easy else F.coalesce(F.nullif(c["header_translated"], F.lit("")), c["header_ko"])
        val = F.coalesce(F.nullif(c["value_easy_ko"] if easy else c["value_translated"], F.lit("")), c["value_ko"])
        return F.when(F.coalesce(val, F.lit("")) != "", F.when(head != "", F.concat(head, F.lit(". "), strip_markers(val))).otherwise(strip_markers(val)))
    return F.array_join(F.filter(F.transform(cards, line), lambda x: x.isNotNull()), "\n")


def todos(notices: DataFrame, id_col: str, text_col: str = "text", as_of_year: int = 2026, threshold: float = 0.5, score=rules.todo_score) -> DataFrame:
    """A row per to-do sentence: id, pos, text, due_date, amount, confidence, action_hint.

    ``score`` makes a confidence column of a sentence column; null or under the
    threshold drops it. Cheap rejects run before it.
    """
    joined = notices.select(id_col, join_broken_lines(F.col(text_col)).alias("joined"))
    # outer: else a filter for texts with sentences is set before it, and they are made twice
    parts = joined.select(id_col, F.posexplode_outer(sentences(F.col("joined"), stripped=True)).alias("pos", "text")).filter("text IS NOT NULL")
    return _scored(parts, [id_col, "pos", "text"], as_of_year, threshold, score)


def _scored(parts: DataFrame, columns: list[str], as_of_year: int = 2026, threshold: float = 0.5, score=rules.todo_score) -> DataFrame:
    """To-dos among sentences (text); rows without a text stay."""
    t = F.col("text")
    own = rules.todo_points if score is rules.todo_score else score
    # the score comes as a generated column: a filter on a plain one is pushed below it, and the score made twice
    scored = parts.filter(t.isNull() | ~rules.rejected(t)).select("*", F.explode(F.array(own(t))).alias("_p")).filter(t.isNull() | (F.col("_p") >= threshold))
    return scored.select(*columns, slots.due_date(t, as_of_year).alias("due_date"), slots.amount(t).alias("amount"), F.round("_p", 4).alias("confidence"), slots.action(t).alias("action_hint"))


def as_json(df: DataFrame, keys: list[str], name: str = "document") -> DataFrame:
    """``keys`` and all other columns as one JSON object, nulls as null, in the order of the columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest)), {"ignoreNullFields": "false"}).alias(name))


def top_per_group(df: DataFrame, group: str, order: list, n: int = MAX_CARDS) -> DataFrame:
    """The first ``n`` rows of each group."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.select(F.struct("*").alias("row"), place.alias("place")).filter(F.col("place") <= n).select("row.*")


def _with_items(t: DataFrame, lang: str) -> DataFrame:
    """Adds to to-do rows the deprecated item form of a to-do."""
    d = t.withColumn("_cat", rules.category(F.col("text")))
    what = F.when(F.col("_cat") == "준비물", slots.supplies(F.col("text"))).otherwise(F.array().cast("array<string>"))
    item = F.struct(
        F.col("_cat").alias("category"), "action_hint", F.col("text").alias("title_ko"), when_text(F.col("text"), F.lit(lang)).alias("when"), what.alias("what"),
        F.concat(F.format_number("amount", 0), F.lit("원")).alias("amount"), F.col("due_date").alias("deadline"), F.col("confidence").alias("importance"),
    )
    return d.withColumn("item", item).drop("_cat")


def exploded(df: DataFrame, id_col: str, name: str = "cards") -> DataFrame:
    """id, pos, c: a row for each card. Outer, and rows without a card dropped after it: before any other, the planner sets a filter for
    texts that have cards, for which they would all be made a second time."""
    return df.select(id_col, F.posexplode_outer(name).alias("pos", "c")).filter("pos IS NOT NULL")


def analyze(notices: DataFrame, lang: str, glossary: list[tuple[str, str]] = (), id_col: str = "notice_id", as_of_year: int = 2026) -> DataFrame:
    """One row per notice (ids are unique): cards (eight at most), items, summary and both speech texts.

    To-dos and cards are rows while they are made, beside one row of the notice's slots, and meet by the notice's id
    only: a bounded number of sentences of one text. Notices without to-dos
    get cards from their slots.
    """
    g = list(glossary)
    base = with_slots(notices.select(F.col(id_col), F.coalesce("text", F.lit("")).alias("text")), "text", lang)
    kinds = ["dates", "times", "amounts", "urls", "phones"]
    joined = base.select(id_col, F.struct(*kinds).alias("slots"), join_broken_lines(F.col("text")).alias("joined"))
    # the row without a sentence has the slots; outer as in ``todos``
    own = F.concat(F.array(F.lit(None).cast("string")), sentences(F.col("joined"), stripped=True))
    parts = joined.select(id_col, "slots", F.posexplode_outer(own).alias("pos", "text"))
    t = _scored(parts.select(id_col, "pos", "text", F.when(F.col("text").isNull(), F.col("slots")).alias("slots")), [id_col, "pos", "text", "slots"], as_of_year)
    t = todo_cards(_with_items(t, lang), id_col, lang, g)
    fields = [x.split(":")[0] for x in CARD[len("struct<") : -1].split(",")]
    todo = F.col("text").isNotNull()
    card = F.when(todo, F.struct("confidence", (-F.col("pos")).alias("pos"), F.struct(*fields).alias("card")))
    gathered = t.groupBy(id_col).agg(F.first("slots", True).alias("slots"), F.collect_list(card).alias("top"), F.collect_list(F.when(todo, F.struct("pos", "item"))).alias("items"))
    df = gathered.withColumns({**{k: F.col("slots")[k] for k in kinds}, "top": F.slice(F.sort_array("top", False)["card"], 1, MAX_CARDS).cast(f"array<{CARD}>"), "items": F.sort_array("items")["item"]}).withColumn("heads", F.col("top")["header_ko"])
    # in steps: as columns they are computed once each; a slot's card has a header that no card of a to-do has
    df = with_slot_cards(df, lang, g, "own").withColumn("all", F.concat(dedup(F.col("top")), "own")).withColumn("cards", ranked(F.col("all")))
    def entry(source: str):
        return lambda v: F.struct(v.alias("ko"), G.term_of(v, g, F.lit(lang)).alias("translated"), F.lit(source).alias("source"))
    supplies = F.array_distinct(F.flatten(F.col("items")["what"]))
    deadlines = F.array_distinct(F.filter(F.col("items")["deadline"], lambda d: F.coalesce(d, F.lit("")) != ""))
    df = df.withColumn("summary", F.struct("slots.*", F.transform(supplies, entry("model")).alias("supplies"), F.transform(deadlines, entry("model+regex")).alias("deadlines")))
    return df.select(id_col, F.lit(lang).alias("target_language"), "cards", "items", "summary", speech(F.col("cards"), False).alias("tts_text"), speech(F.col("cards"), True).alias("tts_text_easy_ko"))
