"""What a client shows: texts by language, lines of cards and items, chips, marked terms, spoken lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions import patterns as P
from noticeflow.functions.text import let, running, strip, strip_markers


def shown(c: Column) -> Column:
    """A value without outer blanks; null and the word null, in any case, are ''."""
    v = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(v) == "null", "").otherwise(v)


def first_shown(*cs: Column) -> Column:
    """The first value that is not blank, else ''."""
    return F.coalesce(*(F.nullif(shown(c), F.lit("")) for c in cs), F.lit(""))


def text_of_language(lang: Column, columns: list[str]) -> Column:
    """The text of a language from whichever of its response columns is there and filled first; '' for other languages."""
    out = F.lit("")
    for code, names in P.RESPONSE_COLUMNS.items():
        out = F.when(lang == code, first_shown(*(F.col(c) for c in names if c in columns), F.lit(""))).otherwise(out)
    return out


def card_line(header: Column, value: Column, chip: Column) -> Column:
    """[chip] header: value, or null without a value."""
    def line(h: Column, v: Column, c: Column) -> Column:
        return F.concat(F.when(c != "", F.concat(F.lit("["), c, F.lit("] "))).otherwise(""), F.when(h != "", F.concat(h, F.lit(": "))).otherwise(""), v)
    return F.when(shown(value) != "", line(shown(header), shown(value), shown(chip)))


def card_lines(cards: Column) -> Column:
    """struct(ko, easy, translated): the lines of all cards in three forms, each ended by a line end."""
    def lines(header, value) -> Column:
        each = F.filter(F.transform(cards, lambda c: card_line(header(c), value(c), c["chip"])), lambda x: x.isNotNull())
        return F.array_join(F.transform(each, lambda x: F.concat(x, F.lit("\n"))), "")
    return F.struct(
        lines(lambda c: c["header_ko"], lambda c: c["value_ko"]).alias("ko"), lines(lambda c: c["header_ko"], lambda c: first_shown(c["value_easy_ko"], c["value_ko"])).alias("easy"),
        lines(lambda c: first_shown(c["header_translated"], c["header_ko"]), lambda c: first_shown(c["value_translated"], c["value_ko"])).alias("translated"),
    )


def item_line(title: Column, action_hint: Column, amount: Column, deadline: Column) -> Column:
    """[action] title · amount · deadline, or null without a title."""
    hint = shown(action_hint)
    parts = F.filter(F.array(shown(title), shown(amount), shown(deadline)), lambda x: x != "")
    return F.when(shown(title) != "", F.concat(F.when(hint != "", F.concat(F.lit("["), hint, F.lit("] "))).otherwise(""), F.array_join(parts, " · ")))


def by_importance(items: Column) -> Column:
    """Items (with an importance) by importance, the highest first; a missing one counts as 0.5, equals stay as they are."""
    numbered = F.transform(items, lambda x, i: F.struct((-F.coalesce(x["importance"], F.lit(0.5))).alias("k"), i.alias("i"), x.alias("item")))
    def order(a, b):
        return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)
    return F.transform(F.array_sort(numbered, order), lambda x: x["item"])


def chips(cards: Column, most: int = 8) -> Column:
    """struct(chip, label) of the first cards that have a header or a value: 'header · value' or the value."""
    some = F.filter(cards, lambda c: (shown(c["header_ko"]) != "") | (shown(c["value_ko"]) != ""))
    label = lambda c: F.when(shown(c["header_ko"]) == "", shown(c["value_ko"])).otherwise(F.concat(shown(c["header_ko"]), F.lit(" · "), shown(c["value_ko"])))
    return F.transform(F.slice(some, 1, most), lambda c: F.struct(shown(c["chip"]).alias("chip"), label(c).alias("label")))


def places(text: Column, word: Column) -> Column:
    """struct(start, end) of the occurrences of a word, from 0; none of an empty one."""
    def of(rest: Column) -> Column:
        upto = running(F.transform(F.slice(rest, 1, F.size(rest) - 1), lambda r: F.char_length(r)))
        starts = F.transform(upto, lambda n, k: (n + k * F.char_length(word)).cast("int"))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), (s + F.char_length(word)).alias("end")))
    return F.when(word == "", F.array().cast("array<struct<start:int,end:int>>")).otherwise(let(F.split(text, F.concat(F.lit("\\Q"), word, F.lit("\\E")), -1), of))


def highlights(text: Column, note: Column) -> Column:
    """Places of the translations that a review note (term->translation; ...) names; translations of one character are left out."""
    pairs = F.transform(F.split(F.coalesce(note, F.lit("")), "[;\n]", -1), lambda p: F.split(p, "->", -1))
    words = F.filter(F.transform(F.filter(pairs, lambda p: F.size(p) >= 2), lambda p: strip(F.get(p, F.lit(1)))), lambda w: F.char_length(w) >= 2)
    return F.flatten(F.transform(words, lambda w: places(F.coalesce(text, F.lit("")), w)))


def mapped(entries: Column, value: Column) -> Column:
    """The translation of a value among entries (ko, translated); the value itself where there is none or an empty one. Of equal ones the last counts."""
    hit = F.filter(entries, lambda e: e["ko"] == value)
    return F.coalesce(F.nullif(F.get(hit, F.size(hit) - 1)["translated"], F.lit("")), value)


def spoken_items(items: Column, summary: Column, lang: Column | str) -> Column:
    """The older speech text: a line for each item, by importance: its title, then when, what, amount and deadline
    in the reader's language by the summary's entries. Items without a title go."""
    easy = (F.lit(lang) if isinstance(lang, str) else lang) == "ko_easy"
    def line(i) -> Column:
        title = F.coalesce(F.when(easy, i["title_ko"]).otherwise(i["title_translated"]), F.lit(""))
        what = F.array_join(F.transform(F.coalesce(i["what"], F.array().cast("array<string>")), lambda w: mapped(summary["supplies"], w)), ", ")
        extras = F.array(F.coalesce(i["when"], F.lit("")), what, F.coalesce(mapped(summary["amounts"], i["amount"]), F.lit("")), F.coalesce(strip_markers(mapped(summary["deadlines"], i["deadline"])), F.lit("")))
        return F.when(title != "", F.array_join(F.concat(F.array(strip_markers(title)), F.filter(extras, lambda x: x != "")), ". "))
    return F.array_join(F.filter(F.transform(by_importance(items), line), lambda x: x.isNotNull()), "\n")
