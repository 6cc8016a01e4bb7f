"""Glossary terms in texts: hits, injection, coverage, protection of links and phones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import patterns as P
from noticeflow.functions.easy import protect, restore, woven
from noticeflow.functions.text import let, matches, strip

MARK = "⟦P%d⟧"
PAIR = "array<struct<korean:string,preferred:string>>"


def literal(rows: list[tuple[str, str]]) -> Column:
    """Glossary of a few hundred (term, preferred) rows as one constant, in file order."""
    return F.array(*(F.struct(F.lit(k).alias("korean"), F.lit(v).alias("preferred")) for k, v in rows)).cast(PAIR) if rows else F.array().cast(PAIR)


def unpivot(glossary: DataFrame, langs: list[str]) -> DataFrame:
    """(pos, korean, lang, preferred) of a wide table with pos, korean and preferred_<lang>."""
    return glossary.unpivot(["pos", "korean"], [f"preferred_{x}" for x in langs], "lang", "preferred").withColumn("lang", F.substring("lang", len("preferred_") + 1, 99))


def hits(text: Column, glossary: Column) -> Column:
    """Terms found in the text that have a preferred translation, in glossary order."""
    return F.filter(glossary, lambda g: (strip(F.coalesce(g["preferred"], F.lit(""))) != "") & text.contains(g["korean"]))


def injected(text: Column, found: Column) -> Column:
    """term(preferred) for each hit, the longest first; terms within terms are set again."""
    ordered = F.array_sort(F.transform(found, lambda g, i: F.struct((-F.char_length(g["korean"])).alias("n"), i.alias("i"), g.alias("g"))))
    return F.aggregate(ordered, text, lambda acc, x: F.replace(acc, x["g"]["korean"], F.concat(x["g"]["korean"], F.lit("("), x["g"]["preferred"], F.lit(")"))))


def term(text: Column, glossary: Column, lang: Column) -> Column:
    """The preferred translation of a whole term, or the term itself."""
    def of(text: Column) -> Column:
        exact = F.filter(glossary, lambda g: (strip(g["korean"]) == strip(text)) & (strip(F.coalesce(g["preferred"], F.lit(""))) != ""))
        return F.when((strip(text) == "") | (lang == "ko_easy") | is_url_or_phone(text), text).otherwise(F.coalesce(strip(F.get(exact, F.lit(0))["preferred"]), text))
    return let(text, of)


def term_of(text: Column, rows: list[tuple[str, str]], lang: Column) -> Column:
    """``term`` by the rows of a glossary: one look-up, which the planner makes itself for a constant text."""
    known: dict[str, str] = {}
    for k, v in rows:
        if k and v and k.strip(P.BLANKS) and v.strip(P.BLANKS):
            known.setdefault(k.strip(P.BLANKS), v.strip(P.BLANKS))
    if not known:
        return text
    found = F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), strip(text))
    return F.when(strip(text).isin(*known), F.when((lang == "ko_easy") | is_url_or_phone(text), text).otherwise(found)).otherwise(text)


def is_url_or_phone(text: Column) -> Column:
    return strip(text).rlike(rf"\A(?:{P.URL}|{P.PHONE})\z")


def masked(text: Column) -> Column:
    """struct(text with marks for links, then phones; kept: what the marks stand for)."""
    def phones(u: Column) -> Column:
        return let(protect(u["text"], P.PHONE, MARK, F.size(u["kept"])), lambda p: F.struct(p["text"].alias("text"), F.concat(u["kept"], p["kept"]).alias("kept")))
    return let(protect(text, P.URL, MARK), phones)


def unmasked(text: Column, kept: Column) -> Column:
    return restore(text, kept, MARK)


def currency_fixed(source: Column, translated: Column) -> Column:
    """Dollars back to won and points in thousands to commas, where the source names an amount in won."""
    out = translated
    for p in P.DOLLARS:
        out = F.regexp_replace(out, p, "won")
    thousands = r"\d{1,3}(?:\.\d{3})+"
    out = let(out, lambda c: woven(F.split(c, thousands, -1), F.transform(matches(c, thousands), lambda m: F.replace(m, F.lit("."), F.lit(",")))))
    return F.when(source.rlike(r"(?U)\d[\d,]*\s*원"), out).otherwise(translated)


def translation_input(text: Column, glossary: Column) -> Column:
    """struct(text that a translator gets, kept: what its marks stand for): 100 characters, links and phones masked, terms injected."""
    short = F.substring(strip(text), 1, 100)
    return let(masked(short), lambda m: F.struct(injected(m["text"], hits(m["text"], glossary)).alias("text"), m["kept"].alias("kept")))


def checks(source: Column, translated: Column, found: Column) -> Column:
    """A row per hit: whether the source and the translation have the term; one row 'unchecked' without hits."""
    def flag(c: Column) -> Column:
        return F.when(c, "Y").otherwise("N")
    def row(g) -> Column:
        there = F.lower(translated).contains(F.lower(g["preferred"]))
        return F.struct(
            g["korean"].alias("korean_term"), g["preferred"].alias("preferred_term"), flag((F.coalesce(source, F.lit("")) == "") | source.contains(g["korean"])).alias("found_in_input"),
            flag(there).alias("found_in_translation"), F.when(there, "ok").otherwise("missing_term").alias("quality_label"), F.when(there, P.NOTE_OK).otherwise(P.NOTE_MISSING).alias("note"),
        )
    none = F.array(F.struct(F.lit("").alias("korean_term"), F.lit("").alias("preferred_term"), F.lit("N").alias("found_in_input"), F.lit("N").alias("found_in_translation"), F.lit("unchecked").alias("quality_label"), F.lit(P.NOTE_UNCHECKED).alias("note")))
    return F.when(F.size(found) == 0, none).otherwise(F.transform(found, row))


def roll_up(rows: Column) -> Column:
    """struct(label, note): review_needed with the missing terms, unchecked, or ok."""
    missing = F.filter(rows, lambda r: r["quality_label"] == "missing_term")
    notes = F.array_join(F.transform(missing, lambda r: F.concat(r["korean_term"], F.lit("->"), r["preferred_term"])), "; ")
    alone = (F.size(rows) == 1) & (F.get(rows, F.lit(0))["quality_label"] == "unchecked")
    return F.when(F.size(missing) > 0, F.struct(F.lit("review_needed").alias("label"), notes.alias("note"))).when(alone, F.struct(F.lit("unchecked").alias("label"), F.get(rows, F.lit(0))["note"].alias("note"))).otherwise(F.struct(F.lit("ok").alias("label"), F.lit("").alias("note")))


def error_row(message: str) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in (("korean_term", ""), ("preferred_term", ""), ("found_in_input", "N"), ("found_in_translation", "N"), ("quality_label", "glossary_error"), ("note", message))))


def fuzzy_match(preferred: Column, suggestion: Column) -> Column:
    """Equal, or one within the other, regardless of case and outer blanks."""
    p, s = strip(F.lower(preferred)), strip(F.lower(suggestion))
    return (p == s) | p.contains(s) | s.contains(p)


def sentence_with(text: Column, what: Column) -> Column:
    """The first sentence that has the term, or ''."""
    parts = F.filter(F.split(text, r"(?U)(?<=[.!?。！？])\s+|\n+", -1), lambda s: s.contains(what))
    return F.coalesce(strip(F.get(parts, F.lit(0))), F.lit(""))


