"""Easy Korean: words replaced as a whole, sentences ended politely, dates and amounts left alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions import patterns as P
from noticeflow.functions.text import contains_any, let, matches, pieces, strip

EASY_MARK = "\ue000%d\ue001"  # private-use characters, which no letter rule touches


def woven(rest: Column, pieces: Column) -> Column:
    """rest[0] pieces[0] rest[1] ...: what a split left, with something new in the cuts."""
    return F.array_join(F.transform(rest, lambda r, i: F.concat(r, F.coalesce(F.get(pieces, i), F.lit("")))), "")


def protect(c: Column, pattern: str, mark: str = EASY_MARK, first: Column | int = 0) -> Column:
    """struct(text with a numbered mark for each match, kept: the matches). Numbers start at ``first``."""
    before, after = mark.split("%d")
    start = F.lit(first) if isinstance(first, int) else first
    def of(c: Column) -> Column:
        found = matches(c, pattern)
        names = F.transform(found, lambda _, i: F.concat(F.lit(before), (i + start).cast("string"), F.lit(after)))
        some = F.struct(woven(pieces(c, pattern), names).alias("text"), found.alias("kept"))
        return F.when(c.rlike(pattern), some).otherwise(F.struct(c.alias("text"), F.when(c.isNotNull(), F.array().cast("array<string>")).alias("kept")))
    return let(c, of)


def restore(c: Column, kept: Column, mark: str = EASY_MARK) -> Column:
    """Each numbered mark replaced by what it stands for, in one pass; unknown numbers stay."""
    before, after = mark.split("%d")
    pattern = rf"\Q{before}\E(\d+)\Q{after}\E"
    def of(c: Column) -> Column:
        known = F.transform(matches(c, pattern), lambda m: F.coalesce(F.get(kept, F.coalesce(F.regexp_extract(m, pattern, 1).try_cast("int"), F.lit(-1))), m))
        return F.when(F.size(kept) > 0, woven(pieces(c, pattern), known)).otherwise(c)
    return let(c, of)


def _replaced(word: str, pattern: str, easy: str):
    return lambda c: F.when(c.contains(word), F.regexp_replace(c, pattern, easy)).otherwise(c)


def replace_words(c: Column) -> Column:
    """Words that stand alone; next to a mark they do not."""
    near = P.EASY_LETTER[:-1] + "\ue000\ue001]"
    for word, easy in P.EASY_WORDS:
        if easy != word:
            c = let(c, _replaced(word, f"(?<!{near}){word}(?!{near})", easy))
    return c


def polite_ending(c: Column) -> Column:
    def ended(c: Column, body: Column, mark: Column, stem: Column) -> Column:
        out = F.when((body == "") | body.rlike(P.POLITE_END), c)
        for end, full in P.ENDINGS:
            out = out.when(F.endswith(stem, F.lit(end)), F.concat(F.left(stem, F.char_length(stem) - len(end)), F.lit(full), mark))
        return out.otherwise(c)
    def parts(body: Column) -> Column:
        closed = body.rlike(r"[.!?]\z")
        return F.struct(body.alias("body"), F.when(closed, F.right(body, F.lit(1))).otherwise("").alias("mark"), F.when(closed, F.regexp_replace(body, r"(?U)\s*[.!?]\z", "")).otherwise(body).alias("stem"))
    return let(c, lambda c: let(let(strip(c), parts), lambda x: ended(c, x["body"], x["mark"], x["stem"])))


def may_change(c: Column) -> Column:
    """Whether the easy form of a text can be another one: it has a word that is replaced, ends in need of a polite form, or has a mark.
    What is protected begins with a digit and ends with a letter or digit, so that no word stands alone for its mark only."""
    words = [w for w, e in P.EASY_WORDS if e != w]
    alone = f"(?:{'|'.join(words)})(?!{P.EASY_LETTER[:-1]}\ue000\ue001])(?<!{P.EASY_LETTER[:-1]}\ue000\ue001](?:{'|'.join(words)}))"
    ends = [e for e, _ in P.ENDINGS]
    ending = rf"(?:{'|'.join(rf'\Q{e}\E' for e in ends)})[{P.BLANKS}.!?]*+\z"
    return contains_any(c, words) & c.rlike(alone) | contains_any(c, ends) & c.rlike(ending) | c.contains("\ue000")


def easy_korean(c: Column) -> Column:
    return F.when(~may_change(c), c).otherwise(let(let(c, lambda c: protect(c, P.EASY_KEPT)), lambda p: restore(polite_ending(replace_words(p["text"])), p["kept"])))
