"""Text cleaning and sentence splitting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions import patterns as P


def let(c: Column, f) -> Column:
    """f of ``c`` with ``c`` computed once, however often f uses it: expressions that build on each other stay small."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def each(c: Column, f) -> Column:
    """f of every element of a column. Lambdas are interpreted; the only element, which most have, is taken without one."""
    return F.when(F.size(c) == 1, F.array(f(F.get(c, F.lit(0))))).otherwise(F.transform(c, f))


def strip(c: Column) -> Column:
    """Unicode blanks off both ends (``trim`` takes only U+0020)."""
    return F.btrim(c, F.lit(P.BLANKS))


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


CUT = "\ue002"  # of private use; a text that has it is cut by the pattern itself


LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029"  # and \n
SHORT_PIECES = rf"\A(?:[^{CUT}]{{0,3}}(?:{CUT}|\z))+|{CUT}[^{CUT}]{{0,3}}(?={CUT}|\z)"  # of three characters or fewer, each with a cut beside it


def pieces(c: Column, pattern: str) -> Column:
    """What lies between the matches of a pattern, none of which is empty. ``split`` compiles its pattern for each text,
    unless that is one plain character: matches become that first."""
    return F.when(c.contains(CUT), F.split(c, pattern, -1)).otherwise(F.split(F.regexp_replace(c, pattern, CUT), CUT, -1))


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def first_nonempty(*cs: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def normalize(c: Column) -> Column:
    """NUL as a blank; blanks and tabs within a line as one; at most one empty line in a row."""
    lines = F.transform(F.split(F.replace(c, F.lit("\x00"), F.lit(" ")), "\n", -1), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def flatten(c: Column) -> Column:
    """All blanks, line ends too, as one space."""
    # a single space, which most are, is left where it is
    return strip(F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit(" ")), r"(?U) \s++|[^\S ]\s*+", " "))


def clean(c: Column, squeeze: bool = False) -> Column:
    """NUL and CR out, blanks and tabs as one; with ``squeeze`` also at most one empty line in a row."""
    out = F.regexp_replace(F.regexp_replace(c, "[\x00\r]", ""), "[ \t]+", " ")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n") if squeeze else out)


def strip_markers(c: Column) -> Column:
    return strip(F.regexp_replace(c, P.MARKERS, ""))


def join_broken_lines(c: Column) -> Column:
    """A word cut by a line end is joined; a sentence that goes on in the next line gets a space."""
    joined = F.regexp_replace(F.regexp_replace(c, " ([가-힣])\n([가-힣])", " $1$2"), "([^.!?\n])\n([^\n])", "$1 $2")
    return strip(F.regexp_replace(F.when(c.contains("\n"), joined).otherwise(c), " [ \t]++|\t[ \t]*+", " "))


def _long_enough(parts: Column, more_than: int) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: F.char_length(s) > more_than)


def _lines(c: Column) -> Column:
    one = F.regexp_replace(c, f"[{LINE_ENDS}]", "\n")
    return F.filter(F.transform(F.split(one, "\n", -1), strip), lambda s: s != "")


def sentences(c: Column, plain: bool = False, drop_lines: bool = True, noise_anywhere: bool = False, stripped: bool = False) -> Column:
    """Sentences of a notice, longer than three characters. ``plain``: without cuts at list marks and labels.
    ``drop_lines``: headings and lines of a link, phone or time only are left out first; with ``noise_anywhere``
    also lines that have a link or phone somewhere. ``stripped``: the text has no outer blanks."""
    cut, noise = P.SENTENCE_CUT_PLAIN if plain else P.SENTENCE_CUT, P.NOISE_LINE_ANYWHERE if noise_anywhere else P.NOISE_LINE
    dropped = lambda s: s.rlike(P.HEADING_LINE) | s.rlike(noise)
    lines = F.filter(_lines(c), lambda s: ~dropped(s)) if drop_lines else _lines(c)
    many = _long_enough(F.flatten(F.transform(lines, lambda s: pieces(s, cut))), 3)
    # one line goes without a lambda; a cut takes all blanks, so that its pieces need no strip
    whole = c if stripped else strip(c)
    kept = F.regexp_replace(F.regexp_replace(whole, cut, CUT), SHORT_PIECES, "")
    single = F.array_remove(F.split(kept, CUT, -1), "")
    if drop_lines:
        single = F.when(dropped(whole), F.array().cast("array<string>")).otherwise(single)
    return F.when(c.rlike(f"[{LINE_ENDS}\n{CUT}]"), many).otherwise(single)


def sentences_by_mark(c: Column) -> Column:
    """Sentences by their closing marks, of the text with all blanks as one."""
    flat = flatten(F.coalesce(c, F.lit("")))
    return F.filter(F.transform(pieces(flat, P.SENTENCE_END), strip), lambda s: s != "")


def sentences_simple(c: Column) -> Column:
    return _long_enough(pieces(c, P.SENTENCE_CUT_SIMPLE), 3)


def clauses(c: Column, more_than: int = 8) -> Column:
    """Parts between full stops and line ends, longer than ``more_than``."""
    return _long_enough(F.split(c, "[.。\n]", -1), more_than)


def for_compare(c: Column) -> Column:
    """Blanks and separators as one space: the form in which card values are compared."""
    return strip(F.regexp_replace(c, r"(?U)[\s|｜:：]+", " "))


def keyword_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[|,;/]+", -1), strip), lambda s: s != "")


def shortened(c: Column, size: int = 100) -> Column:
    return F.when(F.char_length(c) > size, F.concat(F.substring(c, 1, size - 3), F.lit("..."))).otherwise(c)


def replace_phrases(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def word_ngrams(c: Column, least: int = 2, most: int = 4) -> Column:
    """Character n-grams within words padded by a blank on either side; a word shorter than n gives itself once."""
    padded = F.transform(F.filter(F.split(F.lower(c), r"(?U)\s+", -1), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    def grams(w: Column) -> Column:
        each = [F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - (n - 1), F.lit(1))), _substring(w, n)) for n in range(least, most + 1)]
        return F.concat(*(F.when((F.char_length(w) > n - 1) | (n == least), e).otherwise(F.array().cast("array<string>")) for n, e in zip(range(least, most + 1), each, strict=True)))
    return F.flatten(F.transform(padded, grams))


def _substring(w: Column, n: int):
    return lambda i: F.substring(w, i, F.lit(n))


RUN = 1000


def running(values: Column) -> Column:
    """Sums of an array's whole numbers up to each place.

    Sums are made in runs of RUN numbers and the runs' own sums added after that: an array that grows by one number
    at a time is copied each time, so that a long one in one go would cost the square of its length.
    """
    def sums(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        def step(acc, x):
            new = acc["sum"] + x
            return F.struct(new.alias("sum"), F.concat(acc["out"], F.array(new)).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])
    def of(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / RUN).cast("int") - 1), lambda b: sums(F.slice(v, b * RUN + 1, F.lit(RUN))))
        def whole(r: Column) -> Column:
            before = sums(F.transform(r, lambda x: F.element_at(x, -1)))
            return let(before, lambda t: F.flatten(F.transform(r, lambda x, b: F.transform(x, lambda n: n + F.coalesce(F.get(t, b - 1), F.lit(0))))))
        return let(runs, whole)
    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<bigint>")))


def sentences_of(c: Column, splitter: str = "notice", whole_lines: bool = False) -> Column:
    """The sentences that a named splitter finds: ``notice`` (lines and list marks), ``plain`` (closing marks in lines),
    ``mark`` (closing marks, all blanks as one) or ``simple`` (closing marks, where no other is at hand)."""
    found = {"notice": lambda: sentences(c, drop_lines=not whole_lines), "plain": lambda: sentences(c, plain=True, drop_lines=not whole_lines), "mark": lambda: sentences_by_mark(c), "simple": lambda: sentences_simple(c)}
    if splitter not in found:
        raise ValueError(f"no splitter {splitter}; there are {', '.join(found)}")
    return found[splitter]()


def offsets(c: Column, pattern: str) -> Column:
    """Zero-based [start, end) of all matches of a pattern, in order."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    def step(acc, m):
        at = F.call_function("locate", m, c, acc["at"])
        return F.struct((at + F.char_length(m)).alias("at"), F.concat(acc["out"], F.array(F.struct((at - 1).alias("start"), (at - 1 + F.char_length(m)).alias("end")))).alias("out"))
    return F.aggregate(matches(c, pattern), start, step, lambda acc: acc["out"])
