"""Dates, times, amounts, links, phones, deadlines and supplies of a text, as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import patterns as P
from noticeflow.functions.text import contains_any, each, let, matches, pieces, strip, strip_markers

DATE = "struct<ko:string,year:int,month:int,day:int,weekday:string,relative:string>"
TIME = "struct<ko:string,hour:int,minute:int,ampm:string>"


def _where(possible: Column, found: Column, kind: str) -> Column:
    """What was found in texts that can have any, which a look for a few letters tells; else none."""
    return F.when(possible, found).otherwise(F.array().cast(f"array<{kind}>"))


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def _group(m: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(m, pattern, group)


def _date(m: Column, pattern: str, year: int | None, month: int, day: int, weekday: int) -> Column:
    y = _int(_group(m, pattern, year)) if year else F.lit(None).cast("int")
    return F.struct(m.alias("ko"), y.alias("year"), _int(_group(m, pattern, month)).alias("month"), _int(_group(m, pattern, day)).alias("day"), F.nullif(_group(m, pattern, weekday), F.lit("")).alias("weekday"), F.lit(None).cast("string").alias("relative")).cast(DATE)


def _locate(what: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", what, text, start)


def _new_month_days(text: Column, seen: Column, found: Column, some: Column) -> Column:
    """Of the found month-day surfaces those that lie in none of the first places of the surfaces seen so far, each once. ``some``: all found
    surfaces of the kind seen so far. The only month-day in a text of one full date is the end of that."""
    start = F.struct(F.lit(1).alias("at"), seen.alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc, m):
        at = _locate(m, text, acc["at"])
        end = at + F.char_length(m)
        inside = F.exists(acc["seen"], lambda s: (at >= _locate(s, text, F.lit(1))) & (end <= _locate(s, text, F.lit(1)) + F.char_length(s)))
        fresh = F.when(inside | F.array_contains(acc["seen"], m), F.array().cast("array<string>")).otherwise(F.array(m))
        return F.struct(end.alias("at"), F.concat(acc["seen"], fresh).alias("seen"), F.concat(acc["out"], fresh).alias("out"))

    none = F.array().cast("array<string>")
    return (
        F.when(F.size(found) == 0, none).when((F.size(found) == 1) & (F.size(some) == 1), none)
        .when((F.size(F.array_distinct(found)) == 1) & (F.size(seen) == 0), F.array_distinct(found)).otherwise(F.aggregate(found, start, step, lambda acc: acc["out"]))
    )


def _surfaces(text: Column) -> dict[str, Column]:
    """All matches of the kinds of dates in a text."""
    day = text.contains("일")
    return {
        "full": _where(day & text.contains("년"), matches(text, P.DATE_FULL), "string"), "month_day": _where(day & text.contains("월"), matches(text, P.DATE_MONTH_DAY), "string"),
        "dotted": _where(text.contains("("), matches(text, P.DATE_DOTTED), "string"),
    }


def _relative(word: str) -> Column:
    return F.struct(F.lit(word).alias("ko"), *(F.lit(None).cast("int").alias(x) for x in ("year", "month", "day")), F.lit(None).cast("string").alias("weekday"), F.lit(word).alias("relative")).cast(DATE)


def _dates(text: Column, full: Column, some: Column, dotted: Column, made, only: Column | None = None) -> Column:
    """What ``made`` makes of each date: of surfaces found in a text, then of the relative words there. ``only``: the array of what it makes of
    the only surface; null where there are others."""
    kinds = [(full, P.DATE_FULL, (1, 2, 3, 4)), (some, P.DATE_MONTH_DAY, (None, 1, 2, 3)), (dotted, P.DATE_DOTTED, (1, 2, 3, 4))]
    of = lambda pattern, parts: lambda m: made(_date(m, pattern, *parts))
    words = [F.when(text.contains(w), F.array(made(_relative(w)))).otherwise(F.slice(F.array(made(_relative(w))), 1, 0)) for w in P.RELATIVE_DAYS]
    surfaces = F.concat(*(each(found, of(pattern, parts)) for found, pattern, parts in kinds))
    surfaces = surfaces if only is None else F.coalesce(only, surfaces)
    return F.when(contains_any(text, P.RELATIVE_SIGNS), F.concat(surfaces, *words)).otherwise(surfaces)


def dates(text: Column) -> Column:
    """Full dates, then month and day, then dotted dates with a weekday, then relative words; each surface once."""
    def with_some(text: Column, s: Column, full: Column) -> Column:
        def with_all(some: Column) -> Column:
            return let(F.array_except(F.array_distinct(s["dotted"]), F.concat(full, some)), lambda dotted: _dates(text, full, some, dotted, lambda d: d))
        return let(_new_month_days(text, full, s["month_day"], s["full"]), with_all)
    def found(text: Column) -> Column:
        return let(F.struct(*(c.alias(k) for k, c in _surfaces(text).items())), lambda s: let(F.array_distinct(s["full"]), lambda full: with_some(text, s, full)))
    possible = text.contains("일") | text.contains("(") | F.lit(False)
    for w in P.RELATIVE_DAYS:
        possible = possible | text.contains(w)
    return _where(possible, let(text, found), DATE)


def _once(c: Column) -> Column:
    return F.when(F.size(c) > 1, F.array_distinct(c)).otherwise(c)


def _only_date(m: Column, numbers: Column, weekday: Column) -> Column:
    """The date of a surface by its numbers, which something else parts in each kind."""
    return F.struct(m.alias("ko"), *(_int(F.get(numbers, F.size(numbers) - k)).alias(x) for k, x in ((3, "year"), (2, "month"), (1, "day"))), F.nullif(weekday, F.lit("")).alias("weekday"), F.lit(None).cast("string").alias("relative")).cast(DATE)


def with_found(df: DataFrame, text: str, made: dict) -> DataFrame:
    """Adds the columns dates, times, amounts, urls and phones of a text: arrays of what the functions of ``made`` make of each value (by
    default the value). As ``dates`` and so on, but in steps of columns: each is computed once without lambdas, which are interpreted."""
    t, same = F.col(text), lambda x: x
    own = lambda k: made.get(k, same)
    raw = {**_surfaces(t), "half": _halves(t), "clock": _clocks(t), "won": _wons(t), "unit": _units(t), "url": _where(t.contains(":") | t.contains("."), matches(t, P.URL), "string"), "phone": _phones(t)}
    df = df.withColumns({f"_{k}": c for k, c in raw.items()})
    once = {k: _once(F.col(f"_{k}")) for k in ("half", "clock", "won", "unit", "phone")}
    df = df.withColumns({"_some": _new_month_days(t, F.array_distinct("_full"), F.col("_month_day"), F.col("_full")), "_dates": _once(F.col("_full")), "_links": each(F.col("_url"), _link), **{f"_{k}": c for k, c in once.items()}})
    df = df.withColumns({"_other": F.when(F.size("_dotted") > 0, F.array_except(F.array_distinct("_dotted"), F.concat("_dates", "_some"))).otherwise(F.col("_dotted")), "_links": _once(F.col("_links"))})
    df = df.withColumn("_n", F.size("_dates") + F.size("_some") + F.size("_other"))
    df = df.withColumn("_one", F.when(F.col("_n") == 1, F.coalesce(*(F.get(F.col(c), F.lit(0)) for c in ("_dates", "_some", "_other")))))
    # the only date of a text has its parts from one look
    df = df.withColumns({"_numbers": F.when(F.col("_n") == 1, matches(F.col("_one"), P.NUMBERS)), "_weekday": F.when(F.col("_one").contains(")"), F.regexp_extract("_one", P.WEEKDAY_END, 1))})
    only = own("dates")(_only_date(F.col("_one"), F.col("_numbers"), F.col("_weekday")))
    df = df.withColumns({
        "dates": _dates(t, F.col("_dates"), F.col("_some"), F.col("_other"), own("dates"), F.when(F.col("_n") == 1, F.array(only))),
        "times": F.concat(each(F.col("_half"), lambda m: own("times")(_half(m))), each(F.col("_clock"), lambda m: own("times")(_clock(m)))),
        "amounts": F.concat(each(F.col("_won"), lambda m: own("amounts")(_amount(m, _won(m)))), each(F.col("_unit"), lambda m: own("amounts")(_amount(m, _thousands(m))))),
        "urls": each(F.col("_links"), own("urls")), "phones": each(F.col("_phone"), own("phones")),
    })
    return df.drop(*(f"_{k}" for k in raw), "_some", "_dates", "_links", "_other", "_n", "_one", "_numbers", "_weekday")


def _first(text: Column, possible: Column, pattern: str, made) -> Column:
    """What is made of the first match of a pattern, or null."""
    return F.when(possible, let(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", made(m))))


def first_date(text: Column) -> Column:
    """The first of ``dates``, or null, without a look for the others."""
    day = text.contains("일")
    words = [F.when(text.contains(w), _relative(w)) for w in P.RELATIVE_DAYS]
    return F.coalesce(
        _first(text, day & text.contains("년"), P.DATE_FULL, lambda m: _date(m, P.DATE_FULL, 1, 2, 3, 4)),
        _first(text, day & text.contains("월"), P.DATE_MONTH_DAY, lambda m: _date(m, P.DATE_MONTH_DAY, None, 1, 2, 3)),
        _first(text, text.contains("("), P.DATE_DOTTED, lambda m: _date(m, P.DATE_DOTTED, 1, 2, 3, 4)), *words,
    )


def first_time(text: Column) -> Column:
    """The first of ``times``, or null."""
    return F.coalesce(_first(text, text.contains("시"), P.TIME_HALF_DAY, _half), _first(text, text.contains(":"), P.TIME_24H, _clock))


def times(text: Column) -> Column:
    """Times with the half of the day, then those of 24 hours; each surface once."""
    return _where(text.contains("시") | text.contains(":"), _times(text), TIME)


def _half(m: Column) -> Column:
    return F.struct(m.alias("ko"), _int(_group(m, P.TIME_HALF_DAY, 2)).alias("hour"), F.coalesce(_int(_group(m, P.TIME_HALF_DAY, 3)), F.lit(0)).alias("minute"), _group(m, P.TIME_HALF_DAY, 1).alias("ampm")).cast(TIME)


def _clock(m: Column) -> Column:
    return F.struct(m.alias("ko"), _int(F.split(m, ":")[0]).alias("hour"), _int(F.split(m, ":")[1]).alias("minute"), F.lit(None).cast("string").alias("ampm")).cast(TIME)


def _halves(text: Column) -> Column:
    return _where(text.contains("시"), matches(text, P.TIME_HALF_DAY), "string")


def _clocks(text: Column) -> Column:
    return _where(text.contains(":"), matches(text, P.TIME_24H), "string")


def _times(text: Column) -> Column:
    # no time of one kind is one of the other
    return F.concat(F.transform(F.array_distinct(_halves(text)), _half), F.transform(F.array_distinct(_clocks(text)), _clock))


def _won(m: Column) -> Column:
    return F.nullif(F.replace(_group(m, P.AMOUNT_WON, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("bigint")


def amounts(text: Column) -> Column:
    """Amounts in won, then those with a unit of thousands and above; each surface once."""
    return _where(text.contains("원"), _amounts(text), "struct<ko:string,value:bigint,currency:string>")


def _wons(text: Column) -> Column:
    return _where(text.contains("원"), matches(text, P.AMOUNT_WON), "string")


def _units(text: Column) -> Column:
    return _where(text.contains("원") & contains_any(text, list(P.UNITS)), matches(text, P.AMOUNT_UNIT), "string")


def _amount(m: Column, value: Column) -> Column:
    return F.struct(m.alias("ko"), value.cast("bigint").alias("value"), F.lit("KRW").alias("currency"))


def _thousands(m: Column) -> Column:
    factors = F.create_map(*(F.lit(x) for kv in P.UNITS.items() for x in kv))
    return _group(m, P.AMOUNT_UNIT, 1).try_cast("bigint") * F.element_at(factors, _group(m, P.AMOUNT_UNIT, 2))


def _amounts(text: Column) -> Column:
    # no amount of one kind is one of the other: a unit stands between digits and won
    return F.concat(F.transform(F.array_distinct(_wons(text)), lambda m: _amount(m, _won(m))), F.transform(F.array_distinct(_units(text)), lambda m: _amount(m, _thousands(m))))


def _link(m: Column) -> Column:
    return F.rtrim(m, F.lit(".,)]"))


def urls(text: Column) -> Column:
    return _where(text.contains(":") | text.contains("."), F.array_distinct(F.transform(matches(text, P.URL), _link)), "string")


def _phones(text: Column) -> Column:
    return _where(text.contains("-"), matches(text, P.PHONE), "string")


def phones(text: Column) -> Column:
    return F.array_distinct(_phones(text))


def masked_urls(text: Column) -> Column:
    """Links as marks of the same length, without any full stop."""
    def of(text: Column) -> Column:
        marks = F.transform(matches(text, P.URL), lambda m: F.concat(F.lit("⟦U"), F.repeat(F.lit("_"), F.char_length(m) - 3), F.lit("⟧")))
        masked = F.array_join(F.transform(pieces(text, P.URL), lambda r, i: F.concat(r, F.coalesce(F.get(marks, i), F.lit("")))), "")
        return F.when(text.rlike(P.URL), masked).otherwise(text)
    return let(text, of)


def deadline_phrases(text: Column) -> Column:
    """Phrases around the word for 'until', up to a full stop, line end or mark."""
    parts = F.filter(pieces(masked_urls(text), P.DEADLINE_CUT), lambda s: s.contains(P.DEADLINE))
    return F.when(text.contains(P.DEADLINE), F.transform(parts, strip)).when(text.isNotNull(), F.array().cast("array<string>"))


def supplies(text: Column) -> Column:
    """Items of a list of things to bring, of 2 to 29 characters."""
    body = F.regexp_replace(F.regexp_replace(text, P.SUPPLY_LABEL, ""), P.SUPPLY_TAIL, "")
    parts = F.transform(pieces(body, P.SUPPLY_CUT), strip)
    return F.filter(parts, lambda s: (F.char_length(s) > 1) & (F.char_length(s) < 30))


def due_date(text: Column, year: Column | int) -> Column:
    """Month and day as ``year``-MM-DD (not checked), else a relative day, else a phrase of under 20 characters before 'until'."""
    part = lambda m, k: _int(F.regexp_extract(m, P.DUE_PARTS, k))
    absolute = lambda m: F.when(m != "", F.format_string("%d-%02d-%02d", F.lit(year) if isinstance(year, int) else year, part(m, 1), part(m, 2)))
    short = lambda u: F.when((u != "") & (F.char_length(u) < 20), u)
    return F.coalesce(
        F.when(contains_any(text, ["월", ".", "/"]), let(F.regexp_extract(text, P.DUE_ABSOLUTE, 0), absolute)),
        F.when(contains_any(text, ["주", "오늘", "내일", "모레"]), let(strip(F.regexp_extract(text, P.DUE_RELATIVE, 1)), lambda r: F.nullif(r, F.lit("")))),
        F.when(text.contains("까지"), let(strip(F.regexp_extract(text, P.DUE_UNTIL, 1)), short)),
    )


def amount(text: Column) -> Column:
    """The first amount in won, as a number."""
    return _won(F.regexp_extract(text, P.AMOUNT_WON, 0))


def first_amount(text: Column) -> Column:
    """The first of all amounts as it is written; null without one."""
    return F.get(amounts(text), F.lit(0))["ko"]


def first_deadline(text: Column) -> Column:
    """The first phrase around the word for 'until' as it is written; null without one."""
    return F.get(deadline_phrases(text), F.lit(0))


def action(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, hint in reversed(P.ACTIONS):
        out = F.when(contains_any(text, pattern.split("|")), hint).otherwise(out)
    return out
