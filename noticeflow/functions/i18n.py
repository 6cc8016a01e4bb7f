"""Dates, times and amounts in the reader's language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions import patterns as P


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def by_language(lang: Column, cases: dict[str, Column], default: Column) -> Column:
    out = default
    for k, v in cases.items():
        out = F.when(lang == k, v).otherwise(out)
    return out


def _s(c: Column) -> Column:
    return c.cast("string")


def format_date(d: Column, lang: Column) -> Column:
    """Of a date struct. A month above 12 has no English name: the surface stays."""
    y, m, day, w = d["year"], d["month"], d["day"], d["weekday"]
    slashed = F.concat(_s(day), F.lit("/"), _s(m), F.coalesce(F.concat(F.lit("/"), _s(y)), F.lit("")))
    weekday = lambda table: F.coalesce(F.concat(F.lit(" ("), _lookup(table, w), F.lit(")")), F.lit(""))
    month = F.get(F.array(*map(F.lit, P.MONTHS)), m - 1)
    absolute = by_language(lang, {
        "vi": F.concat(F.lit("Ngày "), slashed, weekday(P.WEEKDAYS["vi"])),
        "en": F.coalesce(F.concat(month, F.lit(" "), _s(day), F.coalesce(F.concat(F.lit(", "), _s(y)), F.lit("")), weekday(P.WEEKDAYS["en"])), d["ko"]),
        "zh": F.concat(_s(m), F.lit("月"), _s(day), F.lit("日"), F.coalesce(F.concat(F.lit(" ("), w, F.lit(")")), F.lit(""))),
        "ja": F.concat(_s(m), F.lit("月"), _s(day), F.lit("日"), F.coalesce(F.concat(F.lit(" ("), w, F.lit(")")), F.lit(""))),
        "ko_easy": d["ko"],
    }, slashed)
    relative = by_language(lang, {k: F.coalesce(_lookup(v, d["relative"]), d["ko"]) for k, v in P.RELATIVE.items()}, d["ko"])
    known = (F.coalesce(m, F.lit(0)) != 0) & (F.coalesce(day, F.lit(0)) != 0)
    return F.when(d["relative"].isNotNull(), relative).when(known, absolute).otherwise(d["ko"])


def format_time(t: Column, lang: Column) -> Column:
    h, minute, half = _s(t["hour"]), t["minute"], t["ampm"]
    two = F.lpad(_s(minute), 2, "0")
    pick = lambda am, pm: F.when(half == "오전", am).when(half == "오후", pm).otherwise("")
    clock = F.concat(h, F.lit(":"), two)
    out = by_language(lang, {
        "vi": F.concat(h, F.lit(" giờ"), F.when(minute != 0, F.concat(F.lit(" "), _s(minute))).otherwise(""), pick(" sáng", " chiều")),
        "en": F.concat(clock, pick(" AM", " PM")),
        "zh": F.concat(pick("上午", "下午"), h, F.lit("时"), two, F.lit("分")),
        "ja": F.concat(pick("午前", "午後"), h, F.lit("時"), two, F.lit("分")),
        "ko_easy": t["ko"],
    }, clock)
    return F.when(t["hour"].isNull(), t["ko"]).otherwise(out)


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def format_amount(value: Column, lang: Column) -> Column:
    return F.concat(with_commas(value), F.coalesce(_lookup(P.WON_SUFFIX, lang), F.lit(" won")))


def nllb_code(lang: Column) -> Column:
    return F.coalesce(_lookup(P.NLLB_CODES, lang), F.lit(P.NLLB_CODES["vi"]))


def voice(lang: Column) -> Column:
    """The name of a language's voice, '' for others."""
    return F.coalesce(_lookup(P.VOICES, lang), F.lit(""))
