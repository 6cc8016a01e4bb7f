"""Rule categories, importance and to-do tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions import patterns as P
from noticeflow.functions.text import contains_any, strip


def has_money(c: Column) -> Column:
    return c.contains("원") & c.rlike(P.MONEY)


def has_date(c: Column) -> Column:
    return contains_any(c, ["월", ".", "/"]) & c.rlike(P.DATE_ANY)


def rejected(c: Column, least: int = 7, legacy: bool = False) -> Column:
    """Greetings, signatures and titles, and texts under ``least`` characters. ``legacy``: by the shorter list of the first form."""
    possible = contains_any(c, P.NOT_TODO_SIGNS) | c.rlike(P.NOT_TODO_STARTS)
    return (F.char_length(c) < least) | possible & c.rlike(P.U + "|".join(f"(?:{p})" for p in (P.NOT_TODO_LEGACY if legacy else P.NOT_TODO)))


def is_todo(probability: Column, threshold: float = 0.5) -> Column:
    """Whether a model takes a sentence for a to-do; not where it gave nothing."""
    return F.coalesce(probability >= threshold, F.lit(False))


def long_enough(c: Column, least: int = 7) -> Column:
    """Whether a sentence is long enough to be judged, outer blanks left out."""
    return F.char_length(strip(F.coalesce(c, F.lit("")))) >= least


def todo_label_id(label: Column) -> Column:
    """0 or 1 of a model's label: by its name, else by the number at its end; null for others."""
    names = F.create_map(*(F.lit(x) for kv in P.TODO_LABELS.items() for x in kv))
    return F.coalesce(F.element_at(names, label), F.nullif(F.element_at(F.split(label, "_"), -1), F.lit("")).try_cast("int"))


def category_id(label: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, P.CATEGORIES)), label), F.lit(0)).cast("int") - 1


def category_of_id(i: Column) -> Column:
    """The category of a number, the last one for numbers that name none."""
    return F.coalesce(F.get(F.array(*map(F.lit, P.CATEGORIES)), i.cast("int")), F.lit(P.OTHER))


def is_meal_plan(c: Column) -> Column:
    return c.rlike(P.MEAL_PLAN)


def is_greeting(c: Column) -> Column:
    return c.rlike(P.GREETING)


def category(c: Column) -> Column:
    """Money first, then the words of each category, then dates."""
    out = F.when(has_money(c), "비용")
    for name, words in P.RULE_WORDS:
        out = out.when(contains_any(c, words), name)
    return out.when(has_date(c) | (c.contains("월") & c.rlike(P.MONTH_ONLY)) | contains_any(c, P.SCHEDULE_WORDS), "일정").otherwise(P.OTHER)


def guess_category(c: Column) -> Column:
    """The offline pipeline's guess: the first category of which any word occurs."""
    return reduce(lambda out, kv: out.when(contains_any(c, kv[1]), kv[0]), P.GUESS_WORDS[1:], F.when(contains_any(c, P.GUESS_WORDS[0][1]), P.GUESS_WORDS[0][0])).otherwise(P.OTHER)


def _base(cat: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in P.BASE_IMPORTANCE.items() for x in (k, int(round(v * 100))))), cat), F.lit(50))


def importance(c: Column, cat: Column) -> Column:
    """Base of the category, five hundredths more each for urgency and a date, 1 at most. Counted in hundredths."""
    points = _base(cat) + F.when(contains_any(c, P.URGENT_WORDS), 5).otherwise(0) + F.when(has_date(c), 5).otherwise(0)
    return F.least(points, F.lit(100)) / F.lit(100.0)


def importance_legacy(c: Column, cat: Column, due: Column) -> Column:
    """Urgency has one word more, a due date counts instead of any date, and over 80 characters five hundredths go."""
    points = F.least(_base(cat) + F.when(contains_any(c, [*P.URGENT_WORDS, "신고"]), 5).otherwise(0), F.lit(100))
    points = F.least(points + F.when(F.coalesce(due, F.lit("")) != "", 5).otherwise(0), F.lit(100))
    return F.greatest(points - F.when(F.char_length(c) > 80, 5).otherwise(0), F.lit(0)) / F.lit(100.0)


def todo_label(c: Column, keywords: Column) -> Column:
    """1 where a keyword of eight characters or more occurs in a sentence that is not rejected."""
    return F.when(rejected(c), 0).when(F.exists(keywords, lambda k: (F.char_length(k) >= 8) & c.contains(k)), 1).otherwise(0)


def todo_score(c: Column) -> Column:
    """Rule stand-in for a to-do model's probability; null for rejected sentences."""
    return F.when(~rejected(c), todo_points(c))


def todo_points(c: Column) -> Column:
    """``todo_score`` of sentences that are known not to be rejected."""
    signs = [contains_any(c, [w for p, _ in P.ACTIONS for w in p.split("|")]), has_date(c), has_money(c), c.contains("까지"), contains_any(c, ["주세요", "바랍니다", "십시오"])]
    hits = reduce(lambda a, b: a + b, (F.when(s, 1).otherwise(0) for s in signs))
    return F.least(F.lit(0.25) + hits * 0.18, F.lit(0.99))
