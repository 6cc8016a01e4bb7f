"""Judges of translations, and suggestions for glossary terms, around a language model's seam."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.text import strip
from noticeflow.operators.evals import clamp, fenced_json, suggestion_status
from noticeflow.operators.seams import judge, with_model
from noticeflow.runtime import staged

AB_TEXTS = ["a_back_translation_ko", "b_back_translation_ko", "roundtrip_issues", "a_issues", "b_issues", "verdict"]
AB_ANSWER = "a_score string, b_score string, " + ", ".join(f"{c} string" for c in AB_TEXTS)
TERM_ANSWER = "before_score string, after_translation string, after_back_translation_ko string, roundtrip_issue string, after_score string, reason string"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def ab_prompt(lang_label: str) -> Column:
    fields = ", ".join(AB_ANSWER.replace(" string", "").split(", "))
    return F.concat(
        F.lit(f"Rate two translations of a school notice into {lang_label}, from 0 to 100 each, for meaning, natural wording, and whether dates, times, amounts, items and deadlines are kept.\nA, the whole text:\n"),
        _text("a_input"), F.lit("\nis translated as\n"), _text("a_translation"), F.lit("\nB, the actions only:\n"), _text("b_input"), F.lit("\nis translated as\n"), _text("b_translation"),
        F.lit(f"\nAnswer with one JSON object of the fields {fields}."),
    )


def _judged(asked: DataFrame, answer: str, call: Callable, **more) -> tuple[DataFrame, DataFrame]:
    """(rows with the parsed answer, rows that failed with what the judge said and the error of the call), from one round of calls."""
    done = staged(judge(asked, "prompt", call, **more).withColumn("parsed", fenced_json(F.col("answer"), answer)), "judged")
    return done.filter("parsed is not null"), done.filter("parsed is null").drop("prompt", "parsed")


def judged_ab(df: DataFrame, lang_label: str, call: Callable, **more) -> tuple[DataFrame, DataFrame]:
    """(answers, failures). Answers: rows (notice_id, title, a_input, a_translation, b_input, b_translation) with what a judge
    says of them: lengths, scores from 0 to 100, back translations, issues and verdict. Failures: the rows whose call
    failed or whose answer has no JSON object, with answer and answer_error.

    Rows with a missing translation are not asked about and are in neither.
    """
    asked = df.filter((_text("a_translation") != "") & (_text("b_translation") != "")).withColumn("prompt", ab_prompt(lang_label))
    done, failed = _judged(asked, AB_ANSWER, call, **more)
    return done.select(
        "notice_id", _text("title").alias("title"), F.char_length(_text("a_input")).alias("a_chars"), F.char_length(_text("b_input")).alias("b_chars"), clamp(F.col("parsed.a_score"), 100).alias("a_score"), clamp(F.col("parsed.b_score"), 100).alias("b_score"),
        *(F.coalesce(f"parsed.{c}", F.lit("")).alias(c) for c in AB_TEXTS), "a_input", "a_translation", "b_input", "b_translation",
    ), failed


def judge_ab(df: DataFrame, lang_label: str, call: Callable, **more) -> DataFrame:
    """The answers of ``judged_ab``."""
    return judged_ab(df, lang_label, call, **more)[0]


def judged_terms(df: DataFrame, call: Callable, **more) -> tuple[DataFrame, DataFrame]:
    """(answers, failures) for rows (lang, korean_term, sentence, nllb_translation, glossary_preferred): scores before
    (100 at most) and after (95 at most) the term is set right. Rows without a preferred term are not asked about and are in neither."""
    p = F.concat(
        F.lit("Rate a machine translation of a sentence from 0 to 100, correct only the term in it, and rate the result, 95 at most.\nsentence: "), _text("sentence"), F.lit("\nterm: "), _text("korean_term"), F.lit(" -> "), strip(_text("glossary_preferred")),
        F.lit("\ntranslation: "), _text("nllb_translation"), F.lit(f"\nAnswer with one JSON object of the fields {TERM_ANSWER.replace(' string', '')}."),
    )
    asked = df.filter(strip(_text("glossary_preferred")) != "").withColumn("prompt", p)
    done, failed = _judged(asked, TERM_ANSWER, call, **more)
    return done.select(
        "lang", "korean_term", "sentence", "nllb_translation", strip(F.col("glossary_preferred")).alias("glossary_preferred"), clamp(F.col("parsed.before_score"), 100).alias("before_score"), clamp(F.col("parsed.after_score"), 95).alias("after_score"),
        *(F.coalesce(f"parsed.{c}", F.lit("")).alias(c) for c in ("after_translation", "after_back_translation_ko", "roundtrip_issue", "reason")),
    ), failed


def judge_terms(df: DataFrame, call: Callable, **more) -> DataFrame:
    """The answers of ``judged_terms``."""
    return judged_terms(df, call, **more)[0]


def by_language(df: DataFrame, langs: list[str], lang: str = "lang") -> DataFrame:
    """Each row once for each of the languages, which are a constant: no join, and the rows stay where they are."""
    return df.select("*", F.explode(F.array(*map(F.lit, langs))).alias(lang))


def suggest_terms(terms: DataFrame, lang: str, call: Callable, **more) -> DataFrame:
    """korean, suggestion for each different term: ``call(rows of (term, language))`` gets 150 at most; '' where it fails."""
    asked = terms.select(F.col("korean")).filter(F.col("korean").isNotNull()).distinct().withColumn("lang", F.lit(lang))
    return with_model(asked, ["korean", "lang"], "suggestion", T.StringType(), call, default="", **{"batch": 150, **({} if "limits" in more else {"retries": 3, "wait": 1.0}), **more}).select("korean", F.coalesce("suggestion", F.lit("")).alias("suggestion"))


def with_suggestions(missing: DataFrame, suggestions: DataFrame, key: str = "korean_term") -> DataFrame:
    """Every missing term with its suggestion, '' without one. Of repeated suggestions for a term the greatest counts."""
    s = suggestions.groupBy(F.col("korean").alias("_k")).agg(F.max("suggestion").alias("suggestion"))
    return missing.join(s, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("suggestion", F.coalesce("suggestion", F.lit("")))


def review_terms(glossary: DataFrame, suggestions: DataFrame, preferred: str) -> DataFrame:
    """Glossary rows with suggestion and status: match, mismatch or no_response."""
    rows = with_suggestions(glossary, suggestions, "korean")
    return rows.withColumn("status", suggestion_status(strip(_text(preferred)), F.col("suggestion")))


def status_shares(reviewed: DataFrame) -> DataFrame:
    """status, n, pct (one digit) for each of the three states, those that do not occur too."""
    states = ["match", "mismatch", "no_response"]
    one = reviewed.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in states))
    rows = F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in states))
    return one.select("total", F.inline(rows)).select("status", "n", F.when(F.col("total") > 0, F.round(F.col("n") * 100.0 / F.col("total"), 1)).otherwise(0.0).alias("pct"))
