"""Markdown reports that executors put together and write.

A report is a table of lines (at: its place as an array of numbers, line).
Parts of a report are numbered, rows of a table take their place from an order
column and groups of rows from their first row, so a report is a union of small
aggregates and of rows as they are; nothing comes to the driver. One ordered
aggregation makes it a row; a report too long for that is written as lines in
ranges of their places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Titles, headings and marks of the reports that readers and the comparison of runs know.
AB_TITLE, AB_HEADINGS = "# A/B 번역 비교 결과", ["공지", "제목", "A입력(자)", "B입력(자)", "입력단축", "A시간(s)", "B시간(s)", "속도향상"]
DETAIL_HEADINGS, DETAIL_ROWS = ["항목", "A (원문 전체)", "B (TODO만)"], ["입력 글자수", "번역 시간", "입력 단축", "번역 청크", "속도향상"]
DETAIL_A, DETAIL_B, INPUT, TRANSLATION = "## A: 원문 전체", "## B: TODO만", "**입력:**", "**번역:**"
TERMS_TITLE, RATES, RATE_HEADINGS, TERMS, TERM_HEADINGS = "# 용어사전 전/후 번역 비교", "## 언어별 반영률 요약", ["언어", "반영", "누락", "반영률"], "## 용어별 상세 비교", ["언어", "NLLB 원번역", "용어사전 권장어", "반영"]
QUALITY_TITLE, MEANS, MEAN_HEADINGS = "# NLLB 번역 품질 평가 — 용어사전 전/후 비교", "## 언어별 평균 점수", ["언어", "전(NLLB) 평균", "후(용어사전 적용) 평균", "향상폭"]
SCORES, SCORE_HEADINGS = "## 용어별 상세 점수", ["언어", "NLLB 번역", "전 점수", "수정 번역", "역번역 이슈", "후 점수", "이유"]
DATASET_TITLE, NONE = "# 데이터셋 리포트", "—"


def fixed(spark: SparkSession, part: int, lines: list[str]) -> DataFrame:
    """Lines that are the same whatever the data."""
    return spark.createDataFrame([([part, i], x) for i, x in enumerate(lines)], "at array<bigint>, line string")


def row(*cells: Column | str) -> Column:
    """A row of a table; line ends and bars in a cell would break it."""
    safe = [F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\r\n|[\r\n]", " "), r"\|", r"\\|") if isinstance(c, Column) else F.lit(c) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |"))


def heading(names: list[str]) -> list[str]:
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]


def lines_of(df: DataFrame, part: int, line: Column, *order: str) -> DataFrame:
    """A line for each row, in the order of columns of whole numbers."""
    return df.select(F.array(F.lit(part).cast("long"), *(F.col(o).cast("long") for o in order)).alias("at"), line.alias("line"))


def stacked(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def text_of(lines: DataFrame) -> DataFrame:
    """One row, text: the report, put together by one ordered aggregation."""
    return lines.agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def write(lines: DataFrame, path: str, whole: bool = True) -> None:
    """Writes a report from the executors: one file, or with ``whole`` false as many as there are ranges of lines, named in their order."""
    if whole:
        text_of(lines).select(F.regexp_replace("text", r"\n\z", "").alias("value")).coalesce(1).write.mode("overwrite").text(path)
    else:
        lines.repartitionByRange("at").sortWithinPartitions("at").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_named(texts: DataFrame, path: str) -> None:
    """A folder name=... with one text file for each row (name, text)."""
    texts.select("name", F.col("text").alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def _shortened(c: str, size: int) -> Column:
    return F.when(F.char_length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(F.col(c))


def _first(df: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with place: the first order of all rows of a key. A key's first is looked up, so that a key of very many rows may be anywhere."""
    first = df.groupBy(F.col(key).alias("of_key")).agg(F.min(order).alias("place"))
    return df.join(first, F.col(key).eqNullSafe(F.col("of_key"))).drop("of_key")


def _by_term(df: DataFrame, part: int, order: str, headings: list[str], line: Column) -> DataFrame:
    """A section for each korean_term, in the order in which terms come first: its heading, its rows, an empty line."""
    d = _first(df, "korean_term", order)
    terms = d.groupBy("korean_term").agg(F.first("place").alias("place"))
    head = F.array(F.concat(F.lit("### "), "korean_term"), F.lit(""), *map(F.lit, heading(headings)))
    opening = terms.select("place", F.posexplode(head).alias("i", "line")).select(F.array(F.lit(part).cast("long"), F.col("place").cast("long"), F.lit(0).cast("long"), F.col("i").cast("long")).alias("at"), "line")
    rows = d.select(F.array(F.lit(part).cast("long"), F.col("place").cast("long"), F.lit(1).cast("long"), F.col(order).cast("long")).alias("at"), line.alias("line"))
    closing = terms.select(F.array(F.lit(part).cast("long"), F.col("place").cast("long"), F.lit(2).cast("long"), F.lit(0).cast("long")).alias("at"), F.lit("").alias("line"))
    return stacked(opening, rows, closing)


def ab_report(rows: DataFrame, lang: str, model: str, order: str = "pos") -> DataFrame:
    """Lines on two ways of translating the same notices (notice_id, title, a_chars, b_chars, input_reduction_pct, a_time_sec, b_time_sec, speedup_x)."""
    spark = rows.sparkSession
    line = row(F.col("notice_id"), F.substring("title", 1, 20), F.col("a_chars"), F.col("b_chars"), F.concat(F.lit("-"), "input_reduction_pct", F.lit("%")), F.col("a_time_sec"), F.col("b_time_sec"), F.concat(F.lit("x"), "speedup_x"))
    return stacked(fixed(spark, 0, [AB_TITLE, "", f"언어: {lang}  |  모델: {model}", "", *heading(AB_HEADINGS)]), lines_of(rows, 1, line, order))


def ab_details(rows: DataFrame) -> DataFrame:
    """name, text: a report on each notice, of its figures and of a_input, a_translation, b_input, b_translation."""
    cells = [
        (F.concat("a_chars", F.lit("자")), F.concat("b_chars", F.lit("자"))), (F.concat("a_time_sec", F.lit("초")), F.concat("b_time_sec", F.lit("초"))), (F.lit(NONE), F.concat(F.lit("-"), "input_reduction_pct", F.lit("%"))),
        (F.col("a_chunks"), F.col("b_chunks")), (F.lit(NONE), F.concat(F.lit("x"), "speedup_x")),
    ]
    table = [row(name, a, b) for name, (a, b) in zip(DETAIL_ROWS, cells, strict=True)]
    def quoted(c: str) -> Column:
        return F.concat(F.lit("```\n"), F.coalesce(F.col(c), F.lit("")), F.lit("\n```"))
    def side(title: str, k: str) -> list:
        return [F.lit(title), F.lit(""), F.concat(F.lit(f"{INPUT}\n"), quoted(f"{k}_input")), F.lit(""), F.concat(F.lit(f"{TRANSLATION}\n"), quoted(f"{k}_translation"))]
    parts = [F.concat(F.lit("# "), "notice_id", F.lit(" — "), "title"), F.lit(""), *map(F.lit, heading(DETAIL_HEADINGS)), *table, F.lit(""), *side(DETAIL_A, "a"), F.lit(""), *side(DETAIL_B, "b")]
    return rows.select(F.col("notice_id").cast("string").alias("name"), F.array_join(F.array(*(p.cast("string") for p in parts)), "\n").alias("text"))


def term_report(rows: DataFrame, langs: list[str], model: str, order: str = "pos") -> DataFrame:
    """Lines on which terms (lang, label, korean_term, nllb_translation, glossary_preferred, reflected, status) a translation has: rates by language, then term by term."""
    spark = rows.sparkSession
    n, hit = F.count_if(F.coalesce("glossary_preferred", F.lit("")) != ""), F.count_if(F.col("reflected") == "Y")
    rates = rows.groupBy("lang").agg(F.min_by("label", order).alias("label"), hit.alias("hit"), n.alias("n"), F.min(order).alias("place"))
    shown = F.when(F.col("n") > 0, F.format_string("%.0f%%", F.bround(F.col("hit") * 100.0 / F.col("n")))).otherwise(NONE)
    named = F.concat("lang", F.lit(" ("), "label", F.lit(")"))
    rate = row(named, F.col("hit"), F.col("n") - F.col("hit"), F.concat(F.lit("**"), shown, F.lit("**")))
    line = row(named, F.concat(F.substring("nllb_translation", 1, 40), F.lit("...")), F.when(F.coalesce("glossary_preferred", F.lit("")) == "", NONE).otherwise(F.col("glossary_preferred")), F.col("status"))
    return stacked(
        fixed(spark, 0, [TERMS_TITLE, "", f"모델: `{model}`  |  대상 언어: {', '.join(langs)}", "", RATES, "", *heading(RATE_HEADINGS)]), lines_of(rates, 1, rate, "place"),
        fixed(spark, 2, ["", "---", "", TERMS, ""]), _by_term(rows, 3, order, TERM_HEADINGS, line),
    )


def quality_report(rows: DataFrame, judge: str, translator: str, order: str = "pos") -> DataFrame:
    """Lines on a judge's scores before and after a term is set right (lang, lang_label, korean_term, nllb_translation,
    before_score, after_translation, roundtrip_issue, after_score, reason): means by language, then term by term."""
    spark = rows.sparkSession
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(20,4)")), 1)
    means = rows.groupBy("lang").agg(F.min_by("lang_label", order).alias("lang_label"), mean("before_score").alias("before"), mean("after_score").alias("after"), F.min(order).alias("place"))
    named = F.concat("lang", F.lit(" ("), "lang_label", F.lit(")"))
    points = lambda c: F.concat(F.format_string("%.1f", c.cast("double")), F.lit("점"))
    line = row(named, points(F.col("before")), points(F.col("after")), F.concat(F.lit("**+"), points(F.col("after") - F.col("before")), F.lit("**")))
    bold = lambda c: F.concat(F.lit("**"), c, F.lit("점**"))
    each = row(named, _shortened("nllb_translation", 35), bold("before_score"), _shortened("after_translation", 35), F.col("roundtrip_issue"), bold("after_score"), F.col("reason"))
    return stacked(
        fixed(spark, 0, [QUALITY_TITLE, "", f"평가 모델: `{judge}`  |  번역 모델: `{translator}`", "", MEANS, "", *heading(MEAN_HEADINGS)]), lines_of(means, 1, line, "place"),
        fixed(spark, 2, ["", "---", "", SCORES, ""]), _by_term(rows, 3, order, SCORE_HEADINGS, each),
    )


def table_report(title: str, parts: dict[str, tuple[DataFrame, list[str]]], intro: list[str] | None = None) -> DataFrame:
    """Lines of aggregated tables, each under its heading and in the order of columns of its own. Rows are numbered in their
    order by one window: these are tables that a reader goes through."""
    from pyspark.sql import Window as W

    spark = next(iter(parts.values()))[0].sparkSession
    out = [fixed(spark, 0, [title, "", *([*intro, ""] if intro else [])])]
    for k, (name, (df, order)) in enumerate(parts.items(), 1):
        numbered = df.select(F.struct("*").alias("row"), F.row_number().over(W.orderBy(*order)).alias("place"))
        line = row(*(F.col(f"row.`{c}`") for c in df.columns))
        out += [fixed(spark, 3 * k, [f"## {name}", "", *heading(df.columns)]), lines_of(numbered, 3 * k + 1, line, "place"), fixed(spark, 3 * k + 2, [""])]
    return stacked(*out)
