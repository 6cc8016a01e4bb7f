"""Markdown reports compared with their texts, and exact medians by ranges."""

import glob
import random
import statistics

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import corpus, markdown, reports
from noticeflow.sources import files

AB = "pos int, notice_id string, title string, a_chars int, b_chars int, a_time_sec double, b_time_sec double, a_chunks int, b_chunks int, a_input string, a_translation string, b_input string, b_translation string"


def test_ab(spark, tmp_path):
    rows = [(1, "N2", "봄 소풍 | 안내 말씀을 드립니다 학부모님께", 200, 50, 4.0, 1.0, 2, 1, "원문\n둘째", "bản", "할 일", "việc"), (0, "N1", "짧은", 100, 90, 0.5, 0.0, 1, 1, "가", "나", "다", "라")]
    df = reports.run_costs(spark.createDataFrame(rows, AB).withColumnsRenamed({"a_time_sec": "a_time", "b_time_sec": "b_time"})).withColumnsRenamed({"a_time": "a_time_sec", "b_time": "b_time_sec"})
    lines = markdown.ab_report(df, "vi", "model")
    want = (
        "# A/B 번역 비교 결과\n\n언어: vi  |  모델: model\n\n| 공지 | 제목 | A입력(자) | B입력(자) | 입력단축 | A시간(s) | B시간(s) | 속도향상 |\n|---|---|---|---|---|---|---|---|\n"
        "| N1 | 짧은 | 100 | 90 | -10.0% | 0.5 | 0.0 | x0.0 |\n| N2 | 봄 소풍 \\| 안내 말씀을 드립니다 학 | 200 | 50 | -75.0% | 4.0 | 1.0 | x4.0 |\n"
    )
    assert markdown.text_of(lines).first().text == want
    place = str(tmp_path / "r")
    markdown.write(lines, place)
    assert [open(f, encoding="utf-8").read() for f in glob.glob(f"{place}/part*")] == [want]
    markdown.write(lines, place, whole=False)
    assert "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{place}/part*"))) == want
    details = markdown.ab_details(df)
    text = {r["name"]: r["text"] for r in details.collect()}["N2"]
    assert text.startswith("# N2 — 봄 소풍 | 안내") and "| 번역 청크 | 2 | 1 |\n| 속도향상 | — | x4.0 |\n\n## A: 원문 전체\n\n**입력:**\n```\n원문\n둘째\n```\n" in text
    # what reads such reports gets the four texts back
    assert sorted(map(tuple, files.report_blocks(details).collect())) == [("N1", "가", "나", "다", "라"), ("N2", "원문\n둘째", "bản", "할 일", "việc")]
    markdown.write_named(details, str(tmp_path / "d"))
    assert open(glob.glob(f"{tmp_path}/d/name=N2/part*")[0], encoding="utf-8").read() == text + "\n"


def test_terms(spark):
    schema = "pos int, lang string, label string, korean_term string, nllb_translation string, glossary_preferred string, reflected string, status string"
    rows = [(0, "vi", "베트남어", "나", "t" * 50, "p", "Y", "ok"), (1, "vi", "베트남어", "가", "short", "", "N", "none"), (2, "en", "영어", "나", "x", "q", "N", "missing"), (3, "en", "영어", "가", "y", None, "N", "none"), (4, "th", "태국어", "가", "z", "", "N", "none")]
    text = markdown.text_of(markdown.term_report(spark.createDataFrame(rows, schema).repartition(3), ["vi", "en", "th"], "m")).first().text
    assert text == (
        "# 용어사전 전/후 번역 비교\n\n모델: `m`  |  대상 언어: vi, en, th\n\n## 언어별 반영률 요약\n\n| 언어 | 반영 | 누락 | 반영률 |\n|---|---|---|---|\n"
        "| vi (베트남어) | 1 | 0 | **100%** |\n| en (영어) | 0 | 1 | **0%** |\n| th (태국어) | 0 | 0 | **—** |\n\n---\n\n## 용어별 상세 비교\n\n"
        f"### 나\n\n| 언어 | NLLB 원번역 | 용어사전 권장어 | 반영 |\n|---|---|---|---|\n| vi (베트남어) | {'t' * 40}... | p | ok |\n| en (영어) | x... | q | missing |\n\n"
        "### 가\n\n| 언어 | NLLB 원번역 | 용어사전 권장어 | 반영 |\n|---|---|---|---|\n| vi (베트남어) | short... | — | none |\n| en (영어) | y... | — | none |\n| th (태국어) | z... | — | none |\n\n"
    )


def test_quality(spark):
    schema = "pos int, lang string, lang_label string, korean_term string, nllb_translation string, before_score int, after_translation string, roundtrip_issue string, after_score int, reason string"
    rows = [(0, "vi", "베트남어", "가", "a" * 36, 50, "b", "i|j", 80, "r"), (1, "vi", "베트남어", "나", "c", 61, "d" * 35, "", 90, "s\nt")]
    text = markdown.text_of(markdown.quality_report(spark.createDataFrame(rows, schema), "judge", "translator")).first().text
    assert "평가 모델: `judge`  |  번역 모델: `translator`" in text and "| vi (베트남어) | 55.5점 | 85.0점 | **+29.5점** |\n\n---\n" in text
    assert f"### 가\n\n| 언어 | NLLB 번역 | 전 점수 | 수정 번역 | 역번역 이슈 | 후 점수 | 이유 |\n|---|---|---|---|---|---|---|\n| vi (베트남어) | {'a' * 35}... | **50점** | b | i\\|j | **80점** | r |\n\n### 나\n" in text
    assert f"| vi (베트남어) | c | **61점** | {'d' * 35} |  | **90점** | s t |\n\n" in text


def test_dataset(spark):
    labelled = spark.createDataFrame([("n1", 1, "s", True, "일정"), ("n1", None, "tt", False, "비용"), ("n2", 2, "uuu", True, "비용")], "notice_id string, original_id int, sentence string, is_todo boolean, category string")
    originals = spark.createDataFrame([(1, "web", "abc"), (2, "paper", "")], "id int, source_type string, original_text string")
    parts = reports.dataset_report(labelled, originals, spark.createDataFrame([("k", "v", "")], "korean string, preferred_vi string, preferred_en string"), "sentence")
    text = markdown.text_of(markdown.table_report(markdown.DATASET_TITLE, {"summary": (parts["summary"], ["n"]), "category": (parts["category"], ["rank"]), "sources": (parts["sources"], ["rank"]), "glossary": (parts["glossary"], ["column_name"])}, ["> made anew by each run"])).first().text
    assert text.startswith("# 데이터셋 리포트\n\n> made anew by each run\n\n## summary\n\n| n | n_notices |") and "| 1 | 비용 | 2 | 66.66666666666667 |\n| 2 | 일정 | 1 |" in text
    assert "## sources\n\n| rank | source_type | n | pct |\n|---|---|---|---|\n| 1 | web | 1 | 50.0 |\n| 2 | paper | 1 | 50.0 |\n" in text and text.endswith("| preferred_en | 0 | 1 |\n| preferred_vi | 1 | 0 |\n\n")


@pytest.mark.parametrize("parts", [1, 7])
def test_medians(spark, parts):
    rng = random.Random(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, rng.randint(0, 5), rng.randint(0, 10**9)])) for _ in range(900)] + [("one", 1, 7), ("two", 1, 7), ("two", 1, 10), ("none", 1, None)] + [("hot", 1, 3)] * 2000
        df = spark.createDataFrame(rows, "g string, h int, v long")
        got = {tuple(r.g): r.median for r in corpus.medians(df, F.col("v"), "g", "h").collect()}
        groups = {}
        for g, h, v in rows:
            if v is not None:
                groups.setdefault((g, h), []).append(v)
        assert got == {k: statistics.median(v) for k, v in groups.items()}
        assert corpus.medians(df, F.col("v")).first().median == statistics.median(v for _, _, v in rows if v is not None)
        stats = {(r.g, r.h): r for r in corpus.length_stats(df, F.col("v"), "g", "h").collect()}
        assert stats["none", 1].median is None and stats["two", 1].median == 8 and stats["one", 1].stdev == 0 and (None, 1) in stats
        assert corpus.medians(df.limit(0), F.col("v"), "g").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
