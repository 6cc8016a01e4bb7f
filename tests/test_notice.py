"""Literal facts of the notice functions."""

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import easy, glossary, i18n, rules, slots, text
from noticeflow.operators import cards



@pytest.fixture(autouse=True)
def _column(spark):
    global T
    T = F.col("t")


T = None


def one(spark, value, *exprs):
    row = spark.createDataFrame([(value,)], "t string").select(*(e.alias(f"c{i}") for i, e in enumerate(exprs))).first()
    return row[0] if len(exprs) == 1 else tuple(row)


def many(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", expr.alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def test_dates(spark):
    got = many(spark, ["2026년 5월 14일(수) 출발", "5월 9일(금)까지 제출", "내일까지 내 주세요", "5월 9일, 5월 9일", "2026. 4. 18.(토) 행사", "2026년 5월 1일 그리고 2026년 5월 1일", ""], slots.dates(T))
    as_tuple = [[(d.year, d.month, d.day, d.weekday, d.relative) for d in x] for x in got]
    assert as_tuple[0] == [(2026, 5, 14, "수", None)]
    assert as_tuple[1] == [(None, 5, 9, "금", None)]
    assert as_tuple[2] == [(None, None, None, None, "내일")]
    assert as_tuple[3] == [(None, 5, 9, None, None)]
    assert as_tuple[4] == [(2026, 4, 18, "토", None)]
    # a repeated full date also yields its month-day part: only the first place counts as taken
    assert as_tuple[5] == [(2026, 5, 1, None, None), (None, 5, 1, None, None)]
    assert as_tuple[6] == []


def test_times_and_amounts(spark):
    assert [tuple(x) for x in one(spark, "오후 2시 30분 또는 14:30", slots.times(T))] == [("오후 2시 30분", 2, 30, "오후"), ("14:30", 14, 30, None)]
    got = many(spark, ["15,000원", "5천원만", "없음", "1만 5천원"], slots.amounts(T))
    assert [[a.value for a in x] for x in got] == [[15000], [5000], [], [5000]]


def test_urls_phones_deadlines(spark):
    assert one(spark, "https://a.kr/x. 또 https://a.kr/x", slots.urls(T)) == ["https://a.kr/x"]
    assert one(spark, "02-2649-7232, 849-7003 1588-0260 010-1234-5678 15,000원", slots.phones(T)) == ["02-2649-7232", "849-7003", "1588-0260", "010-1234-5678"]
    assert one(spark, "참가비 15,000원 5월 9일까지 내기. 끝", slots.deadline_phrases(T)) == ["참가비 15,000원 5월 9일까지 내기"]
    # links are masked by marks of the same length, so that their full stops do not cut the phrase
    assert one(spark, "http://a.go.kr/x.do 내일까지 신청", slots.deadline_phrases(T)) == ["⟦U" + "_" * 16 + "⟧ 내일까지 신청"]


@pytest.mark.parametrize(("lang", "want"), [("vi", "Ngày 14/5/2026 (Thứ Tư)"), ("en", "May 14, 2026 (Wed)"), ("zh", "5月14日 (수)"), ("ko_easy", "2026년 5월 14일(수)"), ("ru", "14/5/2026")])
def test_format_date(spark, lang, want):
    assert one(spark, "2026년 5월 14일(수)", i18n.format_date(F.get(slots.dates(T), F.lit(0)), F.lit(lang))) == want


def test_format_others(spark):
    assert one(spark, "오전 9시", i18n.format_time(F.get(slots.times(T), F.lit(0)), F.lit("vi"))) == "9 giờ sáng"
    assert one(spark, "15000", i18n.format_amount(T.cast("bigint"), F.lit("vi"))) == "15,000 won"
    assert one(spark, "13월 40일", i18n.format_date(F.get(slots.dates(T), F.lit(0)), F.lit("en"))) == "13월 40일"
    assert one(spark, "xx", i18n.nllb_code(T)) == "vie_Latn"


def test_due_amount_action(spark):
    got = many(spark, ["13월 40일까지", "다음 주 월요일 제출", "학교 운영위원회까지 오세요", "길이 25.5cm"], slots.due_date(T, 2026))
    assert got == ["2026-13-40", "다음 주 월요일", "학교 운영위원회", None]
    assert many(spark, ["원하시는 분", "1,200원 납부", "참가비"], slots.amount(T)) == [None, 1200, None]
    assert many(spark, ["참가비 안내", "제출해 주세요", "맑음"], slots.action(T)) == ["참여", "제출", None]


def test_supplies(spark):
    assert one(spark, "준비물: 도시락, 물통, 돗자리, 편한 운동화, 여벌 옷을 준비해 주세요", slots.supplies(T)) == ["도시락", "물통", "돗자리", "편한 운동화", "여벌 옷"]


def test_text(spark):
    assert one(spark, "foo   bar\n\n\nbaz", text.normalize(T)) == "foo bar\n\nbaz"
    assert one(spark, "■ 준비물: 도시락 - 물", text.strip_markers(T)) == "준비물: 도시락 - 물"
    assert one(spark, "다문화가정 학\n생 지원하기\n위해.\n끝", text.join_broken_lines(T)) == "다문화가정 학생 지원하기 위해.\n끝"
    assert one(spark, "행사 안내\nhttps://x.kr\n내일 오세요. 꼭 오세요.\n신청방법 온라인 접수 준비물 없음", text.sentences(T)) == ["내일 오세요.", "꼭 오세요.", "신청방법 온라인 접수", "준비물 없음"]
    assert one(spark, "a　b c", text.flatten(T)) == "a b c"
    assert one(spark, "x" * 120, text.shortened(T)) == "x" * 97 + "..."
    assert one(spark, "a|b, c;;/d", text.keyword_list(T)) == ["a", "b", "c", "d"]
    assert one(spark, "ab c", text.word_ngrams(T)) == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]
    assert [tuple(x) for x in one(spark, "aXbX", text.offsets(T, "X"))] == [(1, 2), (3, 4)]


def test_rules(spark):
    c = rules.category(T)
    assert many(spark, ["5,000원 제출", "서류 제출", "도시락 지참", "독감 감염 예방", "5월 3일 실시", "맑은 하늘"], c) == ["비용", "제출", "준비물", "건강·안전", "일정", "기타"]
    assert many(spark, ["반드시 제출 5월 3일", "꼭 봐요 3/4"], rules.importance(T, c)) == [1.0, 0.8]
    assert many(spark, ["안녕하십니까 학부모님", "짧음", "내일까지 제출해 주세요"], rules.rejected(T)) == [True, True, False]


def test_easy(spark):
    got = many(spark, ["3월 17일까지 신청", "5,000원 납부", "개인 준비물 지참", "서류 제출.", "", "개인정보"], easy.easy_korean(T))
    assert got == ["3월 17일까지 신청해야 합니다", "5,000원 납부(지불)", "각자 준비할 것 지참", "서류 제출해야 합니다.", "", "개인정보"]


def test_protection(spark):
    m = glossary.masked(T)
    s = "문의 https://a.kr/b 010-1234-5678 끝"
    masked, kept, back = one(spark, s, m["text"], m["kept"], glossary.unmasked(m["text"], m["kept"]))
    assert (masked, kept, back) == ("문의 ⟦P0⟧ ⟦P1⟧ 끝", ["https://a.kr/b", "010-1234-5678"], s)
    assert one(spark, "⟦P7⟧", glossary.unmasked(T, F.array(F.lit("x")))) == "⟦P7⟧"
    g = glossary.literal([("체험", "trải"), ("체험학습", "học"), ("없음", "")])
    assert one(spark, "체험학습", glossary.injected(T, glossary.hits(T, g))) == "체험(trải)학습(học)"
    assert one(spark, "https://체험.kr", glossary.term(T, g, F.lit("vi"))) == "https://체험.kr"
    assert many(spark, [" 체험 ", "모름", "없음"], glossary.term(T, g, F.lit("vi"))) == ["trải", "모름", "없음"]
    assert one(spark, "40.000 đô la", glossary.currency_fixed(F.lit("40,000원"), T)) == "40,000 won"
    assert one(spark, "40.000 đô la", glossary.currency_fixed(F.lit("무료"), T)) == "40.000 đô la"
    rows = glossary.checks(F.lit("체험"), T, glossary.hits(F.lit("체험"), g))
    assert one(spark, "không", glossary.roll_up(rows)) == ("review_needed", "체험->trải")
    assert one(spark, "TRẢI", glossary.roll_up(rows)) == ("ok", "")


def test_headers(spark):
    assert many(spark, ["운영시간 | 9시", "기타 안내사항: 없음\n둘", "오늘은", ""], cards.header(T)) == ["운영시간", "기타 안내사항", None, None]
    assert many(spark, ["운영시간 | 9시", "기타 안내사항: 없음\n둘", " 오늘은 "], cards.value(T)) == ["9시", "없음\n둘", "오늘은"]


def _cards(spark, rows):
    data = [(h, h, v, v, v, None, i) for h, v, i in rows]
    return spark.createDataFrame([(data,)], f"c array<{cards.CARD}>")


def test_card_dedup_and_rank(spark):
    got = _cards(spark, [("일시", "짧은 값", 0.9), ("비용", "5원", 0.8), ("일시", "짧은 값 | 더 긴 값", 0.6), ("일시", "다른 값", 0.7)]).select(cards.dedup(F.col("c")).alias("d"), cards.ranked(cards.dedup(F.col("c"))).alias("r")).first()
    assert [(c.header_ko, c.value_ko, c.importance) for c in got.d] == [("일시", "짧은 값 | 더 긴 값", 0.6), ("일시", "다른 값", 0.7), ("비용", "5원", 0.8)]
    assert [c.importance for c in got.r] == [0.8, 0.7, 0.6]
    twice = _cards(spark, [("a", "x | y", 0.5), ("a", "x y", 0.6)]).select(cards.dedup(F.col("c")).alias("d")).first()
    assert [c.value_ko for c in twice.d] == ["x | y"]
    long = _cards(spark, [("h", f"값{i}가", i / 20) for i in range(12)]).select(cards.ranked(cards.dedup(F.col("c"))).alias("r")).first()
    assert len(long.r) == 8


def test_analyze(spark):
    n = spark.createDataFrame([(1, "5월 9일까지 참가비 15,000원을 납부해 주세요. 문의 02-123-4567 https://a.kr"), (2, ""), (3, "준비물: 도시락, 물통을 준비해 주세요."), (4, None)], "notice_id int, text string")
    got = {r.notice_id: r for r in cards.analyze(n, "vi", [("비용", "chi phí")]).collect()}
    assert set(got) == {1, 2, 3, 4}
    one_ = [(c.header_ko, c.value_ko) for c in got[1].cards]
    assert ("연락처", "02-123-4567") in one_ and ("신청 URL", "https://a.kr") in one_ and ("비용", "15,000원") in one_
    assert [c.header_translated for c in got[1].cards if c.header_ko == "비용"] == ["chi phí"]
    assert got[2].cards == [] and got[4].cards == [] and got[2].tts_text == ""
    assert [s.ko for s in got[3].summary.supplies] == ["도시락", "물통"]
    assert got[1].summary.deadlines[0].ko == "2026-05-09"
    assert all(len(r.cards) <= 8 for r in got.values())
