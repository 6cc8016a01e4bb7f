"""What makes the work on a notice dear: looks at every character from every other, patterns made anew, scores made twice."""

import time

from pyspark.sql import functions as F

from noticeflow.functions import easy, rules, slots, text
from noticeflow.functions import patterns as P
from noticeflow.operators import cards



def T():
    return F.col("text")


def test_phrases_of_long_texts(spark):
    """Both looked for the word for 'until' from each character anew."""
    long = "가나 다라" * 60_000
    start = time.perf_counter()
    got = spark.createDataFrame([(long,), (f"{long}. 5월까지 내기",)], "text string").select(slots.deadline_phrases(T()).alias("d"), slots.due_date(T(), 2026).alias("due")).collect()
    assert [(r.d, r.due) for r in got] == [([], None), (["5월까지 내기"], "5월")]
    assert time.perf_counter() - start < 30


def test_pieces_are_those_of_split(spark):
    rows = ["", "a", " a.  b! c", "끝.　다음 1) 둘  ○셋 가. 넷", text.CUT, f"a. {text.CUT} b", "x.y", ". ", None]
    for pattern in (P.SENTENCE_CUT, P.SENTENCE_END, P.URL, P.SUPPLY_CUT):
        for r in spark.createDataFrame([(x,) for x in rows], "text string").select("text", text.pieces(T(), pattern).alias("got"), F.split(T(), pattern, -1).alias("want")).collect():
            assert r.got == r.want, (pattern, r.text)


def test_faster_patterns_find_the_same(spark):
    """Against the patterns in their plain form."""
    plain = {
        P.SENTENCE_CUT: r"(?U)(?<=[.!?])\s+|(?<=다\.)\s+|\s+(?=\d+[.)]\s)|\s+(?=[가-힣]\.\s)|\s+(?=[❏○◆●▪◎□■])|\s+(?=운영시간|운영방법|신청방법|신청기간|준비물|제출|기타\s*안내|접수방법|참가방법)",
        P.SENTENCE_CUT_PLAIN: r"(?U)(?<=[.!?])\s+|\s+(?=\d+[.)]\s)|\s+(?=[가-힣]\.\s)", P.SENTENCE_END: r"(?U)(?<=[.!?。！？])\s+", P.SENTENCE_CUT_SIMPLE: r"(?U)(?<=[.!?])\s+",
        P.TIME_24H: r"(?U)(?<!\d)(\d{1,2}):(\d{2})(?!\d)", P.URL: r"""(?U)(?i)\bhttps?://[^\s<>"'()]+|\bwww\.[^\s<>"'()]+""", P.PHONE: r"(?U)(?<![\d-])(?:\d{2,4}-\d{3,4}-\d{4}|\d{4}-\d{4}|\d{3,4}-\d{4})(?!\d)",
        P.DUE_UNTIL: r"(?U)([\w가-힣\s]+?)\s*까지", P.MONTH_ONLY: r"(?U)(?<!\d)([1-9]|1[012])월(?!\s*\d+\s*일)",
    }
    rows = ["끝.  1) 둘 　 ○셋\t가. 넷 기타 안내 준비물", "a.b. c。 d！ e", "xhttp://a HTTPS://b.c www.d ahttp://x, WWW.e)", "12:30 112:30 1:305 02-123-4567-8 123-4567 -12-345-6789", "까지, 까지 내일까지 5월 3일 5월", "1월 11월 21월 3월 4일", "", ". ", " 제출  제출"]
    for r in spark.createDataFrame([(x,) for x in rows], "text string").select("text", *(text.matches(T(), p).alias(f"{k}{i}") for i, pair in enumerate(plain.items()) for k, p in zip("gw", pair, strict=True))).collect():
        for i, p in enumerate(plain):
            if p == P.DUE_UNTIL:  # of which the first match counts
                assert r[f"g{i}"][:1] == r[f"w{i}"][:1], (p, r.text)
            else:
                assert r[f"g{i}"] == r[f"w{i}"], (p, r.text)
    odd = ["".join(x) for x in zip(*[iter("\t\n\x0b\x0c\r \x85\xa0       　​﻿")] * 2, strict=True)]
    for r in spark.createDataFrame([(f"{x}가 {x}",) for x in odd], "text string").select("text", text.strip(T()).alias("g"), F.regexp_replace(T(), r"(?U)\A\s+|\s+\z", "").alias("w"), text.flatten(T()).alias("gf"), F.regexp_replace(F.regexp_replace(T(), r"(?U)\s+", " "), r"(?U)\A\s+|\s+\z", "").alias("wf")).collect():
        assert (r.g, r.gf) == (r.w, r.wf), repr(r.text)


def test_signs_of_rejected_sentences(spark):
    rows = ["학부모님 안녕하십니까 여러분", "김님 안녕하세요 여러분", "학부모님께 드립니다 여러", "내용을 안내드립니다.", "글을 드립니다 .", "가나다라마바 안내", "가나다라마바 교장", "2026. 5. 7.", "담당 : 가나다라", "(우1234-5678 가나", "08123 서울특별시 가", "가나 공익제보센터", "가나 자살예방상담", "가나 청소년상담", "안내를 읽어 주세요", "가나다라마바사"]
    for legacy in (False, True):
        full = P.U + "|".join(f"(?:{p})" for p in (P.NOT_TODO_LEGACY if legacy else P.NOT_TODO))
        for r in spark.createDataFrame([(x,) for x in rows], "text string").select("text", rules.rejected(T(), legacy=legacy).alias("g"), ((F.char_length(T()) < 7) | T().rlike(full)).alias("w")).collect():
            assert r.g == r.w, r.text


def test_a_score_is_made_once(spark):
    plan = cards.todos(spark.createDataFrame([(1, "내일까지 내 주세요")], "notice_id int, text string"), "notice_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("바랍니다") == 1


def _lambdas(column, schema: str, spark) -> int:
    """Array functions with a lambda that run for a row in any case: those of the column outside its branches."""
    plan = spark.createDataFrame([], schema).select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    return plan.split("THEN")[0].split("CASE WHEN")[0].count("lambda")


def test_easy_form_of_texts_that_stay(spark):
    """Texts without a word to replace or an ending are told by one look, and no others are left as they are."""
    full = easy.let(easy.protect(T(), P.EASY_KEPT), lambda p: easy.restore(easy.polite_ending(easy.replace_words(p["text"])), p["kept"]))
    rows = ["", "3월 5일", "납부", "납부해 주세요", "3월 5일제출", "3월 5일 제출", "서류 제출 . ", "준비", "준비 !", "신청 ..", "5원 참가?", "개인정보", "해당 반", "0 3월 5일", "제출, 납부", "x제출(내기)", "제출5원", None]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    for r in df.select("text", easy.easy_korean(T()).alias("got"), F.when(T() == "", T()).otherwise(full).alias("want")).collect():
        assert r.got == r.want, r.text
    assert _lambdas(easy.easy_korean(T()), "text string", spark) == 0


def test_first_date_and_time_are_the_first_of_all(spark):
    rows = ["2024년 3월 5일(월) 3월 6일", "13월 5일 3월 5일", "3. 5.(금) 내일 3월 1일", "이번주 내일 9:30 오후 2시", "2024. 3. 5. (토) 10:15 112:30", "월 일 년 ( 시 :", "내일", "", None]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    first = lambda c: F.get(c, F.lit(0))
    for r in df.select("text", slots.first_date(T()).alias("d"), first(slots.dates(T())).alias("wd"), slots.first_time(T()).alias("t"), first(slots.times(T())).alias("wt")).collect():
        assert (r.d, r.t) == (r.wd, r.wt), r.text


def test_cards_with_different_headers_are_not_compared(spark):
    card = lambda h, v: (h, h, v, v, v, None, 0.5)
    df = spark.createDataFrame([([card("b", "x"), card("a", "x")],), ([card("b", "x"), card("a", "y"), card("b", "x y")],), ([],)], f"cards array<{cards.CARD}>")
    got = [[(c.header_ko, c.value_ko) for c in r.c] for r in df.select(cards.dedup(F.col("cards")).alias("c")).collect()]
    assert got == [[("b", "x"), ("a", "x")], [("b", "x y"), ("a", "y")], []]
    assert _lambdas(cards.dedup(F.col("cards")), f"cards array<{cards.CARD}>", spark) == 0


def test_slot_cards_of_all_kinds(spark):
    df = cards.analyze(spark.createDataFrame([(1, "내일 9:30 https://a.example 02-123-4567 5원")], "notice_id int, text string"), "vi", [("시간", "giờ")])
    assert [(c.header_ko, c.header_translated, c.value_ko) for c in df.first().cards] == [("일시", "일시", "내일"), ("시간", "giờ", "9:30"), ("신청 URL", "신청 URL", "https://a.example"), ("연락처", "연락처", "02-123-4567"), ("비용", "비용", "5원")]


def test_cards_are_made_once(spark):
    """A filter for notices with cards, which the planner set before their rows, made all cards of a notice a second time."""
    from noticeflow.plans import QUERIES

    plan = QUERIES["notice_cards"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 2 and plan.count("공익제보센터") == 2 and plan.count("방역지침") < 40


def test_sentences_of_one_line_are_those_of_lines(spark):
    """The way without lambdas against the one for texts of several lines, which an empty line more does not change."""
    rows = ["", " ", "가", "가나다", "가나다라", "가. 나. 다라마바사. 아", "가나다라. 마. 바. 사아자차카", "가. 나", "　가나다라!  1) 마바사 2) 아　제출 안내 끝입니다. ", "행사 안내", "https://a.kr 가나다", "가나😀. 가나다😀. 가😀나다라", "a" + text.CUT + "bcde. fghij", None]
    for plain in (False, True):
        for drop in (False, True):
            df = spark.createDataFrame([(x,) for x in rows], "text string")
            get = lambda c, **k: text.sentences(c, plain=plain, drop_lines=drop, **k)
            for r in df.select("text", get(T()).alias("g"), get(F.concat(T(), F.lit("\n"))).alias("w"), get(text.strip(T()), stripped=True).alias("s")).collect():
                assert r.g == r.w == r.s, repr(r.text)


def test_slots_in_steps_are_those_at_once(spark):
    rows = ["2024년 3월 5일(월) 3월 6일", "2024년 3월 5일", "2024년 3월 5일 2024년 3월 5일", "3월 5일 13월 5일", "13월 5일 2024년 3월 5일", "3월 5일(화)3월 5일(화)", "2024. 3. 5.(금) 내일 다음주", "3. 5. (토)", "0월 0일", "٣월 ٥일", "99999999999원 5만원 5 만 원 5천원 1,000원 1,000원", "오후 2시 9:30 9:30 오전 10시 5분", "http://a.kr/x. http://a.kr/x, www.b.c) 02-123-4567 02-123-4567", "이번 주 모레", "", None]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    want = df.select("text", *(c.alias(k) for k, c in {"dates": slots.dates(T()), "times": slots.times(T()), "amounts": slots.amounts(T()), "urls": slots.urls(T()), "phones": slots.phones(T())}.items()))
    got = slots.with_found(df.fillna(""), "text", {})
    key = lambda r: r.text or ""
    for g, w in zip(sorted(got.collect(), key=key), sorted(want.filter("text IS NOT NULL").unionByName(want.filter("text IS NULL").fillna("", ["text"])).collect(), key=key), strict=True):
        assert g == w, g.text


def test_terms_of_a_glossary(spark):
    from noticeflow.functions import glossary as G

    rows = [(" 체험 ", " trải "), ("체험", "other"), ("없음", ""), ("", "x"), ("https://a.kr", "link"), (None, "y")]
    df = spark.createDataFrame([(x,) for x in [" 체험", "체험", "없음", "", "https://a.kr", "모름", None]], "text string")
    for lang in ("vi", "ko_easy"):
        for r in df.select("text", G.term_of(T(), rows, F.lit(lang)).alias("g"), G.term(T(), G.literal(rows), F.lit(lang)).alias("w")).collect():
            assert r.g == r.w, (lang, r.text)
