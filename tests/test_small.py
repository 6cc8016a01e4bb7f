"""Small operators: first slots, named splitters, gates, JSON, offsets."""

import json
import time

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import client, slots, text
from noticeflow.operators import cards, judges, seams
from noticeflow.plans import offline
from noticeflow.sources import files


def test_firsts(spark):
    df = spark.createDataFrame([("회비 3만 원, 교재 2,000원. 5월 3일까지 신청서, 6월 1일까지 납부",), ("없음",), (None,)], "text string")
    got = [(r.a, r.d) for r in df.select(slots.first_amount(F.col("text")).alias("a"), slots.first_deadline(F.col("text")).alias("d")).collect()]
    assert got[0] == ("2,000원", "5월 3일까지 신청서, 6월 1일까지 납부") and got[1] == got[2] == (None, None)


def test_splitters(spark):
    t = "첫 문장입니다. 둘째 문장이에요! 셋"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.sentences_of(F.lit(t), "simple")) == ["첫 문장입니다.", "둘째 문장이에요!"] and one(text.sentences_of(F.lit(t), "mark"))[-1] == "셋"
    assert one(text.sentences_of(F.lit(t))) == one(text.sentences(F.lit(t)))
    with pytest.raises(ValueError):
        text.sentences_of(F.lit(t), "other")
    rows = files.sentence_records(spark.createDataFrame([("f", t), ("none", None)], "name string, text string"), "simple").collect()
    assert [(r["name"], r.pos, r.text, r.is_todo) for r in rows] == [("f", 0, "첫 문장입니다.", False), ("f", 1, "둘째 문장이에요!", False)]


def test_gate(spark):
    asked = []
    df = spark.createDataFrame([(1, "신청서를 금요일까지 제출해 주세요", 9), (2, "짧다", 9), (3, None, 9), (4, "이 문장은 모델이 못 읽어요", 9), (5, "참가비를 납부해 주시기 바랍니다", 9)], "id int, text string, row int")

    def call(rows):
        if any("못" in s for (s,) in rows):
            raise ValueError("no")
        return [0.87654 if "제출" in s else 0.2 for (s,) in rows]

    got = {r.id: r for r in seams.gated_todos(df, "text", call).collect()}
    assert (got[1].probability, got[1].is_todo, got[1].row) == (0.877, True, 9) and (got[5].probability, got[5].is_todo) == (0.2, False)
    assert all((got[i].probability, got[i].is_todo, got[i].probability_error) == (0.0, False, None) for i in (2, 3)) and got[4].probability_error and not got[4].is_todo
    assert asked == []


def test_legacy_lists(spark):
    df = spark.createDataFrame([(1, "참가비 5,000원을 5월 3일까지 납부해 주세요. 신청서를 꼭 제출해 주세요."), (2, ""), (3, None), (4, "안녕하세요")], "notice_id int, text string")
    got = {r.notice_id: r.todos for r in offline.legacy_todo_lists(df, "notice_id").collect()}
    rows = sorted(tuple(r) for r in offline.legacy_todos(df, "notice_id").collect())
    assert [(t.text_ko, t.category, t.importance, t.due_date, t.text_vi) for t in got[1]] == [(r[2], r[3], r[4], r[5], "") for r in rows if r[0] == 1] and got[1][0].category == "비용"
    assert got[2] == got[3] == [] and set(got) == {1, 2, 3, 4}


def test_json_and_languages(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 2.5)], "id int, text string, score double").withColumn("items", F.array(F.struct(F.lit("x").alias("k"))))
    assert [json.loads(r.document) for r in cards.as_json(df, ["id"]).orderBy("id").collect()] == [{"text": "a", "score": None, "items": [{"k": "x"}]}, {"text": "b", "score": 2.5, "items": [{"k": "x"}]}]
    assert sorted((r.id, r.lang) for r in judges.by_language(df, ["vi", "en"]).collect()) == [(1, "en"), (1, "vi"), (2, "en"), (2, "vi")]
    assert cards.top_per_group(df.withColumn("place", F.lit("own")), "text", [F.col("id")]).columns == [*df.columns, "place"]


def test_running_sums_and_places(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for n in (0, 1, 999, 1000, 1001, 3500):
        values = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 7) if n else F.array().cast("array<int>")
        total, want = 0, []
        for x in range(1, n + 1):
            total += x % 7
            want.append(total)
        assert one(text.running(values)) == want
    for t, w in (("abcabc ab", "ab"), ("aaaa", "aa"), ("none", "x"), ("", "x"), ("x", ""), ("가나 가나다", "가나"), ("a.b.", ".")):
        want, at = [], 0
        while w and (at := t.find(w, at)) >= 0:
            want.append((at, at + len(w)))
            at += len(w)
        assert [tuple(p) for p in one(client.places(F.lit(t), F.lit(w)))] == want
    start = time.time()
    df = spark.range(1).select(F.repeat(F.lit("ab c "), 100_000).alias("t"))
    got = df.select(client.places(F.col("t"), F.lit("ab")).alias("p")).select(F.size("p"), F.element_at("p", -1)).first()
    assert got[0] == 100_000 and tuple(got[1]) == (499_995, 499_997) and time.time() - start < 20


def test_first_per_key(spark, tmp_path):
    """Batches and streams: one row of each key."""
    from noticeflow.streaming import inbox

    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:05:00", 2.0), ("b", "2024-01-01 00:01:00", 3.0)]
    df = spark.createDataFrame(rows, "k string, ts string, value double")
    assert sorted(r.k for r in inbox.first_per_key(df, "k").collect()) == ["a", "b"]
    df.write.parquet(str(tmp_path / "in"))
    q = inbox.first_per_key(inbox.stream(spark, str(tmp_path / "in"), df.schema), "k").writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.k for r in spark.table("firsts").collect()) == ["a", "b"]
