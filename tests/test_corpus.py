"""Corpus, evaluation, source and streaming operators."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from noticeflow.operators import corpus, evals, ml, seams
from noticeflow.plans import graph
from noticeflow.runtime import checkpoint_root, staged
from noticeflow.sources import files
from noticeflow.streaming import inbox


def test_split_is_total_and_disjoint(spark):
    df = spark.range(25).withColumn("g", (F.col("id") % 3).cast("string"))
    got = corpus.stratified_split(df, "g", F.col("id")).groupBy("g", "split").count().collect()
    assert sum(r["count"] for r in got) == 25
    assert {(r.g, r.split): r["count"] for r in got}[("0", "train")] == 7


def test_chunks(spark):
    df = spark.createDataFrame([(["aa", "bb", "c" * 20, "d"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(corpus.greedy_chunks(F.col("p"), 6)).collect()] == [["aa bb", "c" * 20, "d"], []]


def test_numbered(spark):
    df = spark.createDataFrame([("b", ""), ("a", "x"), ("c", "y")], "name string, text string")
    assert {r.name: r.id for r in corpus.numbered(df, "name", 5).collect()} == {"a": 5, "b": 6, "c": 7}
    got = files.document_records(df, "school").orderBy("id").collect()
    assert [(r.id, r.original_text) for r in got] == [(1, "x"), (3, "y")]


def test_fill_originals(spark):
    o = spark.createDataFrame([(1, "반드시 신청서를 5월 3일까지 제출해 주세요."), (2, "짧음"), (3, "반드시 신청서를 5월 3일까지 제출해 주세요.")], "id int, original_text string")
    s = spark.createDataFrame([(3, 0, "급식비 5,000원 납부", True, ""), (1, 0, "x", False, "")], "original_id int, pos int, sentence string, is_todo boolean, category string")
    got = {r.id: r for r in corpus.fill_originals(o, s).collect()}
    assert (got[1].origin, got[1].category) == ("fallback", "제출")
    assert (got[2].origin, got[2].category, got[2].importance) == ("rule", "", "")
    assert (got[3].origin, got[3].category, got[3].importance) == ("labelled", "비용", "0.75")


def test_evals(spark):
    df = spark.createDataFrame([("a", "a", 0.9, 1), ("a", "b", 0.2, 1), ("b", "b", 0.6, 0)], "t string, p string, s double, y int")
    got = {r.label: r for r in evals.per_class(df, "t", "p", ["a", "b", "c"]).collect()}
    assert (got["a"].precision, got["a"].recall, got["c"].f1) == (1.0, 0.5, 0.0)
    assert evals.best_threshold(df, "y", "s", [0.1, 0.5, 0.9]).first().threshold == 0.1
    j = spark.createDataFrame([('답: ```json\n{"score": 96.5}\n```',), ("none",)], "t string").select(evals.fenced_json(F.col("t"), "score string").alias("j")).select(evals.clamp(F.col("j.score"), 95)).collect()
    assert [r[0] for r in j] == [95, 0]


def test_two_level_mean(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 10.0, 10.0)], "g string, x double, y double")
    got = {r.grp: float(r.delta) for r in evals.two_level_mean(df, "g", "x", "y").collect()}
    assert got == {"a": 1.5, "b": 0.0, "전체": pytest.approx(0.7, abs=0.11)}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (6, 7), (7, 8)], "u int, v int")
    got = {r.node: r.label for r in graph.components(e).collect()}
    assert got == {**dict.fromkeys(range(1, 9), 1), 10: 10, 11: 10}
    assert graph.components(e.limit(0)).count() == 0


def test_model(spark):
    rows = [("도시락과 물통 준비", "준비물"), ("돗자리 준비해 주세요", "준비물"), ("급식비 납부 안내", "비용"), ("참가비를 납부", "비용")] * 3
    df = spark.createDataFrame(rows, "text string, category string")
    model = ml.train(df, iterations=10)
    got = {r.text: r for r in ml.predict(model, spark.createDataFrame([("물통 준비",), ("수업비 납부",), (" ",)], "text string")).collect()}
    assert (got["물통 준비"].predicted, got["수업비 납부"].predicted, got[" "].predicted) == ("준비물", "비용", "기타")


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nbroken\n{"id": 2}\n', encoding="utf-8")
    assert sorted(r.id for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "id int").collect()) == [1, 2]
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), "id int").count() == 0
    (tmp_path / "g.csv").write_text('﻿korean,preferred_vi\n"가,\n나",x\n,y\n', encoding="utf-8")
    assert [tuple(r) for r in files.glossary(spark, str(tmp_path / "g.csv")).collect()] == [("가,\n나", "x")]
    up = spark.createDataFrame([("a.TXT", b"x  y"), ("b.pdf", b"%"), ("c.heic", b"1"), ("noend", b"\xff"), ("d.pdf", b"")], "name string, content binary")
    text, bad = files.uploads(up)
    assert {r.name: r.text for r in text.collect()} == {"a.TXT": "x y", "noend": "�", "d.pdf": ""}
    assert {r.name for r in bad.collect()} == {"b.pdf", "c.heic"}
    fixed = files.repaired_csv(spark.createDataFrame([(0, "text,category"), (1, 'a, b "c",비용'), (2, "plain,일정"), (3, "")], "pos int, value string")).orderBy("pos").collect()
    assert [r.value for r in fixed] == ["text,category", '"a, b ""c""",비용', "plain,일정", ""]
    md = spark.createDataFrame([("n1", "".join(f"```\n{c}\n```\n" for c in "abcd")), ("n2", "```\na\n```")], "name string, text string")
    assert [tuple(r) for r in files.report_blocks(md).collect()] == [("n1", "a", "b", "c", "d")]
    files.write_json(spark.createDataFrame([(1, "가")], "id int, t string"), str(tmp_path / "out"))
    assert json.loads("".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part*"))) == {"id": 1, "t": "가"}


def test_tables_text(spark):
    df = spark.createDataFrame([(["본문", ""], [[["a", None], ["", " "]], [["b\nc", "d"]]])], "p array<string>, t array<array<array<string>>>")
    assert df.select(files.tables_text(F.col("p"), F.col("t"))).first()[0] == "본문\n\n[표]\na | \n\nb c | d"


def test_seams(spark):
    df = spark.createDataFrame([("a", 1), ("", 2)], "text string, translated int")

    def call(rows):
        if any(not t for (t,) in rows):
            raise ValueError("blank")
        return [t.upper() for (t,) in rows]

    got = seams.with_model(df, ["text"], "translated", StringType(), call, default="")
    assert sorted(r.translated for r in got.collect()) == ["", "A"]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:10:00", 1.0), (2, "a", "2024-01-01 00:50:00", 2.0), (3, "b", "2024-01-01 05:00:00", 3.0)], "event_id int, event_type string, t string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    s = inbox.stream(spark, str(tmp_path / "in"), df.schema)
    q = inbox.windowed_counts(s, "event_type").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted((r.event_type, r.n) for r in spark.table("w").collect()) == [("a", 2), ("b", 1)]
    assert sorted((r.event_type, r.n) for r in inbox.windowed_counts(df, "event_type").collect()) == [("a", 2), ("b", 1)]


def test_staged(spark):
    df = staged(spark.range(3), "t")
    assert df.count() == 3 and df._staged_path.startswith(checkpoint_root(spark))


def test_offline(spark):
    from noticeflow.plans import offline

    rows = spark.createDataFrame([("1", "급식비를 납부해 주시기 바랍니다. 둘. 셋. 넷. 다섯. 여섯 도시락.", "", "a|b"), ("2", " ", "비용", ""), ("3", "안내", "비용", None)], "id string, original_text string, category string, keywords string")
    got = {r.id: r for r in offline.run(rows, [("도시락", "cơm hộp")]).collect()}
    assert got["1"].easy_text.split("\n") == ["급식비를 내 주세요.", "둘.", "셋.", "넷.", "여섯 도시락."]
    assert (got["1"].quality_label, got["1"].note, got["1"].keywords) == ("review_needed", "도시락->cơm hộp", ["a", "b"])
    assert (got["2"].quality_label, got["2"].category, len(got["2"].errors)) == ("error", "비용", 1)
    assert (got["3"].quality_label, got["3"].category) == ("unchecked", "비용")


def test_legacy_todos(spark):
    from noticeflow.plans import offline

    n = spark.createDataFrame([(1, "안녕하십니까 학부모님.\n급식비 5,000원을 5월 3일까지 내 주세요. 신고 요령을 익혀 주세요.")], "id int, text string")
    got = [tuple(r) for r in offline.legacy_todos(n, "id").orderBy("pos").collect()]
    assert [(r[3], r[4], r[5]) for r in got] == [("비용", 0.8, "2026-05-03"), ("건강·안전", 0.85, None)]


def test_ids_among_equals(spark):
    d = spark.createDataFrame([(i, f"u{i % 2}") for i in range(9, -1, -1)], "page_id int, url string")
    assert [r.page_id for r in corpus.numbered(d, "url", 10, then=("page_id",)).orderBy("id").collect()] == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def test_ids_are_those_of_the_sql(spark, tmp_path):
    """Links without a value come last, and each link has the ids that the SQL gives it; which of its pages has which, the SQL leaves open."""
    import duckdb

    from noticeflow.plans import ORACLES, QUERIES

    pages = [(i, None if i % 5 == 0 else f"u{i % 3}") for i in range(30)]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = [(r.page_id, r.id) for r in QUERIES["sequential_ids"](spark, str(tmp_path)).collect()]
    by_link = lambda rows: {(pages[p][1], i) for p, i in rows}
    assert len(got) == 30 and by_link(got) == by_link(con.execute(ORACLES["sequential_ids"]).fetchall())
