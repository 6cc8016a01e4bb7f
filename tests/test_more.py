"""Queries of plans.more against their SQL, and what has no query against hand-made cases."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from noticeflow.functions import client, glossary, i18n, rules, slots, text
from noticeflow.functions import patterns as P
from noticeflow.operators import cards, corpus, evals, judges, markdown, ml, reports, seams, translation
from noticeflow.plans import ORACLES, QUERIES, more
from noticeflow.sources import convert, files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n, f in QUERIES.items() if n in ORACLES and (f.__module__ == more.__name__ or n in ("greedy_chunks", "term_sentences", "original_fill", "supply_tokens", "two_level_mean", "json_field", "left_join_fallback", "notice_times", "notice_amounts", "date_i18n", "time_i18n"))]


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(map(_plain, r)) for r in df.select(*cols).collect()) == sorted(tuple(_plain(r[i]) for i in at) for r in want.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# sources and sinks


def test_lines_and_columns(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nbroken {\n{"id": 2}\n')
    rows, bad = files.parsed_lines(spark, str(tmp_path / "a.jsonl"), "id int")
    assert sorted(r.id for r in rows.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["broken {"]
    (tmp_path / "b.jsonl").write_text('{"id": 1, "text": "x"}\n')
    assert files.required_json(spark, str(tmp_path / "b.jsonl"), ["id", "text"]).count() == 1
    with pytest.raises(ValueError, match="label"):
        files.required_json(spark, str(tmp_path / "b.jsonl"), ["id", "label"])
    assert files.pick(rows, "id", 2).first().id == 2 and files.pick(rows, "id").first().id == 1
    with pytest.raises(ValueError):
        files.pick(rows, "id", 9)
    assert files.last_id(rows, "id") == 2 and files.last_id(rows.limit(0), "id") == 0


def test_text_folders(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name, body in (("a.txt", "첫 줄\n둘째  줄"), ("b.txt", "  "), ("c.txt", "안내\n12회 무상급식"), ("d.txt", "제출해 주세요. 확인 바랍니다.")):
        (tmp_path / "t" / name).write_text(body)
    f = files.text_files(spark, str(tmp_path / "t"))
    known = files.document_records(f, "school", 5)
    assert sorted((r.id, r.original_text) for r in known.collect()) == [(5, "첫 줄\n둘째 줄"), (7, "안내\n12회 무상급식"), (8, "제출해 주세요. 확인 바랍니다.")]
    assert sorted(r.id for r in convert.appended_records(f, "x", known).collect()) == [9, 11, 12]
    assert {r.original_text for r in files.one_line_records(f, "x").collect()} >= {"첫 줄 둘째 줄"}
    s = files.sentence_records(f).collect()
    assert {r.name for r in s} == {"a.txt", "d.txt"} and not any(r.is_todo for r in s)
    b = convert.binary_files(spark, str(tmp_path / "t"), "*.txt")
    assert sorted(r.name for r in b.collect()) == ["a.txt", "b.txt", "c.txt", "d.txt"]


def test_conversion(spark):
    df = spark.createDataFrame([("a.hwp", b"ab"), ("b.hwpx", b"bad"), ("c.pdf", b"pdf"), ("d.txt", b"plain"), ("e.exe", b"x"), ("f.txt", b" ")], "name string, content binary")

    def call(rows):
        if any(c == b"bad" for _, c in rows):
            raise RuntimeError("no")
        return [c.upper() for _, c in rows]

    made = {r.name: (r.content and bytes(r.content), r.error) for r in convert.converted(df, call).collect()}
    assert made["a.hwp"] == (b"AB", None) and made["c.pdf"] == (b"pdf", None) and made["b.hwpx"][0] is None and "no" in made["b.hwpx"][1]
    extract = lambda f: f.select("name", F.col("content").cast("string").alias("text"), F.lit(None).cast("string").alias("error"))
    texts, failed, tally = convert.batch_convert(df, call, extract)
    assert {r.name: r.text for r in texts.collect()} == {"a.hwp": "AB", "c.pdf": "pdf", "d.txt": "plain"}
    assert {r.name for r in failed.collect()} == {"b.hwpx", "f.txt"} and {r.status: r.n for r in tally.collect()} == {"success": 3, "failed": 2}
    assert convert.filter_command(["tr", "a-z", "A-Z"], 10)([("x", b"abc")]) == [b"ABC"]


def test_page_texts(spark):
    bodies = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("b", 1, "x")], "name string, page int, body string")
    tables = spark.createDataFrame([("a", 1, [["h", None], ["", " "], ["1\n2", "v"]])], "name string, pos int, rows array<array<string>>")
    assert {r.name: r.text for r in convert.page_texts(bodies, tables).collect()} == {"a": "one\n\ntwo\n\n[표]\nh | \n1 2 | v", "b": "x"}
    j = {r.name: r for r in convert.page_json(bodies, tables).collect()}
    assert j["a"].text == "one\n--- PAGE BREAK ---\ntwo" and j["b"].tables == []


def test_reports_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, "x"), ("a", 1, 'q "z"')], "k string, n int, extra string")
    files.write_csv(df, str(tmp_path / "c"), ["k", "extra"])
    back = files.csv(spark, str(tmp_path / "c"))
    assert back.columns == ["k", "extra"] and {(r.k, r.extra) for r in back.collect()} == {("b", "x"), ("a", 'q "z"')}
    files.write_json(df, str(tmp_path / "j"))
    files.write_json(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert markdown.text_of(markdown.table_report("# T", {"part": (df.select("k", "n"), ["k"])})).first().text == "# T\n\n## part\n\n| k | n |\n|---|---|\n| a | 1 |\n| b | 2 |\n\n"
    assert {r.status: (r.n, r.names) for r in files.tally(df.select(F.col("k").alias("name"), F.lit("ok").alias("status"))).collect()} == {"ok": (2, ["a", "b"])}
    lines = spark.createDataFrame([(0, "text,label"), (1, 'a, b "c",1'), (2, '"d, e",0'), (3, "f,1"), (4, "")], "pos int, value string")
    assert {r.pos: r.value for r in files.repaired_csv(lines).collect()} == {0: "text,label", 1: '"a, b ""c""",1', 2: '"d, e",0', 3: "f,1", 4: ""}
    blocks = spark.createDataFrame([("r", "".join(f"```\nb{i}\n```\n" for i in range(4))), ("s", "```\nx\n```\n")], "name string, text string")
    assert [tuple(r) for r in files.report_blocks(blocks).collect()] == [("r", "b0", "b1", "b2", "b3")]
    both = files.preferred_or_fallback(df, spark.createDataFrame([("a", 9, ""), ("z", 3, "")], df.schema), "k")
    assert {r.k: r.n for r in both.collect()} == {"a": 1, "b": 2, "z": 3}
    cases = reports.demo_cases(spark.createDataFrame([(1, "긴 문장입니다. 준비물 확인."), (2, "준비물. 짧다.")], "id int, text string"), "text", ["준비물", "없음"])
    assert [(r.term, r.sentence) for r in cases.collect()] == [("준비물", "준비물.")]
    parts = reports.dataset_report(
        spark.createDataFrame([("n1", 1, "s", True, "일정"), ("n1", None, "tt", False, "")], "notice_id string, original_id int, sentence string, is_todo boolean, category string"),
        spark.createDataFrame([(1, "web", "abc"), (2, "web", "")], "id int, source_type string, original_text string"), spark.createDataFrame([("k", "v", "")], "korean string, preferred_vi string, preferred_en string"), "sentence",
    )
    assert parts["summary"].first().n_notices == 1 and parts["original_lengths"].first().n == 1 and {r.column_name: r.filled for r in parts["glossary"].collect()} == {"preferred_vi": 1, "preferred_en": 0}


# filters, projections, small rules


def test_filters(spark):
    df = spark.createDataFrame([("a", "일정", "train"), (None, "비용", "train"), ("b", "other", "val"), ("c", None, "val")], "text string, category string, split string")
    assert [r.text for r in corpus.labelled(df).collect()] == ["a"]
    assert corpus.select_split(df, "val").count() == 2 and corpus.select_split(df, "all").count() == 4
    assert reports.split_or_all(df, "test").count() == 4 and reports.split_or_all(df, "val").count() == 2
    assert corpus.canonical_text(df.withColumnRenamed("text", "sentence")).columns[0] == "text"
    with pytest.raises(ValueError):
        corpus.canonical_text(df.drop("text"))
    seeded = corpus.seed(df.select("text", "split"), spark.createDataFrame([("a", "x"), ("z", "y")], "text string, split string"), "text")
    assert seeded.count() == 5


def test_small_rules(spark):
    assert one(spark, text.strip_markers(F.lit("■ ▶ 신청 안내 "))) == "신청 안내"
    assert one(spark, glossary.sentence_with(F.lit("하나. 둘 용어 있음! 셋"), F.lit("용어"))) == "둘 용어 있음!" and one(spark, glossary.sentence_with(F.lit("하나"), F.lit("용어"))) == ""
    assert one(spark, glossary.fuzzy_match(F.lit(" Fee "), F.lit("school fee"))) and not one(spark, glossary.fuzzy_match(F.lit("a"), F.lit("b")))
    assert one(spark, glossary.error_row("m"))["quality_label"] == "glossary_error"
    assert one(spark, i18n.nllb_code(F.lit("xx"))) == "vie_Latn" and one(spark, i18n.voice(F.lit("xx"))) == "" and one(spark, i18n.voice(F.lit("ja"))) == P.VOICES["ja"]
    assert one(spark, slots.amount(F.lit("회비 12,000원과 3만원"))) == 12000
    assert one(spark, rules.todo_label_id(F.lit("LABEL_7"))) == 7 and one(spark, rules.todo_label_id(F.lit("x"))) is None
    assert one(spark, rules.category_id(F.lit("비용"))) == 3 and one(spark, rules.category_id(F.lit("?"))) is None and one(spark, rules.category_of_id(F.lit(9))) == "기타"
    assert one(spark, evals.adopt(F.lit(0.9), F.lit(0.8))) == "adopt" and one(spark, evals.adopt(F.lit(0.8), F.lit(0.8))) == "keep"
    assert one(spark, client.first_shown(F.lit(" Null "), F.lit(None), F.lit(" x "))) == "x"
    assert one(spark, rules.is_todo(F.lit(None).cast("double"))) is False


# seams


def test_seam_errors_retries_and_lists(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id int, text string").coalesce(1)

    def call(rows):
        if len(rows) > 2:
            raise ValueError("too many")
        if any(t == "t3" for (t,) in rows):
            raise RuntimeError("t3 fails")
        return [[t, t.upper()] for (t,) in rows]

    got = {r.id: r for r in seams.with_model(df, ["text"], "found", ArrayType(StringType()), call, default=[], batch=2).collect()}
    assert got[1].found == ["t1", "T1"] and got[3].found == [] and "t3 fails" in got[3].found_error and got[2].found == ["t2", "T2"] and got[2].found_error is None

    def flaky_loader():
        return {"calls": 0}

    def flaky(state, rows):
        state["calls"] += 1
        if state["calls"] == 1:
            raise RuntimeError("first call")
        return [0.75 for _ in rows]

    done = seams.todo_probability(df, "text", flaky, load=flaky_loader, retries=1)
    assert all(r.probability == 0.75 and r.probability_error is None for r in done.collect())
    assert seams.checked(done, "probability").count() == 6
    with pytest.raises(RuntimeError):
        seams.checked(done.withColumn("probability_error", F.lit("e")), "probability")
    assert [r.found for r in seams.extracted_items(df.limit(1), "text", lambda rows: [["a"] for _ in rows]).collect()] == [["a"]]
    assert {r.translated for r in seams.translate(df.withColumn("lang", F.lit("vi")), "text", "lang", lambda rows: [a + b for a, b in rows]).collect()} >= {"t0vi"}


def test_short_translation(spark):
    df = spark.createDataFrame([(1, "참가비 5,000원을 https://a.b/c 로 내세요. 02-123-4567"), (2, "  "), (3, None), (4, "실패")], "id int, text string").withColumns({c: F.lit("own") for c in ("row", "short", "answer", "kept", "code")})
    asked = []

    def call(rows):
        out = []
        for t, code in rows:
            asked.append(t)
            if "실패" in t:
                raise RuntimeError("down")
            out.append(f"{code}|{t}|3.000 đô la")
        return out

    got = {r.id: r for r in translation.translate_short(df, "text", "vi", [("참가비", "phí tham gia"), ("참가", "x")], call).collect()}
    assert got[1].translated == "vie_Latn|참가(x)비(phí tham gia) 5,000원을 https://a.b/c 로 내세요. 02-123-4567|3,000 won"
    assert got[2].translated == got[3].translated == got[4].translated == "" and "down" in got[4].translated_error and got[1].answer == "own" and got[2].translated_error is None
    assert {r.translated for r in translation.translate_short(df, "text", "ko_easy", [], None).collect()} == {df.first().text, "", "실패"}


def test_review_of_translations(spark):
    df = spark.createDataFrame([(1, "참가비를 내 주세요. 꼭 확인하세요."), (2, " ")], "id int, text string")
    got = {r.id: r for r in translation.translate_and_review(df, "text", "vi", [("참가비", "phí")], lambda rows: [t.replace("참가비", "fee") for t, _ in rows]).collect()}
    assert got[1].review_needed == "참가비->phí" and got[1].vi_text == got[1].translation and "fee" in got[1].translation
    assert got[2].quality_note == got[2].translation == got[2].review_needed == ""
    fine = {r.id: r for r in translation.translate_and_review(df, "text", "en", [("참가비", "fee")], lambda rows: ["the fee" for _ in rows]).collect()}
    assert fine[1].quality_note == "ok (ok)" and fine[1].review_needed == "" and fine[1].vi_text == ""
    easy = translation.translate_and_review(df, "text", "ko_easy", [("참가비", "x")], None).filter("id = 1").first()
    assert easy.translation == "" and easy.review_needed == ""


def test_judge_prompts_and_failures(spark):
    rows = [(1, "t", "in", "out", "b", "bo"), (2, None, "in", "", "b", "bo"), (3, "t", "in", "x", "b", "bo")]
    df = spark.createDataFrame(rows, "notice_id int, title string, a_input string, a_translation string, b_input string, b_translation string")

    def call(asked):
        return ["no answer" if "\nx\n" in p else json.dumps({"a_score": "101", "b_score": None, "a_issues": "i"}) for (p,) in asked]

    got = judges.judge_ab(df, "Thai", call, wait=0.0).collect()
    assert [(r.notice_id, r.a_score, r.b_score, r.a_issues, r.verdict) for r in got] == [(1, 100, 0, "i", "")]
    missing = spark.createDataFrame([("a",), ("b",)], "korean_term string")
    s = spark.createDataFrame([("a", "1"), ("a", "2")], "korean string, suggestion string")
    assert {r.korean_term: r.suggestion for r in judges.with_suggestions(missing, s).collect()} == {"a": "2", "b": ""}


def test_model_store(spark, tmp_path):
    rows = [(f"준비물 {i} 가위", "준비물") for i in range(12)] + [(f"참가비 {i}원 납부", "비용") for i in range(6)]
    df = spark.createDataFrame(rows, "text string, category string")
    place = str(tmp_path / "model")
    ml.load_or_train(place, df)
    again = ml.load_or_train(place, df.limit(0))  # nothing to train on: it is read
    got = ml.predict(again, spark.createDataFrame([("참가비 500원 납부",), (" ",), (None,)], "text string")).collect()
    assert got[0].predicted == "비용" and all(r.predicted == "기타" and r.confidence == 0 for r in got[1:])
    top = spark.range(1).select(ml.top_classes(F.create_map(F.lit("b"), F.lit(0.4), F.lit("a"), F.lit(0.4), F.lit("c"), F.lit(0.2)), 2).alias("x")).first().x
    assert [t.label for t in top] == ["a", "b"]


def test_slot_rows_of_null(spark):
    df = spark.createDataFrame([(1, None), (2, "3월 5일 10:30")], "id int, text string")
    assert sorted((r.id, r.slot, r.ko) for r in cards.slot_rows(df, "id").collect()) == [(2, "dates", "3월 5일"), (2, "times", "10:30")]


def test_split_of_large_and_small_groups(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 5, None).otherwise(F.when(F.col("id") < 1500, "a").otherwise("b")).alias("g"), "id", F.lit("own").alias("row"))
    got = corpus.stratified_split(df, "g", -F.col("id"))
    n = {(r.g, r.split): r["count"] for r in got.groupBy("g", "split").count().collect()}
    assert n["a", "train"] == round(1495 * 0.8) and n["a", "val"] == 150 and n["b", "train"] == 400 and n[None, "train"] == 4 and n[None, "val"] == 1
    assert got.filter("g = 'b' and split = 'train'").agg(F.min("id")).first()[0] == 1600 and got.columns == [*df.columns, "split"]


def test_scratch_tables_go(spark):
    import os

    from noticeflow.runtime import scratch, staged

    with scratch() as keep:
        a, b = staged(spark.range(3), "a"), staged(spark.range(4), "b")
        keep(b)
    there = [os.path.exists(x._staged_path.removeprefix("file://")) for x in (a, b)]
    assert there == [False, True] and b.count() == 4
