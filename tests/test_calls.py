"""Token budgets, seconds of calls, rate limits, and models that a worker process holds."""

import glob
import os
import time
import uuid

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.operators import judges, seams, token_budget, translation

FILES = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")]
TEXT = ["Dear parents, the trip is on 5 March.", "Bring lunch (and water)!", "Don't be late.", "도시락을 준비해 주세요.", "x", "A very long sentence that goes on and on about nothing in particular, with 12,345 words.", "«Déjà vu», said she…", "ok 🙂."]


# token budgets


def greedy(parts, budget, count):
    """Each candidate text counted anew."""
    out, now = [], []
    for p in parts:
        if now and count(" ".join([*now, p])) > budget:
            out.append(" ".join(now))
            now = [p]
        else:
            now.append(p)
    return [*out, " ".join(now)] if now else out


def real_count(path):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda s: len(t.encode(s, add_special_tokens=True).ids)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda s: len(m.encode(s)) + 2


@pytest.mark.parametrize("path", [None, *FILES])
def test_token_chunks(spark, path):
    rng = np.random.RandomState(1)
    lists = [[TEXT[k] for k in rng.randint(0, len(TEXT), n)] for n in (0, 1, 2, 5, 9, 40, 120)]
    df = spark.createDataFrame([*((i, p) for i, p in enumerate(lists)), (98, None), (99, [None, "a b", None])], "id int, parts array<string>")
    count = real_count(path) if path else lambda s: len(s.split())
    for budget in (1, 12, 40, 384):
        got = {r.id: r.own for r in token_budget.token_chunks(df, "parts", budget, path, output="own").collect()}
        for i, p in enumerate(lists):
            assert [c.text for c in got[i]] == greedy(p, budget, count), (i, budget)
            assert [c.n_tokens for c in got[i]] == [count(c.text) for c in got[i]]
        assert got[98] == [] and [c.text for c in got[99]] == ["a b"]


def test_long_text_of_sentences():
    """Chunks cost a bisection each, not a count of all that is joined."""
    n = 2_000_000
    start = time.time()
    ends, tokens = token_budget.cut(np.full(n, 3), np.full(n, 4), 384, 1)
    assert time.time() - start < 5 and ends[0] == 96 and tokens[0] == 1 + 3 + 95 * 4 and ends[-1] == n


# seconds


def test_seconds(spark):
    df = spark.createDataFrame([(i, f"Sentence {i} one. Two here! " * 12) for i in range(6)] + [(9, "")], "id int, text string")

    def slow(rows):
        time.sleep(0.01 * len(rows))
        return [t.upper() for t, _ in rows]

    totals = seams.Totals(spark)
    parts = df.select("id", F.explode(F.split("text", r"\. ")).alias("part"), F.lit("en").alias("code"))
    rows = seams.with_model(parts, ["part", "code"], "answer", T.StringType(), slow, batch=2, seconds=True, totals=totals).collect()
    assert all(r.answer_seconds >= 0.009 for r in rows) and totals.rows.value == len(rows) and totals.failed.value == 0
    assert abs(totals.seconds.value - sum(r.answer_seconds for r in rows)) < 1e-6
    out = {r.id: r for r in translation.translate_chunks(df, "id", "text", "en", slow, budget=12, tokenizer="words", seconds=True).collect()}
    assert out[0].n_chunks == 6 and out[0].seconds >= 0.05 and (out[9].n_chunks, out[9].translated, out[9].seconds) == (0, "", 0.0)


# limits


def test_waits_of_limits():
    limits, waits = seams.Limits(attempts=3, delay=4.0, longest=90.0), []

    def failing(*errors):
        left = list(errors)

        def call():
            if left:
                raise RuntimeError(left.pop(0))
            return ["done"]
        return call

    assert seams.limited(failing("429 slow down, retry in 2.5s", "RESOURCE_EXHAUSTED"), limits, waits.append) == ["done"] and waits == [2.5, 12.0]
    waits.clear()
    assert seams.limited(failing("503", "UNAVAILABLE"), limits, waits.append) == ["done"] and waits == [4.0, 4.0]
    waits.clear()
    for error in ("400 bad request", "429 retry in 91s"):
        with pytest.raises(RuntimeError) as e:
            seams.limited(failing(error), limits, waits.append)
        assert isinstance(e.value, seams.QuotaUsedUp) == ("91" in error)
    with pytest.raises(RuntimeError, match="503 last"):
        seams.limited(failing("503", "503", "503 last"), limits, waits.append)
    assert waits == [4.0, 4.0]


def test_service_with_a_quota(spark, tmp_path):
    """A stand-in that refuses the first call, is not available at the third, and stops for the day at 'stop'."""
    place = str(tmp_path)

    def call(rows):
        with open(f"{place}/{time.time_ns()}-{uuid.uuid4().hex}", "w") as f:
            f.write(rows[0][0])
        n = len(glob.glob(f"{place}/*"))
        if n == 1:
            raise RuntimeError("429 Too many, retry in 0.05s")
        if n == 3:
            raise RuntimeError("503 try later")
        if rows[0][0] == "bad":
            raise ValueError("no such thing")
        if rows[0][0] == "stop":
            raise RuntimeError("429 quota, retry in 3600s")
        return [t.upper() for (t,) in rows]

    texts = ["a", "b", "bad", "c", "stop", "d", "e"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    limits = seams.Limits(attempts=3, delay=0.02, longest=1.0)
    got = {r.id: r for r in seams.with_model(df, ["text"], "answer", T.StringType(), call, default="none", batch=1, limits=limits).collect()}
    assert [got[i].answer for i in range(7)] == ["A", "B", "none", "C", "none", "none", "none"]
    assert "no such thing" in got[2].answer_error and all("QuotaUsedUp" in got[i].answer_error for i in (4, 5, 6))
    assert len(glob.glob(f"{place}/*")) == 1 + 1 + 1 + 1 + 1 + 1 + 1  # a twice, b twice, then bad, c and stop; d and e make no call


def test_calls_per_second(spark, tmp_path):
    place = str(tmp_path)

    def call(rows):
        open(f"{place}/{time.time_ns()}-{uuid.uuid4().hex}", "w").close()
        return [t for (t,) in rows]

    df = spark.range(12).select(F.col("id").cast("string").alias("text")).repartition(4)
    out = seams.with_model(df, ["text"], "answer", T.StringType(), call, batch=1, limits=seams.Limits(per_second=10.0, lanes=2))
    assert out.rdd.getNumPartitions() == 2 and out.filter("text = answer").count() == 12
    at = sorted(int(os.path.basename(p).split("-")[0]) / 1e9 for p in glob.glob(f"{place}/*"))
    assert len(at) == 12 and at[-1] - at[0] >= 0.9  # 12 calls at 10 a second, two at a time


def test_judges_take_limits(spark):
    df = spark.createDataFrame([(1, "t", "x", "tx", "y", "ty")], "notice_id int, title string, a_input string, a_translation string, b_input string, b_translation string")

    def call(rows):
        raise RuntimeError("429, retry in 500s")

    assert judges.judge_ab(df, "Thai", call, limits=seams.Limits()).count() == 0
    answers, failed = judges.judged_ab(df, "Thai", call, limits=seams.Limits())
    assert answers.count() == 0 and [(r.notice_id, r.answer, "QuotaUsedUp" in r.answer_error) for r in failed.collect()] == [(1, "", True)]
    assert judges.suggest_terms(spark.createDataFrame([("가",)], "korean string"), "vi", call, limits=seams.Limits()).first().suggestion == ""
    answers, failed = judges.judged_terms(spark.createDataFrame([("vi", "k", "s", "t", "p"), ("vi", "k2", "s", "t", "p")], "lang string, korean_term string, sentence string, nllb_translation string, glossary_preferred string"), lambda rows: ['{"before_score": "7"}' if '"k"' in p or "term: k ->" in p else "no json" for (p,) in rows])
    assert [r.before_score for r in answers.collect()] == [7] and [(r.korean_term, r.answer) for r in failed.collect()] == [("k2", "no json")]


# life cycle


def test_a_process_loads_once(spark, tmp_path):
    """50 tasks on 4 workers: with a key as many loads as there are worker processes, without one a load for each task."""
    model, loads = tmp_path / "model.txt", tmp_path / "loads"
    model.write_text("!")
    loads.mkdir()

    def load(path):
        (loads / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return open(path).read()

    df = spark.range(50).select(F.col("id").cast("string").alias("text")).repartition(50)
    from_file = seams.from_file(spark, str(model), load)
    for key in (f"model-{uuid.uuid4().hex}", None):
        for f in loads.iterdir():
            f.unlink()
        out = seams.with_model(df, ["text"], "answer", T.StringType(), lambda m, rows: [t + m for (t,) in rows], load=from_file, key=key)
        assert out.filter(F.col("answer") == F.concat("text", F.lit("!"))).count() == 50
        pids = [f.name.split("-")[0] for f in loads.iterdir()]
        if key:
            assert len(pids) == len(set(pids)) < 50
        else:
            assert len(pids) == 50
