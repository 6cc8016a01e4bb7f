"""The query over two runs of the ledger, against scanning every version of every path."""

from pyspark.sql import functions as F

from noticeflow.llm import queries, secrets

SF = "/root/testdata/sf0.001"


def test_two_runs(spark):
    got = {(r.path, r.version): (r.n_spans, r.spans) for r in queries.secret_ledger(spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    history = [(f"documents/{i}", 1, t or "") for i, t in docs] + [(f"documents/{i}", 2, (t or "").rstrip(" ")) for i, t in docs] + [(f"pages/{i}", 2, t or "") for i, t in pages]
    want = {}
    for path, version, text in history:
        found = secrets.find(text)
        if found:
            want[path, version] = (len(found), ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found))
    assert got == want
    assert {v for _, v in got} == {1, 2} and len(got) >= 2


def test_a_blob_in_many_paths(spark, tmp_path):
    history = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("path"), F.lit(1).alias("version"), F.when(F.col("id") % 3 == 0, "token=abcdefghijklmnop").otherwise(F.concat(F.lit("password = 'x"), F.lpad(F.col("id").cast("string"), 12, "0"))).alias("text"))
    place = str(tmp_path / "ledger")
    assert secrets.scan_history(history, place).count() == 3000
    assert spark.read.parquet(place).count() == 2001


def test_a_second_run_moves_unseen_texts_only(spark, tmp_path, monkeypatch):
    history = spark.createDataFrame([("a", 1, "token=abcdefghijklmnop"), ("b", 1, "none"), ("c", 1, None)], "path string, version int, text string")
    more = history.unionByName(spark.createDataFrame([("d", 1, "secret=abcdefghijklmnop"), ("e", 1, "secret=abcdefghijklmnop")], history.schema))
    plans, scan = [], secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda unseen, version: (plans.append(unseen._jdf.queryExecution().executedPlan().toString()), scan(unseen, version))[1])
    place = str(tmp_path / "ledger")
    secrets.scan_history(history, place)
    assert {r.path for r in secrets.scan_history(more, place).collect()} == {"a", "d", "e"} and spark.read.parquet(place).count() == 4
    # the join is below the only exchange of texts
    assert plans[1].index("HashAggregate") < plans[1].index("BroadcastHashJoin") and plans[1].count("Exchange hashpartitioning") == 1
