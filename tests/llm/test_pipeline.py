"""The pipeline's stages on a small table, each against brute force on its own input."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from llm.test_operators import contamination, line_brute, pairs, sha
from noticeflow.llm.queries import ORACLES
from noticeflow.runtime import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), name)
        seen[name] = (docs, out)
        if name != "bpe":
            assert out.columns == columns
        docs = out
    before, after = seen["line_dedup"]
    want = {d: (n, s) for d, n, _, s in line_brute(pairs(before), 10)}
    assert {d: sha(t) for d, t in pairs(after)} == {d: s for d, (_, s) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {d for d, _ in pairs(after)} == {r[0] for r in contamination(pairs(before), bench) if not r[-1]}
    before, after = seen["bpe"]
    assert after.count() == before.count() and set(after.columns) == {*columns, "n_tokens", "ids"}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = seen["quality"]
    stays = {d for d, _ in pairs(after)}
    assert all((d in stays) == (labels[d] == 1) for d, _ in pairs(before) if d in labels)
    before, after = seen["near_dedup"]
    assert {t for _, t in pairs(after)} <= {t for _, t in pairs(before)} and after.count() < before.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)
