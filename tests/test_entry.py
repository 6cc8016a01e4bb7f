"""The driver contract: names agree, and every registered query of the small table has its SQL's rows."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["notice_dates", "due_date_as_of", "rule_importance", "doc_sentences", "term_hits", "coverage_check", "stratified_split", "prf1", "threshold_sweep", "turn_concat"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "notice_cards" in entry.queries()


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(map(_plain, r)) for r in df.select(*cols).collect()) == sorted(tuple(_plain(r[i]) for i in at) for r in want.fetchall())
