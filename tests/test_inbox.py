"""The durable inbox: send, list, delete, change, list again; and the table operators it shares."""

import os

from pyspark.sql import functions as F

from noticeflow.operators import corpus
from noticeflow.sources.inbox import Inbox, box_of

SCHEMA = "notice_id string, parent_id string, text string"


def listed(inbox, who):
    return sorted((r.notice_id, r.text) for r in inbox.of(who).collect())


def modified(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("box=")}


def test_life_of_an_inbox(spark, tmp_path):
    path = str(tmp_path / "inbox")
    box = Inbox(spark, path, SCHEMA, boxes=8)
    assert box.rows().count() == 0 and listed(box, "p1") == []
    assert box.clear(spark.createDataFrame([("p1",)], "parent_id string")).count() == 0
    box.send(spark.createDataFrame([(f"n{i}", f"p{i % 5}", f"t{i}") for i in range(20)] + [("lost", None, "x")], SCHEMA))
    box.send(spark.createDataFrame([("n99", "p1", "again")], SCHEMA))
    assert listed(box, "p1") == [("n1", "t1"), ("n11", "t11"), ("n16", "t16"), ("n6", "t6"), ("n99", "again")] and box.rows().count() == 21
    before = modified(path)
    places = {r.p: r.b for r in spark.createDataFrame([(f"p{i}",) for i in range(5)], "p string").select("p", box_of(F.col("p"), 8).alias("b")).collect()}
    gone = box.clear(spark.createDataFrame([("p1",), ("p1",), ("nobody",), (None,)], "parent_id string"))
    assert [(r.parent_id, r.deleted) for r in gone.collect()] == [("p1", 5)]
    after = modified(path)
    mine = f"box={places['p1']}"
    assert all(after.get(d) == v for d, v in before.items() if d != mine) and after.get(mine) != before[mine]
    assert listed(box, "p1") == [] and box.rows().count() == 16
    # one receiver after the other, until no box is left
    for k in (0, 2, 3, 4):
        assert [r.deleted for r in box.clear(spark.createDataFrame([(f"p{k}",)], "parent_id string")).collect()] == [4]
    assert box.rows().count() == 0 and not any(modified(path).values())
    box.send(spark.createDataFrame([("n1", "p1", "new")], SCHEMA))
    assert listed(box, "p1") == [("n1", "new")]


def test_changes(spark, tmp_path):
    box = Inbox(spark, str(tmp_path / "inbox"), SCHEMA, boxes=4)
    box.send(spark.createDataFrame([("n1", "a", "old"), ("n2", "a", "stays"), ("n1", "b", "other receiver")], SCHEMA))
    changes = spark.createDataFrame([("n1", "a", "z first", 1), ("n1", "a", "a last", 2), ("n3", "c", "added", 1), ("n3", "c", "added", 1), ("n4", None, "x", 1)], SCHEMA + ", seq int")
    box.change(changes, "seq")
    assert sorted(map(tuple, box.rows().collect())) == [("n1", "a", "a last"), ("n1", "b", "other receiver"), ("n2", "a", "stays"), ("n3", "c", "added")]
    box.change(changes.drop("seq").limit(0))
    box.change(spark.createDataFrame([("n2", "a", "x"), ("n2", "a", "y")], SCHEMA))
    assert listed(box, "a") == [("n1", "a last"), ("n2", "y")]


def test_repeated_keys_and_own_columns(spark):
    """Columns that are named like the helpers stay; of repeated keys one row stays, always the same."""
    own = {"row": F.lit("r"), "k": F.lit(1), "n": F.lit(2), "_n": F.lit(3), "_id": F.lit(4), "_l": F.lit(5), "place": F.lit(6), "at": F.lit(7), "own": F.lit(8), "part": F.lit(9), "by": F.lit(10), "key": F.lit(11), "s": F.lit(12), "before": F.lit(13), "_k": F.lit(14), "l": F.lit(15), "best": F.lit(16)}
    df = spark.createDataFrame([(1, "a", ""), (2, "b", "x"), (2, "b", "y"), (3, None, None)], "id int, label string, cell string").withColumns(own)
    changes = df.filter("id = 2").withColumn("cell", F.concat("cell", F.lit("!")))
    assert sorted((r.id, r.cell or "") for r in corpus.upsert(df, changes, "id").collect()) == [(1, ""), (2, "y!"), (3, "")]
    assert [r.cell for r in corpus.upsert(df, changes.withColumn("k", F.when(F.col("cell") == "x!", 9).otherwise(0)), "id", "k").filter("id = 2").collect()] == ["x!"]
    assert corpus.keep_first(df, ["label"], F.col("cell").desc()).columns == df.columns and corpus.keep_first(df, ["label"], F.col("cell").desc()).count() == 3
    weights = corpus.class_weights(df, "label")
    assert weights.columns == [*df.columns, "weight"] and {r.label: r.weight for r in weights.collect()} == {"a": 4 / 3, "b": 2 / 3}
    numbered = corpus.numbered(df, "cell", 5, name="number")
    assert numbered.columns == [*df.columns, "number"] and sorted(r.number for r in numbered.collect()) == [5, 6, 7, 8]
    suggestions = spark.createDataFrame([(1, "p"), (1, "q"), (2, "z")], "id int, suggestion string")
    filled = corpus.fill_blank(df, suggestions, "id", "cell")
    assert filled.columns == df.columns and sorted((r.id, r.cell) for r in filled.collect()) == [(1, "q"), (2, "x"), (2, "y"), (3, "")]
    labelled = corpus.filled_from(df, spark.createDataFrame([(1, "one")], "id int, cell string"), "id", "cell", F.lit("rule"))
    assert sorted((r.id, r.cell, r.origin) for r in labelled.collect()) == [(1, "one", "labelled"), (2, "rule", "rule"), (2, "rule", "rule"), (3, "rule", "rule")]
