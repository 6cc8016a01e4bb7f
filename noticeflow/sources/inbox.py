"""A durable inbox: notices by receiver in a folder of Parquet files.

Receivers are dealt into boxes by hash, and a box is a partition of the folder,
so a receiver's notices are read from one partition whatever the number of
receivers. Sending appends. Deleting and changing rewrite the boxes that have
one of the receivers in question and leave all others as they are; a box that
is left without rows goes. A rewrite is staged before it replaces anything, so
a job that is lost midway can be run again; readers of a box that is being
replaced may see it without its rows for a moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from noticeflow.operators.corpus import last_rows
from noticeflow.runtime import maybe_broadcast, release, staged

#: Fixed for a folder: another number of boxes would look for receivers in other places.
BOXES = 256


def box_of(receiver: Column, boxes: int = BOXES) -> Column:
    return F.pmod(F.xxhash64(receiver), F.lit(boxes)).cast("int")


class Inbox:
    """Notices (any columns, among them a receiver and a key) at a place. Rows without a receiver are not kept."""

    def __init__(self, spark: SparkSession, path: str, schema, receiver: str = "parent_id", key: str = "notice_id", boxes: int = BOXES):
        self.spark, self.path, self.receiver, self.key, self.boxes = spark, path.rstrip("/"), receiver, key, boxes
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.fieldNames()

    def _stored(self) -> DataFrame:
        """All rows with their box; none where nothing was ever sent."""
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        try:
            return self.spark.read.schema(f"{kinds}, box int").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{kinds}, box int")

    def _boxed(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(self.receiver).isNotNull()).select(*self.columns, box_of(F.col(self.receiver), self.boxes).alias("box"))

    def rows(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def of(self, receiver) -> DataFrame:
        """The notices of one receiver, from one box."""
        kind = self.schema[self.receiver].dataType
        box = self.spark.range(1).select(box_of(F.lit(receiver).cast(kind), self.boxes)).first()[0]
        return self._stored().filter((F.col("box") == box) & (F.col(self.receiver) == F.lit(receiver).cast(kind))).select(*self.columns)

    def send(self, notices: DataFrame) -> None:
        """Appends; a file for each box and task at most, tasks being boxes."""
        self._boxed(notices).repartition("box").write.mode("append").partitionBy("box").parquet(self.path)

    def clear(self, receivers: DataFrame) -> DataFrame:
        """Deletes all notices of the receivers (a column of the receiver's name); gives receiver and deleted, of those that had any."""
        gone = receivers.select(self.receiver).filter(F.col(self.receiver).isNotNull()).distinct()
        named = staged(gone.withColumn("box", box_of(F.col(self.receiver), self.boxes)), "receivers")
        touched = self._touched(named)
        theirs = touched.join(maybe_broadcast(named), [self.receiver, "box"], "left_semi")
        counts = staged(theirs.groupBy(self.receiver).agg(F.count(F.lit(1)).alias("deleted")), "deleted")
        self._replace(touched, touched.join(maybe_broadcast(named), [self.receiver, "box"], "left_anti"))
        release(named)
        return counts

    def change(self, changes: DataFrame, order: str | None = None) -> None:
        """Rows of the same receiver and key are replaced, others added. Of changes that share both the last in
        ``order`` wins (without one the greatest row), so a repeated key has one row."""
        last = last_rows(changes.filter(F.col(self.receiver).isNotNull()), [self.receiver, self.key], order)
        new = staged(self._boxed(last), "changes")
        touched = self._touched(new)
        stay = touched.join(new.select(self.receiver, self.key, "box"), [self.receiver, self.key, "box"], "left_anti")
        self._replace(touched, stay.unionByName(new))
        release(new)

    def _touched(self, named: DataFrame) -> DataFrame:
        """The stored rows of the boxes that ``named`` has. The numbers of boxes come to the driver: no more than there are boxes."""
        some = [r.box for r in named.select("box").distinct().collect()]
        return self._stored().filter(F.col("box").isin(some))

    def _replace(self, touched: DataFrame, rows: DataFrame) -> None:
        """Writes ``rows`` in place of the boxes that ``touched`` has rows of."""
        new = staged(rows.select(*self.columns, "box"), "boxes")
        before = {r.box for r in touched.select("box").distinct().collect()}
        after = {r.box for r in new.select("box").distinct().collect()}
        if after:
            new.repartition("box").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("box").parquet(self.path)
        jvm = self.spark._jvm
        for box in sorted(before - after):  # nothing is written for a box without rows
            place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/box={box}")
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.spark.catalog.refreshByPath(self.path)
        release(new)
