"""Tables of pages, from ruling lines and characters.

A page comes as rows: lines (name, page, x0, x1, top, bottom), which are level
or upright, and characters (name, page, pos, text, x0, x1, top, bottom). Ends
and positions within a tolerance of each other are one; pieces of a line that
touch are one segment. The segments' crossings are swept along each segment:
the cell below and right of a crossing ends at the first crossing to the right
from which a segment goes down, and at the first one below from which a segment
goes right, if the segments through these two cross. Cells that share a corner
are one table. All of this is windows over pages and segments, joins on
segments and a pass over the cells of a page, so pages spread over the cluster
and cost grows with the crossings. A table of lines or characters is as small
as a file as it is large in memory, and the planner knows the file only: all
joins here are merge joins, as what it would broadcast passes the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.runtime import release, ship, staged

TOLERANCE = 3.0
PAGE = ["name", "page"]


def _runs(df: DataFrame, by: list[str], value: str, ends: str, tolerance: float, name: str) -> DataFrame:
    """Adds ``name``: a number for each run of rows, in order of ``value``, none of which starts more than the
    tolerance after all before it have ended."""
    w = W.partitionBy(*by).orderBy(value, ends)
    before = F.max(ends).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(value) - before > tolerance), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def _segments(lines: DataFrame, level: bool, tolerance: float) -> DataFrame:
    """name, page, at, lo, hi: segments of one direction; lines whose positions are within the tolerance of a
    neighbour's lie at their mean, and of those the ones that touch are one."""
    across, along = (("top", "bottom"), ("x0", "x1")) if level else (("x0", "x1"), ("top", "bottom"))
    thin = F.abs(F.col(across[1]) - F.col(across[0])) <= tolerance
    longer = F.abs(F.col(along[1]) - F.col(along[0])) > F.abs(F.col(across[1]) - F.col(across[0]))
    d = lines.filter(thin & longer).select(*PAGE, ((F.col(across[0]) + F.col(across[1])) / 2).alias("pos"), F.least(*along).alias("lo"), F.greatest(*along).alias("hi"))
    d = _runs(d, PAGE, "pos", "pos", tolerance, "rule")
    d = d.withColumn("at", F.avg("pos").over(W.partitionBy(*PAGE, "rule")))
    d = _runs(d, [*PAGE, "rule"], "lo", "hi", tolerance, "piece")
    return d.groupBy(*PAGE, "rule", "piece").agg(F.first("at").alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("rule", "piece")


def crossings(lines: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """name, page, h, v, x, y: where a level segment h (its y and where it starts) meets an upright one v."""
    h = _segments(lines, True, tolerance).select(*PAGE, F.struct("at", "lo").alias("h"), F.col("at").alias("y"), F.col("lo").alias("x0"), F.col("hi").alias("x1"))
    v = _segments(lines, False, tolerance).select(*PAGE, F.struct("at", "lo").alias("v"), F.col("at").alias("x"), F.col("lo").alias("y0"), F.col("hi").alias("y1"))
    meet = F.col("x").between(F.col("x0") - tolerance, F.col("x1") + tolerance) & F.col("y").between(F.col("y0") - tolerance, F.col("y1") + tolerance)
    return h.join(v.hint("merge"), PAGE).filter(meet).select(*PAGE, "h", "v", "x", "y")


def cells(lines: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """name, page, x0, x1, top, bottom of the rectangles that lines enclose on all sides and do not divide."""
    points = staged(crossings(lines, tolerance), "crossings")
    # from the far end of each segment back, so that one pass over it is enough
    left, up = W.partitionBy(*PAGE, "h").orderBy(F.desc("x")), W.partitionBy(*PAGE, "v").orderBy(F.desc("y"))
    passed = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    d = points.withColumns({"goes_right": F.lag("x").over(left).isNotNull(), "goes_down": F.lag("y").over(up).isNotNull()})
    ends_right = F.last(F.when(F.col("goes_down"), F.struct("v", "x")), ignorenulls=True).over(passed(left))
    ends_down = F.last(F.when(F.col("goes_right"), F.struct("h", "y")), ignorenulls=True).over(passed(up))
    d = d.withColumns({"r": ends_right, "b": ends_down}).filter("goes_right AND goes_down AND r IS NOT NULL AND b IS NOT NULL")
    d = d.select(*PAGE, F.col("x").alias("x0"), F.col("r.x").alias("x1"), F.col("y").alias("top"), F.col("b.y").alias("bottom"), F.col("b.h").alias("h"), F.col("r.v").alias("v"))
    found = staged(d.join(points.select(*PAGE, "h", "v").hint("merge"), [*PAGE, "h", "v"], "left_semi").drop("h", "v"), "cells")
    release(points)
    return found


def table_numbers(boxes: list[tuple], least_cells: int) -> list[int]:
    """For the cells (top, x0, bottom, x1) of a page, in order, the number of the table of each; 0 for cells of frames."""
    root, at = list(range(len(boxes))), {}

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, (y0, x0, y1, x1) in enumerate(boxes):
        for corner in ((x0, y0), (x0, y1), (x1, y0), (x1, y1)):
            a, b = sorted((top(i), top(at.setdefault(corner, i))))
            root[b] = a
    of = [top(i) for i in range(len(boxes))]
    sizes: dict[int, int] = {}
    for r in of:
        sizes[r] = sizes.get(r, 0) + 1
    names: dict[int, int] = {}
    return [names.setdefault(r, len(names) + 1) if sizes[r] >= least_cells else 0 for r in of]


def table_cells(found: DataFrame, least_cells: int = 2) -> DataFrame:
    """name, page, table, x0, x1, top, bottom: cells (see ``cells``) with the number of their table on the page, from 1,
    in order of the tables' upper left corners. Groups of fewer than ``least_cells`` cells are frames, no tables."""
    ship(found.sparkSession)
    order = ["top", "x0", "bottom", "x1"]

    def number(page: pa.Table) -> pa.Table:
        page = page.sort_by([(c, "ascending") for c in order])
        return page.append_column("table", pa.array(table_numbers(list(zip(*(page[c].to_pylist() for c in order), strict=True)), least_cells), pa.int32()))

    d = found.select(*PAGE, "x0", "x1", "top", "bottom")
    d = d.groupBy(*PAGE).applyInArrow(number, d.withColumn("table", F.lit(0)).schema)
    return staged(d.filter(F.col("table") > 0).select(*PAGE, "table", "x0", "x1", "top", "bottom"), "tables")


def _words(chars: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """``by`` and rows: an array of the lines of characters, each an array of its words, both in reading order. A
    line takes in the characters that start within the tolerance of the one before; a blank or a gap ends a word."""
    blank = F.col("text").rlike(r"(?U)\A\s*\z")
    d = _runs(chars.filter(F.col("text").isNotNull()), by, "top", "top", tolerance, "line")
    w = W.partitionBy(*by, "line").orderBy("x0", "pos")
    gap = F.col("x0") - F.lag("x1").over(w) > tolerance
    starts = F.coalesce(gap, F.lit(True)) | F.coalesce(F.lag(blank).over(w), F.lit(True))
    d = d.withColumns({"_start": F.when(starts, 1).otherwise(0), "_blank": blank})
    d = d.withColumn("word", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).filter("NOT _blank")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "pos", "text"))), lambda c: c["text"]), "")
    words = d.groupBy(*by, "line", "word").agg(text.alias("text"))
    lines = words.groupBy(*by, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]).alias("words"))
    return lines.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "words"))), lambda x: x["words"]).alias("rows"))


def _inside(boxes: DataFrame, chars: DataFrame, how: str, edge: bool) -> DataFrame:
    """Characters with the boxes that hold their centres. Boxes meet characters by page and by bands of the
    page's height, so that a character is held against those of its band only."""
    x, y = (F.col("c.x0") + F.col("c.x1")) / 2, (F.col("c.top") + F.col("c.bottom")) / 2
    band = lambda c: F.floor(c / 20)
    c = chars.withColumn("band", band((F.col("top") + F.col("bottom")) / 2)).alias("c")
    b = boxes.withColumn("band", F.explode(F.sequence(band(F.col("top")), band(F.col("bottom"))))).alias("b")
    same = (F.col("c.name") == F.col("b.name")) & (F.col("c.page") == F.col("b.page")) & (F.col("c.band") == F.col("b.band"))
    upto = (lambda v, hi: v <= hi) if edge else (lambda v, hi: v < hi)
    within = (x >= F.col("b.x0")) & upto(x, F.col("b.x1")) & (y >= F.col("b.top")) & upto(y, F.col("b.bottom"))
    return c.join(b.hint("merge"), same & within, how)


def table_boxes(tabled: DataFrame) -> DataFrame:
    """name, page, table, x0, x1, top, bottom of each table of ``table_cells``."""
    return tabled.groupBy(*PAGE, "table").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def table_rows(tabled: DataFrame, chars: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """name, page, table, rows: each table as an array of rows of cells, one for every place where a cell of the
    table starts. A cell's words are joined by blanks; places inside a wider or higher cell are ''."""
    held = _inside(tabled, chars, "inner", edge=False).select("c.name", "c.page", F.col("b.table").alias("table"), F.col("b.top").alias("row_at"), F.col("b.x0").alias("column_at"), "c.pos", "c.text", "c.x0", "c.x1", "c.top")
    texts = _words(held, [*PAGE, "table", "row_at", "column_at"], tolerance).withColumn("text", F.array_join(F.flatten("rows"), " ")).drop("rows")
    at = tabled.select(*PAGE, "table", F.col("top").alias("row_at"), F.col("x0").alias("column_at"))
    named = at.join(texts.hint("merge"), [*PAGE, "table", "row_at", "column_at"], "left")
    columns = at.groupBy(*PAGE, "table").agg(F.array_sort(F.collect_set("column_at")).alias("columns"))
    row = named.groupBy(*PAGE, "table", "row_at").agg(F.map_from_entries(F.collect_list(F.struct("column_at", F.coalesce("text", F.lit(""))))).alias("texts"))
    row = row.join(columns.hint("merge"), [*PAGE, "table"]).withColumn("cells", F.transform("columns", lambda x: F.coalesce(F.element_at("texts", x), F.lit(""))))
    return row.groupBy(*PAGE, "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_at", "cells"))), lambda r: r["cells"]).alias("rows"))


def page_lines(chars: DataFrame, boxes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """name, page, body: lines of the characters outside the table boxes, words joined by blanks. Pages that have
    characters in tables only have no row."""
    free = _inside(boxes, chars, "left_anti", edge=True).drop("band")
    return _words(free, PAGE, tolerance).select(*PAGE, F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), "\n").alias("body"))


def read_pages(chars: DataFrame, lines: DataFrame, tolerance: float = TOLERANCE, least_cells: int = 2) -> tuple[DataFrame, DataFrame]:
    """(bodies, tables) as ``convert.page_texts`` and ``convert.page_json`` take them: bodies has name, page and body;
    tables has name, pos (page by page, then by number) and rows, of tables with any text."""
    tabled = table_cells(cells(lines, tolerance), least_cells)
    rows = table_rows(tabled, chars, tolerance)
    some: Column = F.exists(F.flatten("rows"), lambda c: c != "")
    return page_lines(chars, table_boxes(tabled), tolerance), rows.filter(some).select("name", F.struct("page", "table").alias("pos"), "rows")
