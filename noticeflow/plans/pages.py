"""Queries over pages made of parts: a page has twelve parts in a ruled table of four columns with a wide
heading, every fourth row with a cell over two columns; even pages have a second table beside it; every
third page has a framed note. Lines and characters are what an extractor gives; the SQL answers from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.operators import page_tables
from noticeflow.plans.queries import query, table

COLUMNS, RIGHT, HEIGHT, CHAR = (20, 120, 260, 330, 420), (450, 500, 560), 16, 5
NAME = "'parts'"


def _layout(spark, sf_dir):
    """page, slot, and the words of each part's row. Positions jitter by less than the tolerance."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") / 12).cast("int").alias("page"), (F.col("p_partkey") % 12).cast("int").alias("slot"), "p_partkey", "p_brand", "p_type", "p_name", "p_size")
    return p.withColumn("y", 100.0 + HEIGHT * (F.col("slot") + 1))


def _line(x0, y0, x1, y1):
    values = {"x0": x0, "x1": x1, "top": y0, "bottom": y1}
    return F.struct(*((v if not isinstance(v, (int, float)) else F.lit(float(v))).cast("double").alias(k) for k, v in values.items()))


def page_lines(spark, sf_dir):
    """name, page, x0, x1, top, bottom."""
    d, y = _layout(spark, sf_dir), F.col("y")
    low, wide, head = y + HEIGHT, F.col("slot") % 4 == 3, F.col("slot") == 0
    own = [_line(COLUMNS[0], y + 0.4, COLUMNS[-1], y + 0.4), _line(COLUMNS[0], low - 0.4, COLUMNS[-1], low - 0.4)]
    own += [_line(x + 0.3, y, x + 0.3, low) for k, x in enumerate(COLUMNS) if k != 3]
    inner = F.when(~wide, _line(COLUMNS[3], y, COLUMNS[3], low))
    heading = [F.when(head, _line(COLUMNS[0], y - HEIGHT, COLUMNS[-1], y - HEIGHT)), *(F.when(head, _line(x, y - HEIGHT, x, y)) for x in (COLUMNS[0], COLUMNS[-1]))]
    beside = (F.col("page") % 2 == 0) & (F.col("slot") < 5)
    second = [F.when(beside, _line(RIGHT[0], v, RIGHT[-1], v)) for v in (y + 4, low + 4)] + [F.when(beside, _line(x, y + 4, x, low + 4)) for x in RIGHT]
    framed = head & (F.col("page") % 3 == 0)
    frame = [F.when(framed, x) for x in (_line(20, 50, 200, 50), _line(20, 70, 200, 70), _line(20, 50, 20, 70), _line(200, 50, 200, 70))]
    every = F.filter(F.array(*own, inner, *heading, *second, *frame), lambda x: x.isNotNull())
    return d.select(F.expr(NAME).alias("name"), "page", F.explode(every).alias("l")).select("name", "page", "l.*")


def _text(text, x, y):
    return F.struct(text.cast("string").alias("text"), F.lit(float(x)).alias("x"), y.cast("double").alias("y"))


def page_chars(spark, sf_dir):
    """name, page, pos, text, x0, x1, top, bottom: a row for each character, blanks too."""
    d, y = _layout(spark, sf_dir), F.col("y")
    head, wide = F.col("slot") == 0, F.col("slot") % 4 == 3
    texts = [
        F.when(head, _text(F.concat(F.lit("Parts of page "), F.col("page").cast("string")), 100, y - HEIGHT + 3)), _text(F.col("p_brand"), 23, y + 3), _text(F.col("p_type"), 123, y + 3), F.when(~wide, _text(F.col("p_size"), 333, y + 3)), _text(F.col("p_name"), 264, y + 3),
        F.when((F.col("page") % 2 == 0) & (F.col("slot") < 5), _text(F.col("p_size") * 10, 455, y + 7)), F.when((F.col("page") % 2 == 0) & (F.col("slot") < 5), _text(F.col("p_partkey"), 505, y + 7)),
        F.when(head, _text(F.concat(F.lit("List  "), F.col("page").cast("string")), 20, F.lit(20))), F.when(head, _text(F.lit("second line"), 20, F.lit(34))), F.when(head & (F.col("page") % 3 == 0), _text(F.lit("in a frame"), 25, F.lit(55))),
    ]
    t = d.select("page", F.posexplode(F.filter(F.array(*texts), lambda x: x.isNotNull())).alias("k", "t"), "slot")
    c = t.select("page", (F.col("slot") * 1000 + F.col("k") * 100).alias("from"), "t", F.posexplode(F.split("t.text", "")).alias("i", "text")).filter("text <> ''")
    x = F.col("t.x") + CHAR * 0.8 * F.col("i")
    return c.select(F.expr(NAME).alias("name"), "page", (F.col("from") + F.col("i")).alias("pos"), "text", x.alias("x0"), (x + CHAR * 0.7).alias("x1"), F.col("t.y").alias("top"), (F.col("t.y") + 8).alias("bottom"))


_PARTS = "p as (select p_partkey // 12 as page, p_partkey % 12 as slot, * from part)"
_SQUEEZED = "trim(regexp_replace({}, ' +', ' ', 'g'))"


@query(f"""with {_PARTS}, r as (
  select page, 1 as tab, -1 as slot, 'Parts of page ' || page || ' |  |  | ' as text from p where slot = 0
  union all select page, 1, slot, p_brand || ' | ' || {_SQUEEZED.format('p_type')} || ' | ' || {_SQUEEZED.format('p_name')} || ' | ' || case slot % 4 when 3 then '' else p_size::varchar end from p
  union all select page, 2, slot, (p_size * 10) || ' | ' || p_partkey from p where page % 2 = 0 and slot < 5)
  select page, tab as table_no, row_number() over (partition by page, tab order by slot) - 1 as row_no, text from r""")
def page_tables_rows(spark, sf_dir):
    """Rows of the tables that the lines of each page enclose."""
    chars, lines = page_chars(spark, sf_dir), page_lines(spark, sf_dir)
    rows = page_tables.table_rows(page_tables.table_cells(page_tables.cells(lines)), chars)
    each = rows.select("page", F.col("table").alias("table_no"), F.posexplode("rows").alias("row_no", "cells"))
    return each.select("page", "table_no", "row_no", F.array_join("cells", " | ").alias("text"))


@query(f"""with {_PARTS} select distinct page, 'List ' || page || chr(10) || 'second line' || case page % 3 when 0 then chr(10) || 'in a frame' else '' end as body from p""")
def page_tables_bodies(spark, sf_dir):
    """Lines of text outside the tables; a frame of one cell is no table."""
    bodies, _ = page_tables.read_pages(page_chars(spark, sf_dir), page_lines(spark, sf_dir))
    return bodies.select("page", "body")


# a durable inbox


@query("""with n as (select o_orderkey as notice_id, o_custkey as parent_id, o_totalprice as price from orders),
  left_ as (select n.* from n join customer on c_custkey = parent_id where c_mktsegment <> 'MACHINERY'),
  changed as (select notice_id, parent_id, case when notice_id % 5 = 0 then 2.0 else price end as price from left_ where true)
  select parent_id, count(*) as n, sum(case when notice_id % 5 = 0 then 1 else 0 end)::bigint as n_changed, round(sum(price), 2) as total from changed group by parent_id""")
def inbox_life(spark, sf_dir):
    """Notices are sent, receivers of one segment clear their inbox, some notices are changed twice and the last change stays."""
    import uuid

    from noticeflow.runtime import checkpoint_root
    from noticeflow.sources.inbox import Inbox

    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("notice_id"), F.col("o_custkey").alias("parent_id"), F.col("o_totalprice").alias("price"))
    customer = table(spark, sf_dir, "customer")
    box = Inbox(spark, f"{checkpoint_root(spark)}/inbox-{uuid.uuid4().hex}", n.schema, boxes=16)
    box.send(n.join(customer, F.col("c_custkey") == F.col("parent_id"), "left_semi"))
    box.clear(customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("parent_id")))
    changes = box.rows().filter("notice_id % 5 = 0")
    both = changes.withColumn("price", F.lit(3.0)).withColumn("seq", F.lit(1)).unionByName(changes.withColumn("price", F.lit(2.0)).withColumn("seq", F.lit(2)))
    box.change(both, "seq")
    return box.rows().groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("notice_id") % 5 == 0).alias("n_changed"), F.round(F.sum("price"), 2).alias("total"))
