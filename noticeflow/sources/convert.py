"""Files into texts around extractors that are not part of this package, and sending of notices."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.text import normalize, strip
from noticeflow.operators.seams import with_model
from noticeflow.sources.files import document_records, last_id, route, tables_text, tally

TIMEOUT, SINGLE_TIMEOUT = 300, 120
PAGE_BREAK = "\n--- PAGE BREAK ---\n"


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name and content of each file."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def filter_command(command: list[str], timeout: int = TIMEOUT) -> Callable[[list[tuple]], list[bytes]]:
    """A call for ``converted``: each file goes through an external command by its standard input and output, within a time limit."""
    def call(rows: list[tuple]) -> list[bytes]:
        return [subprocess.run(command, input=content, capture_output=True, timeout=timeout, check=True).stdout for _, content in rows]
    return call


def converted(files: DataFrame, call: Callable, batch: int = 50) -> DataFrame:
    """name, content, error: word-processor files as what ``call(rows of (name, content))`` makes of them; other files as they are.
    A file that fails has an error and no content."""
    d = files.withColumn("_convert", route(F.col("name")) == "convert")
    d = with_model(d, ["name", "content"], "made", T.BinaryType(), call, where="_convert", batch=batch)
    failed = F.when(F.col("_convert") & F.col("made").isNull(), F.coalesce("made_error", F.lit("no output")))
    return d.select("name", F.when(F.col("_convert"), F.col("made")).otherwise(F.col("content")).alias("content"), failed.alias("error"))


def page_bodies(chars: DataFrame, boxes: DataFrame) -> DataFrame:
    """name, page, body from characters (name, page, pos, text, x0, x1, top, bottom) whose centre lies in none of the
    page's table boxes (name, page, x0, x1, top, bottom). A page has few boxes, so the join stays within it."""
    x, y = (F.col("c.x0") + F.col("c.x1")) / 2, (F.col("c.top") + F.col("c.bottom")) / 2
    within = (F.col("c.name") == F.col("b.name")) & (F.col("c.page") == F.col("b.page")) & x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.top"), F.col("b.bottom"))
    free = chars.alias("c").join(boxes.alias("b"), within, "left_anti")
    return free.groupBy("name", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda c: c["text"]), "").alias("body"))


def page_texts(bodies: DataFrame, tables: DataFrame) -> DataFrame:
    """name, text: pages (name, page, body) in order, then the tables (name, pos, rows: an array of rows of cells)."""
    pages = bodies.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda p: p["body"]).alias("pages"))
    found = tables.groupBy(F.col("name").alias("_n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rows"))), lambda t: t["rows"]).alias("tables"))
    j = pages.join(found, F.col("name") == F.col("_n"), "left")
    return j.select("name", tables_text(F.col("pages"), F.coalesce("tables", F.array().cast("array<array<array<string>>>"))).alias("text"))


def page_json(bodies: DataFrame, tables: DataFrame) -> DataFrame:
    """name, text (pages joined by a mark) and tables of each file, as a JSON sink takes them."""
    pages = bodies.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda p: F.coalesce(p["body"], F.lit(""))), PAGE_BREAK).alias("text"))
    found = tables.groupBy(F.col("name").alias("_n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rows"))), lambda t: t["rows"]).alias("tables"))
    return pages.join(found, F.col("name") == F.col("_n"), "left").select("name", "text", F.coalesce("tables", F.array().cast("array<array<array<string>>>")).alias("tables"))


def compare_texts(one: DataFrame, other: DataFrame) -> DataFrame:
    """name, n_one, n_other, difference: lengths of what two extractors (name, text) make of the same files; null where one has no row."""
    a = one.select("name", F.char_length("text").alias("n_one"))
    b = other.select("name", F.char_length("text").alias("n_other"))
    return a.join(b, "name", "full").withColumn("difference", F.abs(F.col("n_one") - F.col("n_other")))


def batch_convert(files: DataFrame, call: Callable, extract: Callable[[DataFrame], DataFrame], batch: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, failures, tally) of a folder: files are routed, word-processor files converted, ``extract`` (name, content -> name, text, error)
    reads what is a PDF then; text files are decoded. Blank texts count as failures."""
    usable = files.filter(route(F.col("name")) != "skip")
    made = converted(usable, call, batch)
    plain = route(F.col("name")) == "text"
    decoded = made.filter("error is null").filter(plain).select("name", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(None).cast("string").alias("error"))
    read = extract(made.filter("error is null").filter(~plain).select("name", "content"))
    every = decoded.unionByName(read).unionByName(made.filter("error is not null").select("name", F.lit(None).cast("string").alias("text"), "error"))
    every = every.withColumn("text", normalize(F.col("text"))).withColumn("error", F.coalesce("error", F.when(F.coalesce("text", F.lit("")) == "", "no text")))
    status = every.select("name", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"))
    return every.filter("error is null").select("name", "text"), every.filter("error is not null").select("name", "error"), tally(status)


def appended_records(files: DataFrame, source_type: str, known: DataFrame) -> DataFrame:
    """Records of new files, with ids that go on from the last one of a table of records."""
    return document_records(files, source_type, last_id(known, "id") + 1)


def send(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sent, refused) of requests (sender_id, teacher_id, parent_id, text): sent has notice_id, teacher_id, parent_id, text
    and char_count; refused has a status and a reason. Only teachers send, in their own name, to a known parent, and some text."""
    u = users.groupBy(F.col("user_id").alias("_u")).agg(F.max("role").alias("_role"))
    d = requests.select(F.struct("*").alias("row"), "sender_id", "teacher_id", "parent_id", "text")
    d = d.join(u.withColumnsRenamed({"_u": "_s", "_role": "sender_role"}), F.col("sender_id") == F.col("_s"), "left").drop("_s")
    d = d.join(u.withColumnsRenamed({"_u": "_p", "_role": "parent_role"}), F.col("parent_id") == F.col("_p"), "left").drop("_p")
    refused = (
        F.when(F.coalesce("sender_role", F.lit("")) != "teacher", F.struct(F.lit(403).alias("status"), F.lit("only teachers send").alias("reason")))
        .when(~F.col("sender_id").eqNullSafe(F.col("teacher_id")), F.struct(F.lit(403).alias("status"), F.lit("not in another teacher's name").alias("reason")))
        .when(F.coalesce("parent_role", F.lit("")) != "parent", F.struct(F.lit(404).alias("status"), F.lit("no such parent").alias("reason")))
        .when(strip(F.coalesce("text", F.lit(""))) == "", F.struct(F.lit(400).alias("status"), F.lit("no text").alias("reason")))
    )
    d = d.withColumn("refused", refused)
    notice_id = F.sha2(F.to_json(F.struct("teacher_id", "parent_id", "text")), 256)
    sent = d.filter("refused is null").select(notice_id.alias("notice_id"), "teacher_id", "parent_id", "text", F.char_length("text").alias("char_count"))
    return sent, d.filter("refused is not null").select("row.*", "refused.status", "refused.reason")
