"""Sources and sinks: text folders, JSON lines, CSV, uploads, Markdown reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions import rules
from noticeflow.functions.text import clean, flatten, join_broken_lines, normalize, sentences_of, strip
from noticeflow.operators.corpus import numbered

DOCUMENT = ["source_type", "category", "keywords", "importance", "action_required", "easy_korean", "vietnamese", "tts_target"]


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Headed CSV with or without a byte order mark, with quotes and line ends within quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a glossary that have a term."""
    return csv(spark, path).filter(strip(F.coalesce("korean", F.lit(""))) != "")


def pick(df: DataFrame, key: str, value=None, order: str | None = None) -> DataFrame:
    """The row of a key, or the first in an order; raises if there is none."""
    row = df.filter(F.col(key) == value).limit(1) if value is not None else df.orderBy(order or key).limit(1)
    if row.isEmpty():
        raise ValueError(f"no row with {key} = {value}")
    return row


def parsed_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines as line): JSON lines of a path; blank lines go; a path that is not there gives empty tables."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "line string")
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return parsed.filter(good).select("r.*").drop("_bad"), parsed.filter(~good).select(F.col("value").alias("line"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of ``parsed_lines``: the tolerant reading."""
    return parsed_lines(spark, path, schema)[0]


def required_json(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """JSON lines with their own columns; raises where one that is required is missing."""
    df = spark.read.json(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return df


def last_id(df: DataFrame, order: str, id_col: str = "id") -> int:
    """The id of the last row in an order, 0 without any."""
    row = df.agg(F.max_by(F.col(id_col), F.col(order))).first()
    return int(row[0] or 0)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """name, text of each file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))


def document_records(files: DataFrame, source_type: str, start: int = 1) -> DataFrame:
    """id, source_type, original_text and empty label columns; ids run by file name and blank files use one up."""
    rows = numbered(files, "name", start)
    out = rows.filter(strip(F.coalesce("text", F.lit(""))) != "")
    return out.select("id", F.lit(source_type).alias("source_type"), normalize(F.col("text")).alias("original_text"), *(F.lit("").alias(c) for c in DOCUMENT[1:]))


def one_line_records(files: DataFrame, source_type: str, start: int = 1) -> DataFrame:
    """As document_records, with all blanks of a text as one."""
    rows = numbered(files, "name", start)
    return rows.select("id", F.lit(source_type).alias("source_type"), flatten(F.coalesce("text", F.lit(""))).alias("original_text"))


def sentence_records(files: DataFrame, splitter: str = "notice") -> DataFrame:
    """text, is_todo (false, to be labelled) for each sentence, by a named splitter, of files that are no meal plan."""
    usable = files.filter(~rules.is_meal_plan(F.coalesce("text", F.lit(""))))
    parts = usable.select("name", F.posexplode(sentences_of(join_broken_lines(clean(F.col("text"))), splitter)).alias("pos", "sentence"))
    return parts.select("name", "pos", F.col("sentence").alias("text"), F.lit(False).alias("is_todo"))


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def route(name: Column) -> Column:
    """What becomes of a file: pdf, convert, text, or skip."""
    s = suffix(name)
    return F.when(s == "pdf", "pdf").when(s.isin("hwp", "hwpx"), "convert").when(s.isin("txt", "md", ""), "text").otherwise("skip")


def uploads(files: DataFrame, extract: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(name, text) of readable files and (name, error) of the others, from name and content.

    Text is decoded here, broken UTF-8 as U+FFFD. PDF and word-processor files
    go through ``extract`` (name, content -> name, text, error), where there is one.
    """
    f = files.withColumn("_route", F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "text").otherwise(route(F.col("name"))))
    text = f.filter("_route = 'text'").select("name", normalize(F.make_valid_utf8(F.coalesce(F.col("content").cast("string"), F.lit("")))).alias("text"))
    bad = f.filter("_route = 'skip'").select("name", F.concat(F.lit("unsupported file type: ."), suffix(F.col("name"))).alias("error"))
    rest = f.filter("_route in ('pdf', 'convert')")
    if extract is None:
        return text, bad.unionByName(rest.select("name", F.lit("no extractor for this file type").alias("error")))
    got = extract(rest.select("name", "content"))
    return text.unionByName(got.filter("error is null").select("name", normalize(F.col("text")).alias("text"))), bad.unionByName(got.filter("error is not null").select("name", "error"))


def tables_text(body_pages: Column, tables: Column) -> Column:
    """Pages, then tables row by row: cells stripped and joined by ' | ', rows of blank cells left out."""
    cell = lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = lambda t: F.filter(F.transform(t, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    blocks = F.filter(F.transform(tables, lambda t: F.array_join(F.transform(rows(t), lambda r: F.array_join(r, " | ")), "\n")), lambda b: b != "")
    pages = F.filter(body_pages, lambda p: F.coalesce(p, F.lit("")) != "")
    body = F.when(F.size(pages) > 0, F.array_join(pages, "\n\n"))
    return F.concat_ws("\n\n", body, F.when(F.size(blocks) > 0, F.concat(F.lit("[표]\n"), F.array_join(blocks, "\n\n"))))


def repaired_csv(lines: DataFrame) -> DataFrame:
    """pos, value, fixed: the text before the last comma of a line is quoted, unless it is already; the header
    (the least pos) and blank lines stay."""
    text, label = F.regexp_extract("value", r"^(.*),([^,]*)$", 1), F.regexp_extract("value", r"^(.*),([^,]*)$", 2)
    needs = F.col("value").rlike(r"^(.*),([^,]*)$") & text.contains(",") & ~(text.startswith('"') & text.endswith('"')) & (F.col("pos") > 0)
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('",'), label)
    return lines.select("pos", F.when(needs, quoted).otherwise(F.col("value")).alias("value"), needs.alias("fixed"))


def report_blocks(reports: DataFrame) -> DataFrame:
    """name and the first four fenced blocks of Markdown reports; reports with fewer go."""
    blocks = F.transform(F.regexp_extract_all("text", F.lit(r"(?sm)^```[^\n]*\n(.*?)^```"), F.lit(1)), strip)
    return reports.withColumn("_b", blocks).filter(F.size("_b") >= 4).select("name", *(F.col("_b")[i].alias(c) for i, c in enumerate(("full_ko", "full_translated", "todo_ko", "todo_translated"))))


def preferred_or_fallback(preferred: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    return preferred.unionByName(fallback.join(preferred.select(key), key, "left_anti"))


def tally(results: DataFrame, listed: int = 20) -> DataFrame:
    """status, n and the names of up to ``listed`` files, by name (a bounded report)."""
    from pyspark.sql import Window as W

    n = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    first = results.withColumn("_i", F.row_number().over(W.partitionBy("status").orderBy("name"))).filter(F.col("_i") <= listed)
    return n.join(first.groupBy("status").agg(F.array_sort(F.collect_list("name")).alias("names")), "status")


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Only the named fields, with a header."""
    df.select(*fields).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)
