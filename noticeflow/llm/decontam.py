"""Benchmark decontamination by winnowing.

The fingerprints of a text are the least hashes of its 5-word grams in each
run of six grams, so any 10 consecutive words that a document shares with an
item leave a fingerprint in both. Documents whose fingerprints meet those of
the benchmark are read again: their windows of 10 words are looked up among
the distinct windows of the items by a 128-bit hash of the words, and
overlapping hits extend to spans. Items of fewer than 10 words are one window
of their own length. An item's repeated windows are one row and a document
asks once for each place, so texts of repeated words cost no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import ascii_lower, documents, hash_pair, packed, unpacked
from noticeflow.runtime import maybe_broadcast, release, staged

GRAM, WINDOW = 5, 10
WINDOW_ARRAY = "array<struct<at:int,k:int,a:bigint,b:bigint>>"


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and code points above 0x7F, A-Z lower-cased."""
    parts = F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def _upto(n: Column) -> Column:
    """[0 .. n - 1], empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _gram(k: int):
    """Of a place: the hash of k words from there. The size keeps ``_wh`` referenced
    more than once, so that the planner does not compute it anew for each place."""
    return lambda i: F.xxhash64(F.lit(k), *(F.get("_wh", i + j) for j in range(k)), F.size("_wh") * 0)


def with_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds g<k> for each length: hashes of all k-word grams, in order of place."""
    df = df.withColumn("_wh", F.transform("words", lambda w: F.xxhash64(w)))
    for k in lengths:
        df = df.withColumn(f"g{k}", F.transform(_upto(F.size("_wh") - (k - 1)), _gram(k)))
    return df.drop("_wh")


def _winnowed(grams: str, run: int) -> Column:
    """Distinct least values of each run of grams."""
    least = lambda i: F.least(*(F.get(grams, i + j) for j in range(run)))
    return F.array_distinct(F.transform(_upto(F.size(grams) - (run - 1)), least))


def fingerprints(short: list[int]) -> Column:
    """Of a row that has grams: winnowed 5-word grams and all grams of the short items' lengths."""
    long = _winnowed(f"g{GRAM}", WINDOW - GRAM + 1)
    every = [F.array_distinct(f"s{k}") for k in short]
    return F.array_union(long, F.array_distinct(F.concat(*every))) if every else long


def _grams(df: DataFrame, short: list[int]) -> DataFrame:
    """g5 for windows of 10 words; s<k> for items of k words, hashed apart from g5."""
    df = with_grams(df, sorted({GRAM, *short}))
    for k in short:
        df = df.withColumn(f"s{k}", F.transform(f"g{k}", lambda h: F.xxhash64(h, F.lit("short"))))
    return df.drop(*(f"g{k}" for k in short if k != GRAM))


def _window_structs(k: int) -> Column:
    """(at, k, a, b) of each window of k words: its place and a 128-bit hash of its words."""
    def window(i: Column) -> Column:
        a, b = hash_pair(F.array_join(F.slice("words", i + 1, k), " "))
        return F.struct(i.alias("at"), F.lit(k).alias("k"), a.alias("a"), b.alias("b"))
    return F.transform(_upto(F.size("words") - (k - 1)), window)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (id as text; null as 'null') and words of items with any word."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.coalesce("text", F.lit(""))).alias("words"))
    return items.filter(F.size("words") > 0)


def item_windows(items: DataFrame, short: list[int]) -> tuple[DataFrame, DataFrame]:
    """(windows, sets): k, a, b, set of each distinct window of the items, and the items of each set.

    Windows that occur in the same items share a set, so a passage that many
    items hold costs a document one set, not one row per window and item.
    """
    n = F.size("words")
    each = F.concat(F.when(n >= WINDOW, _window_structs(WINDOW)).otherwise(F.array().cast(WINDOW_ARRAY)), *(F.when(n == k, _window_structs(k)).otherwise(F.array().cast(WINDOW_ARRAY)) for k in short))
    rows = items.select("item", F.explode(F.array_distinct(F.transform(each, lambda w: F.struct(w["k"], w["a"], w["b"])))).alias("w")).select("item", "w.*").distinct()
    grouped = staged(rows.groupBy("k", "a", "b").agg(F.array_sort(F.collect_list("item")).alias("items")).withColumn("set", F.sha2(F.to_json("items"), 256)), "windows")
    sets = staged(grouped.select("set", "items").dropDuplicates(["set"]), "item_sets")
    return grouped.select("k", "a", "b", "set"), sets


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, n_words, spans (word places [start, end) that occur in the benchmark, by start and apart from
    each other), items (ids as text, sorted); a row for each row of ``docs``, with null spans and items where there are none."""
    items = staged(benchmark_items(benchmark), "items")
    short = sorted(r[0] for r in items.select(F.size("words").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())  # nine numbers at most
    windows, sets = item_windows(items, short)
    n = F.size("words")
    item_fps = _grams(items, short).select(
        F.explode(F.concat(
            F.when(n >= WINDOW, _winnowed(f"g{GRAM}", WINDOW - GRAM + 1)).otherwise(F.array().cast("array<bigint>")),
            *(F.when(n == k, F.col(f"s{k}")).otherwise(F.array().cast("array<bigint>")) for k in short),
        )).alias("fp"))
    item_fps = staged(item_fps.distinct(), "item_fps")

    base = documents(docs).withColumn("th", F.xxhash64("text"))
    first = _grams(base.withColumn("words", words(F.col("text"))), short)
    prints = staged(first.select("doc_id", "th", F.size("words").cast("long").alias("n_words"), fingerprints(short).alias("fps")), "prints")
    met = prints.select("doc_id", "th", F.explode("fps").alias("fp")).join(maybe_broadcast(item_fps), "fp", "left_semi")
    met = staged(met.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "met")

    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    again = base.join(maybe_broadcast(met), same, "left_semi").select("doc_id", "th", words(F.col("text")).alias("words"))
    at = again.select("doc_id", "th", F.explode(F.concat(*map(_window_structs, [WINDOW, *short]))).alias("w")).select("doc_id", "th", "w.*")
    found = at.join(maybe_broadcast(windows), ["k", "a", "b"])
    found = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "k")).alias("places"), F.collect_set("set").alias("sets"))
    covers = F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["k"] - 1)))
    # staged, so that the places stand in an array that lambdas look up and do not compute anew
    found = staged(found.select("doc_id", "th", "sets", F.array_sort(F.array_distinct(covers)).alias("hit")), "found")
    named = found.select("doc_id", "th", F.explode("sets").alias("set")).join(maybe_broadcast(sets), "set").select("doc_id", "th", F.explode("items").alias("item"))
    named = named.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = found.join(named, same).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), runs("hit").alias("spans"), "items")
    spans = staged(spans, "spans")
    out = prints.drop("fps").join(maybe_broadcast(spans), same, "left").drop("_id", "_th")
    release(items, item_fps, met, sets, found)
    return out


def runs(places: str) -> Column:
    """Spans [start, end) of a column's places, in order and each once: places that follow each other are one span."""
    starts = F.filter(places, lambda p, i: F.coalesce(F.get(places, i - 1) < p - 1, F.lit(True)))
    ends = F.filter(places, lambda p, i: F.coalesce(F.get(places, i + 1) > p + 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))


def covered(spans: Column) -> Column:
    """Number of places within spans that are apart from each other."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    Null texts have no words. Items that share an item_id are one item, those
    without an id too. Rows that repeat a doc_id have a result each. An empty
    benchmark hits nothing; an empty table gives an empty result. Extra
    columns are ignored. Items without an item_id are named 'null'.
    """
    h = hits(docs, benchmark)
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return h.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no window of the benchmark occurs, with all their columns as they are, whatever their names.

    Null and empty texts stay; of rows that repeat a doc_id each goes by its
    own text. An empty table or benchmark drops nothing.
    """
    bad = hits(docs, benchmark).filter(F.size("spans") > 0).select("doc_id", "th").distinct()
    bad = maybe_broadcast(staged(bad, "contaminated").withColumnsRenamed({"doc_id": "_id", "th": "_th"}))
    d = packed(docs).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    return unpacked(d.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_anti"))
