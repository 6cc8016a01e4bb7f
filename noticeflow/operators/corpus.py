"""Corpus preparation: union, dedup, splits, distributions, label propagation, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.functions import patterns as P
from noticeflow.functions import rules
from noticeflow.functions.text import clauses, first_nonempty


def canonical_text(df: DataFrame, candidates=("text", "original_text", "sentence")) -> DataFrame:
    """The first of the candidate columns that is there, as text."""
    name = next((c for c in candidates if c in df.columns), None)
    if name is None:
        raise ValueError(f"none of {candidates} in {df.columns}")
    return df if name == "text" else df.withColumnRenamed(name, "text")


def defaults(df: DataFrame, columns: list[str]) -> DataFrame:
    """Named columns with '' for null and for columns that are not there; easy_ko_text falls back
    on easy_korean, original_text on easy_ko_text."""
    get = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    easy = first_nonempty(get("easy_ko_text"), get("easy_korean"))
    special = {"easy_ko_text": easy, "original_text": first_nonempty(get("original_text"), easy)}
    return df.withColumns({c: special.get(c, get(c)) for c in columns})


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an explicit order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.select(F.struct("*").alias("row"), place.alias("place")).filter("place = 1").select("row.*")


def labelled(df: DataFrame, domain: list[str] = P.CATEGORIES) -> DataFrame:
    """Rows with a text and a category of the domain."""
    return df.dropna(subset=["text", "category"]).filter(F.col("category").isin(*domain))


def select_split(df: DataFrame, split: str) -> DataFrame:
    return df if split == "all" else df.filter(F.col("split") == split)


def stratified_split(df: DataFrame, group: str, *order: Column, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Adds split: the first rows of each group train, the next val, the rest test; at least one row
    each of train and val. Sizes round half to even.

    Rows are range-partitioned by group and order, so a group of any size
    spreads over many tasks; a row's place in its group is its place in its
    partition plus what the partitions before it hold of the group.
    """
    from noticeflow.runtime import maybe_broadcast, staged

    keys = {f"_o{i}": c for i, c in enumerate(order)}
    d = df.select(F.struct("*").alias("row"), F.col(group).alias("_g"), *(c.alias(k) for k, c in keys.items()))
    ranged = staged(d.repartitionByRange("_g", *keys).sortWithinPartitions("_g", *keys).select("row", "_g", F.monotonically_increasing_id().alias("_id")), "split")
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(F.col("_g").alias("_h"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_id").alias("_first"))
    by = W.partitionBy("_h")
    before = F.coalesce(F.sum("_c").over(by.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = counts.select("_h", "_part", "_first", before.alias("_before"), F.sum("_c").over(by).alias("_n"))
    j = ranged.withColumn("_p", part).join(maybe_broadcast(staged(sizes, "sizes")), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_p") == F.col("_part")))
    place = F.col("_before") + F.col("_id") - F.col("_first") + 1
    a = F.greatest(F.lit(1), F.bround(F.col("_n") * train).cast("long"))
    b = F.greatest(F.lit(1), F.bround(F.col("_n") * val).cast("long"))
    return j.select("row.*", F.when(place <= a, "train").when(place <= a + b, "val").otherwise("test").alias("split"))


def distribution(df: DataFrame, key: str) -> DataFrame:
    """key, n, pct: counts of the non-empty values and their share in percent. The total comes from the
    counts, which are one row per value."""
    counts = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") * 100.0 / F.col("_total")).alias("pct"))


def imbalance(df: DataFrame, key: str) -> DataFrame:
    return distribution(df, key).agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), (F.max("n") / F.min("n")).alias("ratio"))


def _group(by: tuple[str, ...]) -> Column:
    return F.struct(*by) if by else F.lit(1)


def medians(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """g (a struct of ``by``; 1 without any) and median of a value in each group, exactly; the mean of the two middle
    ones of an even number. Nulls do not count.

    Equal values are counted together and the counts range-partitioned by group and value. What a partition holds of
    a group tells which partition has its middle, and a running sum within the partition which value it is, so
    no task has a buffer of a group's values.
    """
    from noticeflow.runtime import staged

    counts = df.select(_group(by).alias("g"), value.alias("v")).filter("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    ranged = staged(counts.repartitionByRange("g", "v").select("g", "v", "c", F.spark_partition_id().alias("part")), "values")
    w = W.partitionBy("g")
    held = ranged.groupBy("g", "part").agg(F.sum("c").alias("c"), F.min("v").alias("least"))  # a row per group and partition
    before = F.coalesce(F.sum("c").over(w.orderBy("least").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select("g", "part", before.alias("before"), F.col("c").alias("held"), F.sum("c").over(w).alias("n"))
    lo, hi = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    near = held.filter((F.col("before") < hi) & (F.col("before") + F.col("held") >= lo))
    j = ranged.join(near, ["g", "part"])
    upto = F.col("before") + F.sum("c").over(W.partitionBy("g", "part").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    j = j.withColumn("upto", upto)
    has = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("c") < k)
    return j.groupBy("g").agg(((F.max(F.when(has(lo), F.col("v"))) + F.max(F.when(has(hi), F.col("v")))) / 2).alias("median"))


def length_stats(df: DataFrame, length: Column, *by: str) -> DataFrame:
    """n, least, most, mean, median (truncated) and stdev (0 for one row)."""
    v = F.col("v")
    agg = [F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev")]
    one = df.select(_group(by).alias("own"), length.alias("v")).groupBy("own").agg(*agg)
    j = one.join(medians(df, length, *by), F.col("own").eqNullSafe(F.col("g")), "left")
    return j.select(*(F.col(f"own.`{b}`").alias(b) for b in by), "n", "least", "most", "mean", F.col("median").cast("long").alias("median"), "stdev")


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, filled, empty for each column, from one pass."""
    one = df.agg(*(F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias(c) for c in columns), F.count(F.lit(1)).alias("_n"))
    return one.unpivot(["_n"], columns, "column_name", "filled").select("column_name", "filled", (F.col("_n") - F.col("filled")).alias("empty"))


def contingency(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight n / (k * n_c), from the class counts: a row per class, broadcast."""
    counts = df.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    w = counts.crossJoin(F.broadcast(total)).select("l", (F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))
    j = df.select(F.struct("*").alias("row"), F.col(label).alias("own")).join(F.broadcast(w), F.col("own") == F.col("l"))
    return j.select("row.*", "weight")


def placed(df: DataFrame, order: list[tuple[Column, bool]], name: str, start: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in an order of (column, whether from the greatest down), from ``start``.

    Rows are range-partitioned; counts per partition give each its first number, so no task holds all rows.
    """
    from noticeflow.runtime import staged

    names = [f"by{i}" for i in range(len(order))]
    d = df.select(F.struct("*").alias("row"), *(c.alias(n) for (c, _), n in zip(order, names, strict=True)))
    by = [F.col(n).desc() if down else F.col(n) for (_, down), n in zip(order, names, strict=True)]
    ranged = staged(d.repartitionByRange(*by).sortWithinPartitions(*by).select("row", F.monotonically_increasing_id().alias("at")), "placed")
    part, within = F.shiftright("at", 33), F.expr("at & 8589934591")
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per partition
    j = ranged.withColumn("own", part).join(F.broadcast(before), F.col("own") == F.col("part"))
    return j.select(F.col("row").withField(f"`{name}`", F.col("before") + within + F.lit(start)).alias("row")).select("row.*")


def numbered(df: DataFrame, order: str, start: int = 1, keep: Column | None = None, name: str = "id", then: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive ids in the order of a column (nulls last, as in the SQL), among equals of the columns ``then``; rows that ``keep`` drops use up an id too."""
    out = placed(df, [(by, False) for c in (order, *then) for by in (F.col(c).isNull(), F.col(c))], name, start)
    return out.filter(keep) if keep is not None else out


def aggregate_sentences(df: DataFrame, group: str) -> DataFrame:
    """group, category, keywords, importance from labelled sentences (pos, sentence, is_todo, category): of the
    to-dos the categories in order, up to five starts of important sentences, and the highest importance."""
    cat = F.coalesce(F.nullif("category", F.lit("")), rules.category(F.col("sentence")))
    rows = df.withColumn("_c", cat).withColumn("_i", rules.importance(F.col("sentence"), F.col("_c")))
    item = F.when(F.col("is_todo"), F.struct("pos", F.col("_c").alias("c"), F.col("_i").alias("i"), F.substring("sentence", 1, 60).alias("s")))
    got = rows.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("_t"))
    return got.select(group, *summary(F.col("_t")))


def summary(items: Column) -> list[Column]:
    """category, keywords, importance of ordered (pos, c, i, s) items; '' without any."""
    cats = F.array_join(F.array_distinct(F.transform(items, lambda x: x["c"])), ", ")
    words = F.array_join(F.slice(F.transform(F.filter(items, lambda x: x["i"] >= 0.70), lambda x: x["s"]), 1, 5), " / ")
    top = F.coalesce(F.array_max(F.transform(items, lambda x: x["i"])).cast("string"), F.lit(""))
    return [cats.alias("category"), words.alias("keywords"), top.alias("importance")]


def rule_summary(text: Column) -> Column:
    """Items of a raw text by rules: sentences that are no greeting and reach an importance of 0.65."""
    parts = F.filter(clauses(text), lambda s: ~rules.is_greeting(s))
    items = F.transform(parts, lambda s, i: F.struct(i.alias("pos"), rules.category(s).alias("c"), rules.importance(s, rules.category(s)).alias("i"), F.substring(s, 1, 60).alias("s")))
    return F.filter(items, lambda x: x["i"] >= 0.65)


def fill_originals(originals: DataFrame, sentences: DataFrame) -> DataFrame:
    """id, original_text, category, keywords, importance, origin: from labelled sentences where they give
    any, else from rules (as a fallback, where there were labelled rows)."""
    agg = aggregate_sentences(sentences, "original_id").select(F.col("original_id").alias("_o"), F.col("category").alias("_c"), F.col("keywords").alias("_k"), F.col("importance").alias("_i"))
    j = originals.join(agg, F.col("id") == F.col("_o"), "left").withColumn("_items", rule_summary(F.col("original_text")))
    c, k, i = summary(F.col("_items"))
    own = F.coalesce(F.col("_c"), F.lit("")) != ""
    return j.select("id", "original_text", F.when(own, F.col("_c")).otherwise(c).alias("category"), F.when(own, F.col("_k")).otherwise(k).alias("keywords"), F.when(own, F.col("_i")).otherwise(i).alias("importance"), F.when(own, "labelled").when(F.col("_o").isNotNull(), "fallback").otherwise("rule").alias("origin"))


def filled_from(df: DataFrame, labels: DataFrame, key: str, column: str, rule: Column) -> DataFrame:
    """Adds a column from labels (key, column), else from a rule, and origin: labelled or rule. Of repeated labels of a key the greatest counts."""
    own = labels.groupBy(F.col(key).alias("k")).agg(F.max(column).alias("v"))
    j = df.select(F.struct("*").alias("row"), F.col(key).alias("key"), rule.alias("rule")).join(own, F.col("key") == F.col("k"), "left")
    new = F.col("row").withField(f"`{column}`", F.coalesce("v", "rule")).withField("origin", F.when(F.col("v").isNotNull(), "labelled").otherwise("rule"))
    return j.select(new.alias("row")).select("row.*")


def last_of_each(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and the value of its last row in an order: a lookup in which later rows win."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def inbox(notices: DataFrame, parent_id) -> DataFrame:
    return notices.filter(F.col("parent_id") == parent_id)


def without(notices: DataFrame, parent_id) -> tuple[DataFrame, DataFrame]:
    """(what stays, number of deleted rows)."""
    gone = F.coalesce(F.col("parent_id") == parent_id, F.lit(False))
    return notices.filter(~gone), notices.filter(gone).agg(F.count(F.lit(1)).alias("deleted"))


def allowed(notices: DataFrame, users: DataFrame, role: str) -> DataFrame:
    """Notices whose parent is a known user of a role."""
    return notices.join(users.filter(F.col("role") == role).select(F.col("user_id").alias("parent_id")), "parent_id", "left_semi")


def last_rows(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row of each key: the last in the order of a column, among equals (or without an order) the greatest row."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    by = row if order is None else F.struct(F.col(order).alias("order"), row.alias("row"))
    names = [f"k{i}" for i in range(len(keys))]
    best = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), by.alias("best")).groupBy(*names).agg(F.max("best").alias("best"))
    return best.select("best.*" if order is None else "best.row.*")


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``table`` whose key has no change, and of the changes the last of each key; see ``last_rows``."""
    return table.join(changes.select(key), key, "left_anti").unionByName(last_rows(changes, [key], order))


def seed(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet are added."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def greedy_chunks(parts: Column, budget: int, size=F.char_length) -> Column:
    """Parts joined by blanks while they fit the budget; a part over it stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    def step(acc, s):
        longer = F.when(acc["now"] == "", s).otherwise(F.concat(acc["now"], F.lit(" "), s))
        full = (acc["now"] != "") & (size(longer) > budget)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(longer).alias("now"))
    def finish(acc):
        return F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
    return F.aggregate(parts, start, step, finish)


def select_sentences(parts: Column, terms: Column, most: int = 5) -> Column:
    """Up to ``most`` sentences, those with a term first, in their old order."""
    has = lambda s: F.exists(terms, lambda t: s.contains(t))
    at = F.transform(parts, lambda s, i: F.struct(F.when(has(s), 0).otherwise(1).alias("k"), i.alias("i"), s.alias("s")))
    chosen = F.slice(F.array_sort(at), 1, most)
    return F.transform(F.array_sort(F.transform(chosen, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])




def fill_blank(df: DataFrame, suggestions: DataFrame, key: str, column: str) -> DataFrame:
    """Blank cells of a column from a table of suggestions (key, suggestion); filled cells stay. Of repeated suggestions the greatest counts."""
    from noticeflow.functions.text import strip

    s = suggestions.groupBy(F.col(key).alias("k")).agg(F.max("suggestion").alias("s"))
    j = df.select(F.struct("*").alias("row"), F.col(key).alias("key")).join(s, F.col("key") == F.col("k"), "left")
    own = F.when(strip(F.coalesce(F.col(f"row.{column}"), F.lit(""))) == "", F.coalesce("s", F.lit(""))).otherwise(F.col(f"row.{column}"))
    return j.select(F.col("row").withField(f"`{column}`", own).alias("row")).select("row.*")
