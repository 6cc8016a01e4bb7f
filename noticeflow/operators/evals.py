"""Evaluation: confusion matrices, scores, sweeps, comparisons and glossary reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """A row per true label of the list, a column per predicted one, in the list's order."""
    grid = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], f"_pos int, {true} {df.schema[true].dataType.simpleString()}")
    counts = df.groupBy(true).pivot(pred, labels).count()
    return F.broadcast(grid).join(counts, true, "left").na.fill(0, [str(x) for x in labels]).drop("_pos")


def per_class(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """label, precision, recall, f1, support for each label; 0 where a denominator is 0. One aggregation
    gives all counts; it has three numbers per label."""
    t, p = F.col(true), F.col(pred)
    one = df.agg(*(F.struct(F.count_if((t == x) & (p == x)).alias("tp"), F.count_if(p == x).alias("predicted"), F.count_if(t == x).alias("support")).alias(f"l{i}") for i, x in enumerate(labels)))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"l{i}.tp"), F.col(f"l{i}.predicted"), F.col(f"l{i}.support")) for i, x in enumerate(labels)))).alias("r")).select("r.*")
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return rows.select("label", precision.alias("precision"), recall.alias("recall"), ratio(precision * recall * 2, precision + recall).alias("f1"), "support")


def macro(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    return per_class(df, true, pred, labels).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def binary(df: DataFrame, true: str, pred: str) -> DataFrame:
    """accuracy and F1 of label 1."""
    t, p = F.col(true), F.col(pred)
    c = df.agg(F.count_if(t == p).alias("same"), F.count(F.lit(1)).alias("n"), F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if(p == 1).alias("pp"), F.count_if(t == 1).alias("pt"))
    return c.select(ratio(F.col("same"), F.col("n")).alias("accuracy"), ratio(F.col("tp") * 2, F.col("pp") + F.col("pt")).alias("f1"))


def sweep(df: DataFrame, true: str, score: str, thresholds: list[float]) -> DataFrame:
    """threshold, precision, recall, f1, n_predicted for each threshold, from one pass over the rows."""
    t, s = F.col(true) == 1, F.col(score)
    one = df.agg(F.count_if(t).alias("pos"), *(F.struct(F.count_if(t & (s >= x)).alias("tp"), F.count_if(s >= x).alias("n")).alias(f"t{i}") for i, x in enumerate(thresholds)))
    rows = one.select("pos", F.explode(F.array(*(F.struct(F.lit(float(x)).alias("threshold"), F.col(f"t{i}.tp"), F.col(f"t{i}.n")) for i, x in enumerate(thresholds)))).alias("r")).select("pos", "r.*")
    p, r = ratio(F.col("tp"), F.col("n")), ratio(F.col("tp"), F.col("pos"))
    return rows.select("threshold", p.alias("precision"), r.alias("recall"), ratio(p * r * 2, p + r).alias("f1"), F.col("n").alias("n_predicted"))


def best_threshold(df: DataFrame, true: str, score: str, thresholds: list[float]) -> DataFrame:
    """The threshold of the highest F1, the lowest of equals."""
    return sweep(df, true, score, thresholds).agg(F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("t"))).alias("m")).select((-F.col("m.t")).alias("threshold"), F.col("m.f1").alias("f1"))


def worst_misses(df: DataFrame, true: str, score: str, threshold: float, key: str, n: int = 10) -> DataFrame:
    """The n false negatives of the least and the n false positives of the greatest confidence."""
    fn = df.filter((F.col(true) == 1) & (F.col(score) < threshold)).orderBy(F.col(score), key).limit(n).withColumn("kind", F.lit("fn"))
    fp = df.filter((F.col(true) == 0) & (F.col(score) >= threshold)).orderBy(F.col(score).desc(), key).limit(n).withColumn("kind", F.lit("fp"))
    return fn.unionByName(fp)


def adopt(candidate: Column, baseline: Column, least: float = 0.05) -> Column:
    return F.when(candidate - baseline >= least, "adopt").otherwise("keep")


def clamp(score: Column, most: int) -> Column:
    """A score as a whole number from 0 to ``most``; what is no number is 0. Halves go to the even number."""
    return F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(F.bround(score.try_cast("double")).try_cast("int"), F.lit(0))))


def fenced_json(text: Column, schema: str) -> Column:
    """The JSON object of a model's answer, with or without a code fence; null if there is none."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.+\}", 0), F.lit("")), schema, {"mode": "PERMISSIVE"})


def turns_text(df: DataFrame, key: str, pos: str, text: str, only: Column) -> DataFrame:
    """key, full_text, part_text: all texts of a key in order, and those for which ``only`` holds."""
    def joined(cond: Column | None) -> Column:
        item = F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(item if cond is None else F.when(cond, item))), lambda x: x["t"]), " ")
    return df.groupBy(key).agg(joined(None).alias("full_text"), joined(only).alias("part_text"))


def reduction(full: Column, part: Column) -> Column:
    """Percent by which the part is shorter; 0 for an empty whole."""
    return F.when(full == 0, 0.0).otherwise((1 - part / full) * 100)


def verdict(delta: Column, margin: float = 5.0) -> Column:
    return F.when(delta > margin, "B better").when(delta < -margin, "A better").otherwise("tie")


def two_level_mean(df: DataFrame, group: str, before: str, after: str, digits: int = 1) -> DataFrame:
    """Per group the rounded means and their difference, and a row '전체' of the means of the rounded means.
    Rounding is in decimals. The groups are aggregated once; the last row comes from them."""
    each = df.groupBy(F.col(group).cast("string").alias("grp")).agg(*(F.round(F.avg(F.col(c).cast("decimal(20,4)")), digits).alias(n) for c, n in ((before, "before"), (after, "after"))))
    all_ = each.agg(F.lit("전체").alias("grp"), F.round(F.avg("before"), digits).alias("before"), F.round(F.avg("after"), digits).alias("after"))
    return each.unionByName(all_).withColumn("delta", F.col("after") - F.col("before"))


def reflection(df: DataFrame, lang: str, preferred: str, reflected: Column) -> DataFrame:
    """Per language the number of rows with a preferred term, of those reflected, and the rate in percent (null without any)."""
    has = F.coalesce(F.col(preferred), F.lit("")) != ""
    g = df.groupBy(lang).agg(F.count_if(has).alias("n_terms"), F.count_if(has & reflected).alias("n_reflected"))
    return g.withColumn("rate", F.when(F.col("n_terms") > 0, F.col("n_reflected") * 100.0 / F.col("n_terms")))


def suggestion_status(preferred: Column, suggestion: Column) -> Column:
    from noticeflow.functions.glossary import fuzzy_match

    return F.when(F.coalesce(suggestion, F.lit("")) == "", "no_response").when(fuzzy_match(preferred, suggestion), "match").otherwise("mismatch")
