"""Reports over labelled notices, models and translation runs, as tables; see ``markdown`` for their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import strip
from noticeflow.operators import corpus, evals


def frequencies(df: DataFrame, key: str, order: str) -> DataFrame:
    """rank, key, n, pct: the values of a column by their number, the most frequent first; equals as they come first in an order.

    The different values are aggregated first and ranked by ranges. Null and empty values go.
    """
    some = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    counts = some.groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    total = counts.agg(F.sum("n").alias("total"))
    ranked = corpus.placed(counts, [(F.col("n"), True), (F.col("first"), False)], "rank")
    return ranked.crossJoin(F.broadcast(total)).select("rank", F.col("value").alias(key), "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def labelled_summary(df: DataFrame) -> DataFrame:
    """One row of a table (notice_id, original_id, sentence, is_todo, category): rows, different notices (empty ids
    do not count), rows without original_id, to-dos, other rows, and the ratio of the largest category to the smallest."""
    one = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.coalesce(F.col("notice_id").cast("string"), F.lit("")) != "", F.col("notice_id"))).alias("n_notices"),
        F.count_if(F.col("original_id").isNull()).alias("n_without_original"), F.count_if("is_todo").alias("n_todo"), F.count_if(~F.coalesce("is_todo", F.lit(False))).alias("n_other"),
    )
    return one.crossJoin(F.broadcast(corpus.imbalance(df, "category").select(F.col("ratio").alias("imbalance"))))


def dataset_report(labelled: DataFrame, originals: DataFrame, glossary: DataFrame, order: str) -> dict[str, DataFrame]:
    """The tables of the report on the data: summary, to-do and category frequencies, lengths, sources, filled glossary cells."""
    preferred = [c for c in glossary.columns if c.startswith("preferred_")]
    return {
        "summary": labelled_summary(labelled), "is_todo": frequencies(labelled, "is_todo", order), "category": frequencies(labelled, "category", order),
        "lengths": corpus.length_stats(labelled, F.char_length(F.coalesce("sentence", F.lit("")))), "sources": frequencies(originals, "source_type", "id"),
        "original_lengths": corpus.length_stats(originals.filter(F.coalesce("original_text", F.lit("")) != ""), F.char_length("original_text")), "glossary": corpus.filled(glossary, preferred),
    }


def model_scores(df: DataFrame, true: str, predicted: str, labels: list, model: str = "model", digits: int = 4) -> DataFrame:
    """model, label, precision, recall, f1, support, rounded, for each model of a table of predictions. One aggregation gives all counts."""
    t, p = F.col(true), F.col(predicted)
    one = df.groupBy(model).agg(*(F.struct(F.count_if((t == x) & (p == x)).alias("tp"), F.count_if(p == x).alias("predicted"), F.count_if(t == x).alias("support")).alias(f"l{i}") for i, x in enumerate(labels)))
    rows = F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"l{i}.tp"), F.col(f"l{i}.predicted"), F.col(f"l{i}.support")) for i, x in enumerate(labels)))
    each = one.select(model, F.inline(rows))
    precision, recall = evals.ratio(F.col("tp"), F.col("predicted")), evals.ratio(F.col("tp"), F.col("support"))
    return each.select(model, "label", F.round(precision, digits).alias("precision"), F.round(recall, digits).alias("recall"), F.round(evals.ratio(precision * recall * 2, precision + recall), digits).alias("f1"), "support")


def compare_models(df: DataFrame, true: str, predicted: str, labels: list, baseline: str, model: str = "model", least: float = 0.05) -> DataFrame:
    """model, macro_precision, macro_recall, macro_f1, delta, decision: each model against a baseline, adopted if its
    macro F1 is better by ``least``. Means are of the unrounded scores; the baseline has no decision."""
    macro = model_scores(df, true, predicted, labels, model, 15).groupBy(model).agg(*(F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    base = macro.filter(F.col(model) == baseline).select(F.col("macro_f1").alias("_base"))
    out = macro.join(F.broadcast(base), F.lit(True), "left")
    delta = F.round(F.col("macro_f1") - F.col("_base"), 4)
    decision = F.when(F.col(model) != baseline, evals.adopt(F.col("macro_f1"), F.col("_base"), least))
    return out.select(model, "macro_precision", "macro_recall", "macro_f1", delta.alias("delta"), decision.alias("decision"))


def split_or_all(df: DataFrame, split: str) -> DataFrame:
    """The rows of a split, or all rows if there are none."""
    own = corpus.select_split(df, split)
    return df if own.isEmpty() else own


def run_costs(df: DataFrame) -> DataFrame:
    """Adds to rows (a_chars, b_chars, a_time, b_time) input_reduction_pct (one digit) and speedup_x (two digits; 0 without a time)."""
    reduction = F.round(evals.reduction(F.col("a_chars"), F.col("b_chars")), 1)
    return df.withColumns({"input_reduction_pct": reduction, "speedup_x": F.when(F.col("b_time") > 0, F.round(F.col("a_time") / F.col("b_time"), 2)).otherwise(0.0)})


def mean_costs(rows: DataFrame) -> DataFrame:
    """n and the means of the rounded figures of run_costs, rounded again."""
    d = lambda c: F.avg(F.col(c).cast("decimal(20,4)"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(d("input_reduction_pct"), 1).cast("double").alias("mean_reduction_pct"), F.round(d("speedup_x"), 2).cast("double").alias("mean_speedup_x"))


def ab_scores(rows: DataFrame) -> DataFrame:
    """notice_id, title (18 characters, then ...), a_score, b_score, delta, verdict of judged rows."""
    delta = F.col("b_score") - F.col("a_score")
    title = F.when(F.char_length("title") > 18, F.concat(F.substring("title", 1, 18), F.lit("..."))).otherwise(F.col("title"))
    return rows.select("notice_id", title.alias("title"), "a_score", "b_score", delta.alias("delta"), evals.verdict(delta).alias("verdict"))


def ab_means(rows: DataFrame) -> DataFrame:
    """mean_a, mean_b and their difference, to one digit; 0 without rows."""
    a, b = (F.coalesce(F.round(F.avg(F.col(c).cast("decimal(20,4)")), 1), F.lit(0).cast("decimal(20,1)")) for c in ("a_score", "b_score"))
    one = rows.agg(a.alias("mean_a"), b.alias("mean_b"))
    return one.select(F.col("mean_a").cast("double").alias("mean_a"), F.col("mean_b").cast("double").alias("mean_b"), (F.col("mean_b") - F.col("mean_a")).cast("double").alias("difference"))


def reflection_report(df: DataFrame, lang: str, preferred: str, reflected: Column) -> DataFrame:
    """evals.reflection with a last row '전체' over all languages, and the rate as it is shown: one digit and %, or — without terms."""
    each = evals.reflection(df, lang, preferred, reflected)
    all_ = each.agg(F.lit("전체").alias(lang), F.sum("n_terms").alias("n_terms"), F.sum("n_reflected").alias("n_reflected"))
    all_ = all_.withColumn("rate", F.when(F.col("n_terms") > 0, F.col("n_reflected") * 100.0 / F.col("n_terms")))
    return each.unionByName(all_).withColumn("shown", F.when(F.col("rate").isNull(), "—").otherwise(F.format_string("%.1f%%", "rate")))


def demo_cases(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Per glossary term one row of a text that has it, and its first sentence with it: the examples of a demo bundle."""
    from noticeflow.functions.glossary import sentence_with

    t = rows.select(F.struct("*").alias("row"), F.col(text).alias("body")).withColumn("term", F.explode(F.array(*map(F.lit, terms)))).filter(F.col("body").contains(F.col("term")))
    best = t.groupBy("term").agg(F.min(F.struct(F.char_length("body").alias("n"), "body", "row")).alias("b"))
    return best.select("term", sentence_with(F.col("b.body"), F.col("term")).alias("sentence"), strip(F.col("b.body")).alias("source"))
