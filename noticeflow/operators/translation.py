"""Translation of short sentences and whole notices around a translator's seam."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions import glossary as G
from noticeflow.functions.i18n import nllb_code
from noticeflow.functions.text import sentences_by_mark, strip
from noticeflow.operators.corpus import greedy_chunks, select_sentences
from noticeflow.operators.seams import with_model
from noticeflow.operators.token_budget import token_chunks

EASY = "ko_easy"


def translate_short(df: DataFrame, text: str, lang: str, glossary: list[tuple[str, str]], call: Callable, output: str = "translated", **more) -> DataFrame:
    """``df`` with the translation of a short text, and ``<output>_error``.

    100 characters at most go to ``call(rows of (text, language code))``, with
    links and phone numbers behind marks and glossary terms injected; of the
    answer in Vietnamese, dollars become won again where the source has won;
    then the marks are undone. Blank and null texts and failures give ''; easy
    Korean is the text itself, without a call.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    if lang == EASY:
        return df.withColumns({output: F.when(strip(source) == "", "").otherwise(source), f"{output}_error": F.lit(None).cast("string")})
    d = df.select(F.struct("*").alias("row"), strip(source).alias("short")).withColumn("prepared", G.translation_input(F.col("short"), G.literal(list(glossary))))
    d = d.select("row", F.substring("short", 1, 100).alias("short"), F.col("prepared.text").alias("asked"), F.col("prepared.kept").alias("kept"), nllb_code(F.lit(lang)).alias("code"), (F.col("short") != "").alias("wanted"))
    d = with_model(d, ["asked", "code"], "answer", T.StringType(), call, default="", where="wanted", **more)
    answer = G.currency_fixed(F.col("short"), F.col("answer")) if lang == "vi" else F.col("answer")
    done = d.select("row", F.struct(G.unmasked(answer, F.col("kept")).alias(output), F.col("answer_error").alias(f"{output}_error")).alias("new"))
    return done.select("row.*", "new.*")


def translate_chunks(df: DataFrame, key: str, text: str, lang: str, call: Callable, budget: int = 384, tokenizer: str | None = None, seconds: bool = False, **more) -> DataFrame:
    """key, n_chunks, translated: sentences in chunks within a budget, translated one by one and joined by line ends;
    with ``seconds`` also the time that the calls for a text's chunks took.

    The budget is of characters, or of the tokens of a vocabulary file if ``tokenizer`` names one (``words`` for
    words). Chunks are rows, so that long texts spread over the workers. Texts without any sentence have no chunks and ''.
    """
    sentences = sentences_by_mark(F.col(text))
    if tokenizer:
        cut = token_chunks(df.select(F.col(key), sentences.alias("parts")), "parts", budget, None if tokenizer == "words" else tokenizer)
        chunks = F.transform("chunks", lambda c: c["text"])
    else:
        cut, chunks = df, greedy_chunks(sentences, budget)
    parts = cut.select(F.col(key), F.posexplode_outer(chunks).alias("pos", "chunk"))
    parts = parts.withColumns({"code": nllb_code(F.lit(lang)), "wanted": F.col("chunk").isNotNull()})
    done = with_model(parts, ["chunk", "code"], "answer", T.StringType(), call, default="", where="wanted", seconds=seconds, **more)
    answers = F.transform(F.array_sort(F.collect_list(F.when(F.col("wanted"), F.struct("pos", "answer")))), lambda x: x["answer"])
    took = [F.sum("answer_seconds").alias("seconds")] if seconds else []
    return done.groupBy(key).agg(F.count("pos").alias("n_chunks"), F.array_join(answers, "\n").alias("translated"), *took)


def translate_and_review(df: DataFrame, text: str, lang: str, glossary: list[tuple[str, str]], call: Callable, **more) -> DataFrame:
    """``df`` with easy_ko_text, translation, target_language, vi_text, quality_note and review_needed (the deprecated one-text form).

    Five sentences at most are kept. Easy Korean is not translated or checked.
    Blank texts have '' everywhere; a translator's failure counts as ''.
    """
    from noticeflow.plans.offline import easy_text

    source = F.coalesce(F.col(text), F.lit(""))
    d = df.select(F.struct("*").alias("row"), strip(source).alias("original_text"), F.lit("").alias("easy_ko_text"), F.lit("").alias("easy_korean"))
    none = F.array().cast("array<string>")
    d = d.select("row", F.array_join(select_sentences(sentences_by_mark(easy_text(d)), none, 5), "\n").alias("easy"))
    d = d.withColumns({"code": nllb_code(F.lit(lang)), "wanted": (F.col("easy") != "") & F.lit(lang != EASY)})
    d = with_model(d, ["easy", "code"], "answer", T.StringType(), call, default="", where="wanted", **more)
    answer = G.currency_fixed(F.col("easy"), F.col("answer")) if lang == "vi" else F.col("answer")
    found = G.hits(F.col("easy"), G.literal([] if lang == EASY else list(glossary)))
    d = d.withColumn("translation", answer).withColumn("checked", G.roll_up(G.checks(F.col("easy"), F.col("translation"), found)))
    blank = F.col("easy") == ""
    label, note = F.col("checked.label"), F.col("checked.note")
    new = F.struct(
        F.col("easy").alias("easy_ko_text"), "translation", F.lit(lang).alias("target_language"), (F.col("translation") if lang == "vi" else F.lit("")).alias("vi_text"),
        F.when(blank, "").when(note != "", note).otherwise(F.concat(F.lit("ok ("), label, F.lit(")"))).alias("quality_note"),
        F.when(blank, "").when(label == "review_needed", note).otherwise("").alias("review_needed"),
    )
    return d.select("row", new.alias("new")).select("row.*", "new.*")
