"""Seams for models that are not part of this package: each takes a function over batches of texts and
makes it a column operation. A row that fails gets the seam's default and its error in a column."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from noticeflow.functions import rules
from noticeflow.runtime import held, map_arrow


@dataclass(frozen=True)
class Limits:
    """How a service with a quota is called.

    A refusal for too many calls waits as long as it says ("retry in 12.5s"), or else ``delay`` times the number
    of the attempt plus one; one that asks for more than ``longest`` seconds means that the quota is used up, and
    the task makes no more calls. A service that is not available is asked again after ``delay``. Any other error
    is final. ``per_second`` bounds the calls of all tasks together: the rows go to ``lanes`` tasks, each of which
    leaves as much time between its calls as keeps them all within the bound.
    """

    attempts: int = 3
    delay: float = 4.0
    longest: float = 90.0
    per_second: float | None = None
    lanes: int = 1


#: How services say that calls are too many, or that they are not available.
TOO_MANY, UNAVAILABLE, STATED_WAIT = r"429|RESOURCE_EXHAUSTED", r"503|UNAVAILABLE", r"retry in ([\d.]+)\s*s"


class Totals:
    """Rows that were asked about, rows that failed and seconds of calls, added up over all tasks of a seam. Tasks
    that run again, after a lost executor or for another action, count again."""

    def __init__(self, spark: SparkSession):
        count = spark.sparkContext.accumulator
        self.rows, self.failed, self.seconds = count(0), count(0), count(0.0)


class QuotaUsedUp(RuntimeError):
    """No more calls are made by this task."""


def limited(call: Callable[[], list], limits: Limits, sleep: Callable[[float], None] = time.sleep) -> list:
    """What ``call()`` gives within the limits' attempts and waits; raises its last error, or QuotaUsedUp."""
    for attempt in range(limits.attempts):
        try:
            return call()
        except Exception as e:  # noqa: BLE001, PERF203
            failure, said = e, f"{type(e).__name__}: {e}"
            if re.search(TOO_MANY, said):
                stated = re.search(STATED_WAIT, said)
                wait = float(stated[1]) if stated else limits.delay * (attempt + 2)
                if wait > limits.longest:
                    raise QuotaUsedUp(said) from e
            elif re.search(UNAVAILABLE, said):
                wait = limits.delay
            else:
                break
            if attempt + 1 < limits.attempts:
                sleep(wait)
    raise failure


def with_model(
    df: DataFrame, inputs: list[str], output: str, kind: T.DataType, call: Callable[[list[tuple]], list], default=None, load: Callable[[], object] | None = None,
    where: str | None = None, batch: int | None = None, retries: int = 0, wait: float = 0.0, key: str | None = None, seconds: bool = False, limits: Limits | None = None, totals: Totals | None = None,
) -> DataFrame:
    """``df`` with ``output``, what ``call(rows)`` (or ``call(model, rows)``) gives for the input columns, and ``<output>_error``.

    ``load`` runs once per task, or with a ``key`` once per worker process, whose tasks share what it gives. Calls
    get ``batch`` rows at most (a whole Arrow batch without it). A call that fails is tried again ``retries``
    times, after waits that double; then row by row. With ``limits`` it is tried as they say, and not row by row.
    Rows that still fail, and rows for which the boolean column ``where`` is not true, get the default; only the
    former have an error. ``kind`` may be an array or a struct. With ``seconds`` there is ``<output>_seconds``
    too: of the time that a call took, with all its attempts, each of its rows has an equal part; 0 without a call.
    ``totals`` are added to.
    """
    error, took = f"{output}_error", f"{output}_seconds"
    keep = df.drop(output, error, *([took] if seconds else []))
    more = [T.StructField(took, T.DoubleType())] if seconds else []
    schema = T.StructType([*keep.schema.fields, T.StructField(output, kind), T.StructField(error, T.StringType()), *more])
    arrow = to_arrow_type(kind)
    pause = limits.lanes / limits.per_second if limits and limits.per_second else 0.0
    if pause:
        keep = keep.repartition(limits.lanes)

    def run(batches):
        model = (held(key, load) if key else load()) if load else None
        next_call, used_up = 0.0, None

        def once(rows):
            nonlocal next_call
            if pause:
                time.sleep(max(0.0, next_call - time.monotonic()))
                next_call = time.monotonic() + pause
            out = list(call(model, rows) if load else call(rows))
            if len(out) != len(rows):
                raise ValueError(f"{len(out)} results for {len(rows)} rows")
            return out

        def tried(rows):
            for k in range(retries + 1):
                try:
                    return once(rows)
                except Exception as e:  # noqa: BLE001, PERF203 - whatever a model raises is the row's error
                    failure = e
                    if k < retries and wait:
                        time.sleep(wait * 2**k)
            raise failure

        def results(rows):
            """(result, error) of each row."""
            nonlocal used_up
            if used_up:
                return [(default, used_up)] * len(rows)
            try:
                return [(x, None) for x in (limited(lambda: once(rows), limits) if limits else tried(rows))]
            except Exception as e:  # noqa: BLE001
                said = f"{type(e).__name__}: {e}"
                if isinstance(e, QuotaUsedUp):
                    used_up = said
                if limits:
                    return [(default, said)] * len(rows)
            got = []
            for row in rows:
                try:
                    got.append((tried([row])[0], None))
                except Exception as e:  # noqa: BLE001, PERF203
                    got.append((default, f"{type(e).__name__}: {e}"))
            return got

        for b in batches:
            rows = list(zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in inputs), strict=True))
            out, errors, times = [default] * len(rows), [None] * len(rows), [0.0] * len(rows)
            wanted = range(len(rows)) if where is None else [i for i, x in enumerate(b.column(b.schema.names.index(where)).to_pylist()) if x]
            size = batch or max(1, len(rows))
            for a in range(0, len(wanted), size):
                own = wanted[a : a + size]
                start = time.perf_counter()
                got = results([rows[i] for i in own])
                each = (time.perf_counter() - start) / len(own)
                for i, (x, e) in zip(own, got, strict=True):
                    out[i], errors[i], times[i] = x, e, each
                if totals:
                    totals.rows.add(len(own))
                    totals.failed.add(sum(e is not None for _, e in got))
                    totals.seconds.add(each * len(own))
            new = [pa.array(out, arrow), pa.array(errors, pa.string()), *([pa.array(times, pa.float64())] if seconds else [])]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, output, error, *([took] if seconds else [])])

    return map_arrow(keep, run, schema)


def from_file(spark: SparkSession, path: str, load: Callable[[str], object]) -> Callable[[], object]:
    """A ``load`` for ``with_model`` that reads a model file which goes to every executor once, whatever folders they share."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: load(SparkFiles.get(name))


def checked(df: DataFrame, output: str, most: float = 0.1) -> DataFrame:
    """``df``, a table that is stored, if at most a share ``most`` of its rows failed; else raises."""
    n, bad = df.agg(F.count(F.lit(1)), F.count(f"{output}_error")).first()
    if n and bad > most * n:
        raise RuntimeError(f"{bad} of {n} rows of {output} failed")
    return df


def todo_probability(df: DataFrame, text: str, call, **more) -> DataFrame:
    return with_model(df, [text], "probability", T.DoubleType(), call, **more)


def gated_todos(df: DataFrame, text: str, call: Callable, threshold: float = 0.5, batch: int = 32, **more) -> DataFrame:
    """``df`` with probability (three digits), is_todo and probability_error of its sentences.

    Sentences that the cheap patterns reject are not asked about: they have probability 0 and are no to-dos, and
    so do those at which the model fails. ``call(rows of (sentence,))`` gives a probability each.
    """
    d = df.select(F.struct("*").alias("row"), F.col(text).alias("sentence"), (F.col(text).isNotNull() & ~rules.rejected(F.coalesce(F.col(text), F.lit("")))).alias("wanted"))
    d = with_model(d, ["sentence"], "probability", T.DoubleType(), call, default=0.0, where="wanted", batch=batch, **more)
    p = F.round(F.coalesce("probability", F.lit(0.0)), 3)
    new = F.struct(p.alias("probability"), (F.col("wanted") & (F.coalesce("probability", F.lit(0.0)) >= threshold)).alias("is_todo"), F.col("probability_error"))
    return d.select("row", new.alias("new")).select("row.*", "new.*")


def extracted_items(df: DataFrame, text: str, call, **more) -> DataFrame:
    """Lists of items that a model finds in a text; none where it fails."""
    return with_model(df, [text], "found", T.ArrayType(T.StringType()), call, default=[], **more)


def translate(df: DataFrame, text: str, lang: str, call, **more) -> DataFrame:
    return with_model(df, [text, lang], "translated", T.StringType(), call, default="", **more)


def judge(df: DataFrame, prompt: str, call, **more) -> DataFrame:
    """Raw answers of a judge, with three retries (or within ``limits``); see evals.fenced_json and evals.clamp for reading them."""
    return with_model(df, [prompt], "answer", T.StringType(), call, default="", **({"batch": 1} if "limits" in more else {"retries": 3, "wait": 1.0}) | more)
