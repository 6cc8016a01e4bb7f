"""Category model: character n-grams, sublinear TF-IDF and logistic regression, as an MLlib pipeline, and the choice between models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions import patterns as P
from noticeflow.functions.text import strip, word_ngrams
from noticeflow.operators.corpus import class_weights
from noticeflow.operators.seams import with_model
from noticeflow.runtime import map_arrow


class SublinearCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln(count) of each count of a vector, 0 of none. A batch of vectors is one array of counts, so a row costs no call of its own."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        source, target = self.getInputCol(), self.getOutputCol()
        keep = df.drop(target)

        def run(batches):
            for b in batches:
                v = b.column(b.schema.names.index(source))
                kind, size, indices, values = (v.field(k) for k in ("type", "size", "indices", "values"))
                counts = values.flatten().to_numpy(zero_copy_only=False)
                logs = np.zeros(len(counts))
                np.log(counts, out=logs, where=counts > 0)
                logs[counts > 0] += 1.0
                lengths = np.asarray(values.value_lengths().fill_null(0), np.int64)
                made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(logs))
                out = pa.StructArray.from_arrays([kind, size, indices, made], fields=list(v.type)[:3] + [pa.field("values", made.type)])
                yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, target])

        return map_arrow(keep, run, T.StructType([*keep.schema.fields, T.StructField(target, VectorUDT())]))


def with_grams(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("grams", word_ngrams(F.coalesce(F.col(text), F.lit(""))))


def train(df: DataFrame, vocabulary: int = 30_000, c: float = 1.0, iterations: int = 1000) -> PipelineModel:
    """Of text and category, with balanced class weights.

    A feature is (1 + ln count) times 1 + ln((1 + n) / (1 + n with it)), rows scaled to length 1. ``c`` weighs
    the summed loss of all rows against half the squared length of the coefficients.
    """
    rows = with_grams(class_weights(df.select("text", "category"), "category"))
    index = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows)
    terms = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=vocabulary).fit(rows)
    counted = terms.transform(index.transform(rows)).select("label", "weight", "tf")
    idf = IDF(inputCol="tf", outputCol="unused").fit(counted).idf.toArray() + 1.0
    features = [SublinearCounts(inputCol="tf", outputCol="logs"), ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="logs", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features")]
    ready = PipelineModel(features).transform(counted).select("label", "weight", "features").persist()
    fit = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / (c * ready.count()), maxIter=iterations, tol=1e-9, standardization=False, family="multinomial").fit(ready)
    ready.unpersist()
    return PipelineModel([index, terms, *features, fit, IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)])


def load_or_train(path: str, df: DataFrame, **more) -> PipelineModel:
    """The model stored at a place; if there is none, one is trained on ``df`` and stored there."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        train(df, **more).write().save(path)
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with predicted and confidence; blank texts get the last category at 0. Labels are not needed."""
    usable = PipelineModel([s for s in model.stages if s.__class__.__name__ != "StringIndexerModel"])
    out = usable.transform(with_grams(df))
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    top = F.array_max(vector_to_array("probability"))
    names = next(s for s in model.stages if isinstance(s, IndexToString)).getLabels()
    probs = F.map_from_arrays(F.array(*map(F.lit, names)), vector_to_array("probability"))
    out = out.withColumns({"confidence": F.when(blank, 0.0).otherwise(top), "predicted": F.when(blank, P.OTHER).otherwise(F.col("predicted")), "probs": probs})
    return out.drop("grams", "tf", "logs", "tfidf", "features", "rawPrediction", "probability", "prediction")


def top_classes(probs, n: int = 3):
    """The n classes of the highest probability, equals by name."""
    return F.slice(F.array_sort(F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("label"), e["value"].alias("p")))), 1, n)




def categorized(
    df: DataFrame, model: str = "simple", simple: PipelineModel | None = None, other: Callable | None = None, ready: bool = True, domain: list[str] = P.CATEGORIES, explain: bool = False, other_name: str = "transformer", **more,
) -> DataFrame:
    """``df`` (with text) and category, confidence and model_used; with ``explain`` also probs.

    ``model`` is the name of the model to ask: ``simple`` (any other name means it too), ``other_name``, whose
    calls ``other(rows of (text,))`` give (category, confidence, probs) and go through a seam, or ``auto``: the
    other one if there is one and it is ready, else the simple one. What is not of the domain becomes the last
    category. Blank texts are not asked about: last category, 0, and the name that was asked for. A row at
    which the other model fails has the last category, 0 and its error in category_error.
    """
    asked = model.lower()
    use_other = asked == other_name or (asked == "auto" and other is not None and ready)
    if (other if use_other else simple) is None:
        raise ValueError(f"no model for {model}")
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    d = df.select(F.struct("*").alias("row"), F.col("text"), (~blank).alias("wanted"))
    if use_other:
        kind = T.StructType([T.StructField("category", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("probs", T.MapType(T.StringType(), T.DoubleType()))])
        d = with_model(d, ["text"], "answer", kind, other, where="wanted", **more)
        got = {"category": F.col("answer.category"), "confidence": F.col("answer.confidence"), "probs": F.col("answer.probs"), "error": F.col("answer_error")}
    else:
        d = predict(simple, d)
        got = {"category": F.col("predicted"), "confidence": F.col("confidence"), "probs": F.col("probs"), "error": F.lit(None).cast("string")}
    own = F.col("wanted")
    new = {
        "category": F.when(own & got["category"].isin(*domain), got["category"]).otherwise(domain[-1]), "confidence": F.when(own, F.coalesce(got["confidence"], F.lit(0.0))).otherwise(0.0),
        "model_used": F.when(own, F.lit(other_name if use_other else "simple")).otherwise(model), **({"probs": F.when(own, got["probs"])} if explain else {}), **({"category_error": got["error"]} if use_other else {}),
    }
    return d.select("row", F.struct(*(v.alias(k) for k, v in new.items())).alias("new")).select("row.*", "new.*")
