"""The category model against a NumPy computation of the same model, its store, and the choice between models."""

import re
from collections import Counter

import numpy as np
import pytest

from noticeflow.functions import patterns as P
from noticeflow.operators import ml

WORDS = {"준비물": "도시락 물통 돗자리 준비 가위 색종이", "비용": "참가비 급식비 납부 계좌 원 수업비", "일정": "운동회 방학 오전 다음 주 월요일"}


def rows(n):
    rng = np.random.RandomState(4)
    out = []
    for i in range(n):
        k = ["준비물", "비용", "일정"][min(2, i % 4)]
        own = WORDS[k].split()
        out.append((" ".join(own[j] for j in rng.randint(0, len(own), rng.randint(1, 9))) + f" {i % 7}", k))
    return out


def grams(text):
    """Character 2- to 4-grams within words, padded by a blank on either side."""
    out = []
    for w in (f" {w} " for w in text.lower().split()):
        for n in (2, 3, 4):
            out += [w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else []
            if len(w) <= n:
                break
    return Counter(out)


@pytest.fixture(scope="module")
def fitted(spark):
    data = rows(120)
    return data, ml.train(spark.createDataFrame(data, "text string, category string"))


def numpy_model(model, train_texts):
    """Features and probabilities by the model's vocabulary and coefficients, the rest computed anew."""
    vocabulary = model.stages[1].vocabulary
    n = len(train_texts)
    having = Counter(g for t in train_texts for g in grams(t))
    idf = np.array([1 + np.log((1 + n) / (1 + having[g])) for g in vocabulary])

    def features(text):
        x = np.zeros(len(vocabulary))
        at = {g: i for i, g in enumerate(vocabulary)}
        for g, c in grams(text).items():
            if g in at:
                x[at[g]] = 1 + np.log(c)
        x = x * idf
        return x / (np.linalg.norm(x) or 1)

    lr = model.stages[-2]
    w, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()

    def probabilities(x):
        z = x @ w.T + b
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    return features, probabilities, w


def test_probabilities(spark, fitted, tmp_path):
    data, model = fitted
    texts = [t for t, _ in data]
    assert {g for t in texts for g in grams(t)} == set(model.stages[1].vocabulary)
    features, probabilities, _ = numpy_model(model, texts)
    labels = model.stages[0].labels
    asked = [*texts[:20], "물통 물통 물통 원", "처음 보는 말", "x", "참가비 " * 50]
    place = str(tmp_path / "model")
    model.write().save(place)
    for m in (model, ml.load_or_train(place, spark.createDataFrame([], "text string, category string"))):
        got = {r.text: r for r in ml.predict(m, spark.createDataFrame([(t,) for t in asked], "text string")).collect()}
        for t in asked:
            want = probabilities(features(t))
            assert np.allclose([got[t].probs[k] for k in labels], want, atol=1e-6), t
            assert abs(got[t].confidence - want.max()) < 1e-6 and got[t].predicted == labels[int(want.argmax())]


def test_fit_is_the_optimum(fitted):
    """The gradient of half the squared coefficients plus the weighted loss vanishes."""
    data, model = fitted
    features, probabilities, w = numpy_model(model, [t for t, _ in data])
    labels = list(model.stages[0].labels)
    x = np.array([features(t) for t, _ in data])
    y = np.array([labels.index(k) for _, k in data])
    weight = (len(y) / (len(labels) * np.bincount(y)))[y]
    off = (probabilities(x) - np.eye(len(labels))[y]) * weight[:, None]
    assert np.abs(w + off.T @ x).max() < 1e-3 and np.abs(off.sum(axis=0)).max() < 1e-3


def test_counts_stage(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(1, Vectors.sparse(4, {0: 1.0, 3: 5.0})), (2, Vectors.sparse(4, {})), (3, Vectors.dense(0.0, 2.0))], ["id", "tf"])
    got = {r.id: r.logs for r in ml.SublinearCounts(inputCol="tf", outputCol="logs").transform(df).collect()}
    assert np.allclose(got[1].toArray(), [1, 0, 0, 1 + np.log(5)]) and got[2].toArray().tolist() == [0] * 4 and np.allclose(got[3].toArray(), [0, 1 + np.log(2)])


def test_choice_of_model(spark, fitted):
    _, simple = fitted
    df = spark.createDataFrame([(1, "참가비 납부"), (2, "  "), (3, None), (4, "boom"), (5, "odd")], "id int, text string")

    def other(asked):
        if any(t == "boom" for (t,) in asked):
            raise ValueError("boom")
        return [("elsewhere" if t == "odd" else "비용", 0.7, {"비용": 0.7}) for (t,) in asked]

    def run(**more):
        return {r.id: r for r in ml.categorized(df, simple=simple, **more).collect()}

    got = run(model="auto", other=other, explain=True)
    assert got[1][2:5] == ("비용", 0.7, "transformer") and got[1].probs == {"비용": 0.7}
    assert [got[i][2:5] for i in (2, 3)] == [(P.OTHER, 0.0, "auto")] * 2 and got[2].probs is None
    assert got[4].category == P.OTHER and got[4].confidence == 0 and re.search("boom", got[4].category_error)
    assert got[5][2:5] == (P.OTHER, 0.7, "transformer")
    for more in ({"model": "auto", "other": other, "ready": False}, {"model": "auto"}, {"model": "Simple"}, {"model": "unknown"}):
        got = run(**more)
        assert got[1].category == "비용" and got[1].model_used == "simple" and 0 < got[1].confidence < 1 and got[3].model_used == more["model"]
    with pytest.raises(ValueError):
        run(model="transformer")
