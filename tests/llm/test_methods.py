"""Near-duplicates and the quality model against brute force."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest

from llm.test_operators import alike
from noticeflow.llm import lm, near_dup, quality


def test_near_dedup_at_the_threshold(spark):
    """1,000 documents, twelve families of 50 among them: every pair of 0.8 or more is in one class, every class is held together by such pairs."""
    r = random.Random(11)
    texts = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(150)]
        for _ in range(50):
            w = list(base)
            for at in r.sample(range(5, 145), r.randint(1, 3)):
                w[at] = f"new{r.randrange(10**9)}"
            texts.append(" ".join(w))
    texts += [" ".join(f"u{r.randrange(400)}" for _ in range(r.randint(5, 60))) for _ in range(400)]
    got = near_dup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    cls = {x.doc_id: x.class_id for x in got}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = [p for p, v in alike(texts).items() if v >= near_dup.SIMILAR]
    for a, b in linked:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert len(texts) == 1000 and len(linked) > 2000
    assert sum(cls[a] != cls[b] for a, b in linked) == 0  # recall 1.0
    assert all(cls[d] == root(d) for d in range(len(texts)))


def test_tree_is_the_best_greedy_one():
    r = np.random.RandomState(3)
    for _ in range(50):
        n = r.randint(2, 12)
        g, h = r.randn(n), r.rand(n)
        score = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)  # noqa: E731, B023
        edges = [0, n]
        for _ in range(3):
            gains = [(score(a, k) + score(k, b) - score(a, b), k) for a, b in itertools.pairwise(edges) for k in range(a + 1, b)]
            best = max(gains, default=(0, None), key=lambda x: x[0])
            if best[0] <= 1e-6:
                break
            edges = sorted([*edges, best[1]])
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in itertools.pairwise(edges)])
        assert quality._tree(g, h) == pytest.approx(want)


def test_quadrants_are_the_best_cut():
    r = np.random.RandomState(4)
    for _ in range(30):
        n, m = r.randint(2, 6, 2)
        g, h = r.randn(n, m), r.rand(n, m)
        best, want = -1.0, None
        for i, j in itertools.product(range(1, n), range(1, m)):
            total, step = 0.0, np.zeros((n, m))
            for rows, cols in itertools.product((slice(0, i), slice(i, n)), (slice(0, j), slice(j, m))):
                total += g[rows, cols].sum() ** 2 / (h[rows, cols].sum() + 1)
                step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
            if total > best:
                best, want = total, step
        got, gain = quality._quadrants(g, h)
        assert got == pytest.approx(want) and gain == pytest.approx(best)


def test_score_is_a_sum_of_table_entries():
    r = np.random.RandomState(5)
    x = r.randn(400, 4)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    m = quality.fit(x, y)
    assert {tuple(sorted((i, j))) for i, j, _ in m.pairs} >= {(0, 1)}
    want = []
    for row in x[:50]:
        z = m.base + sum(t[sum(row[j] >= c for c in cut)] for j, (cut, t) in enumerate(zip(m.cuts, m.tables, strict=True)))
        z += sum(t[sum(row[i] >= c for c in m.coarse[i]), sum(row[j] >= c for c in m.coarse[j])] for i, j, t in m.pairs)
        want.append(1 / (1 + np.exp(-z)))
    assert m.score(x[:50]) == pytest.approx(np.array(want))
    assert ((m.score(x) > 0.5) == (y == 1)).mean() > 0.9
    one = quality.fit(x, np.ones(400))
    assert (one.score(x) > 0.99).all() and (quality.fit(x, np.zeros(400)).score(x) < 0.01).all()


def test_orders_and_bit_places():
    """Against their plain forms; a look-up of many places unpacks no bits."""
    rng = np.random.default_rng(3)
    for key in (rng.integers(0, 50, 3000), rng.integers(0, 1 << 63, 3000).astype(np.uint64), np.repeat(rng.integers(0, 1 << 63, 40), 70), (np.uint64(1) << np.uint64(63)) + rng.integers(0, 9, 3000).astype(np.uint64), np.zeros(0, np.int64), np.array([7])):
        assert (lm.ordered(key) == np.argsort(key, kind="stable")).all()
        assert all((x == y).all() for x, y in zip(lm.distinct(key), np.unique(key, return_index=True, return_inverse=True), strict=True))
    words = np.append(rng.integers(0, 1 << 63, 500).astype(np.uint64), np.array([1, 1 << 63, (1 << 64) - 1], np.uint64))
    for w in words:
        at = np.array([i for i in range(64) if int(w) >> i & 1])
        assert (lm.bit_places(np.full(len(at), w), np.arange(len(at))) == at).all()
    values = np.cumsum(rng.integers(0, 900, 200_000)).astype(np.uint64)
    packed = lm.EliasFano(*lm.EliasFano.pack(values), len(values))
    places = np.arange(len(values))
    assert (packed.get(places) == values).all() and (packed.find(values) <= places).all()
    tracemalloc.start()
    packed._select(places[: lm.BATCH], True)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
