"""Learning of language pieces: one step against all segmentations, and the executors' sums against one process."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from noticeflow.llm import langid
from noticeflow.llm.queries import tokenizer_file
from noticeflow.runtime import staged

PATH = tokenizer_file("piece_bpe_32k.model")


def segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in segmentations(word[k:]):
            yield [word[:k], *rest]


def test_one_step_by_brute_force():
    p = langid.pieces_of(PATH)
    ids = {x: i for i, x in enumerate(p.names)}
    rows = [("a", "the", 5), ("a", "then", 2), ("b", "eau", 3), ("b", "the", 1), ("a", "q☃x", 1), ("b", "日本語", 2), ("b", "é", 4)]
    langs = ["a", "b"]
    start = langid.even(p, 2)
    got = langid.expected(p, start, [w for _, w, _ in rows], np.array([langs.index(x) for x, _, _ in rows]), np.array([float(c) for *_, c in rows]))
    want = defaultdict(float)
    for lang, word, count in rows:
        k, each = langs.index(lang), []
        for cut in segmentations("▁" + word):
            known = [ids.get(x, -1 if len(x) == 1 else None) for x in cut]
            if None not in known:
                each.append((math.prod(start[i, k] for i in known), known))
        total = sum(q for q, _ in each)
        for q, known in each:
            for i in known:
                want[i % len(start), k] += count * q / total
    assert {(int(i), int(k)) for i, k in np.argwhere(got > 1e-9)} == {x for x, v in want.items() if v > 1e-9}
    assert all(abs(got[x] - v) < 1e-6 * max(1, v) for x, v in want.items())
    model = langid.fit(p, rows, steps=1)
    assert np.allclose(model.prob, (got + 0.01) / (got + 0.01).sum(0))


def test_executors_and_one_process_agree(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").limit(60).unionByName(spark.createDataFrame([("İSTANBUL ΟΔΟΣ " + "x" * 130, "tr"), ("", "tr")], "text string, lang string"))
    rows = d.collect()
    langs = sorted({r.lang for r in rows})
    want = Counter((r.lang, w) for r in rows for w in langid.training_words(r.text))
    counts = staged(langid.word_counts(d, langs).repartition(3, "word"), "words")
    assert {(langs[r.lang], r.word): r.n for r in counts.collect()} == want and max(len(w) for _, w in want) == langid.LONG
    one = langid.fit(langid.pieces_of(PATH), [(x, w, c) for (x, w), c in want.items()])
    two, three = langid.learned(counts, PATH, langs), langid.learned(counts.repartition(1), PATH, langs)
    assert one.langs == two.langs and np.allclose(one.prob, two.prob, rtol=1e-3, atol=1e-9) and np.allclose(two.prob, three.prob, rtol=1e-3, atol=1e-9)
    assert langid.word_counts(d.filter(F.lit(False)), langs).count() == 0
