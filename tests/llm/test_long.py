"""Very long texts: many separate spans, many lines that go."""

import hashlib
import time

from noticeflow.llm import decontam, line_dedup

MB = 1 << 20


def test_many_spans(spark):
    items = spark.createDataFrame([("i1", "a"), ("i2", "b b b c")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "a b " * (MB // 4)), (2, "a b b b b c c " * 50), (3, "c c"), (4, None)], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r for r in decontam.decontaminate(docs, items).collect()}
    assert time.time() - start < 30
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (MB // 2, MB // 4, 1) and not got[3].contaminated
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in decontam.hits(docs, items).filter("spans IS NOT NULL").collect()}
    assert spans[2] == [x for k in range(50) for x in ((7 * k, 7 * k + 1), (7 * k + 2, 7 * k + 6))] and got[2].n_hit == 250
    assert len(spans[1]) == MB // 4 and spans[1][1] == (2, 3)


def test_many_lines_that_go(spark):
    n = MB // 5
    every = "\n".join(f"x{i % 999:03d}" for i in range(n))
    mixed = [f"own{i}" if i % 1000 in (0, 63, 64, 999) else "gone" for i in range(20_000)]
    docs = spark.createDataFrame([(1, every), (2, every), (3, "\n".join(mixed)), (4, "gone\nstays")], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, min_docs=2).collect()}
    assert time.time() - start < 30
    assert (got[1].n_lines, got[1].n_dropped, got[1].kept_sha256) == (n, n, hashlib.sha256(b"").hexdigest())
    assert got[3].kept_sha256 == hashlib.sha256("\n".join(x for x in mixed if x != "gone").encode()).hexdigest() and got[4].n_dropped == 1
