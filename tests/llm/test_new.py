"""Importance resampling, SimHash and tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from noticeflow.llm import alignment, importance, simhash
from noticeflow.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward.select((F.col("doc_id") + 10**15).alias("doc_id"), "text"))


def features(text):
    ws = WORD.findall(lower(text))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10_000 for i in range(len(ws)) for k in (1, 2) if i + k <= len(ws)]


def brute_importance(docs, target):
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, x in own for b in x), Counter(b for x in target for b in features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in range(10_000)]
    out = []
    for i, words, x in own:
        weight = math.floor(sum(gain[b] for b in x) / len(x)) if x else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * 25 // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_importance(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = importance.importance_resampling(docs, bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and all(t == "bigint" for _, t in got.dtypes)
    want = brute_importance([tuple(r) for r in docs.collect()], [r.text for r in bench.collect()])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_importance_edges(spark, docs, awkward):
    empty = docs.limit(0)
    assert importance.importance_resampling(empty, docs).count() == 0
    assert importance.importance_resampling(docs, empty).filter("rank IS NOT NULL").count() > 0
    kept = importance.resample(awkward, awkward, percent=100, least_words=1)
    assert kept.columns == awkward.columns
    wordy = [r for r in awkward.collect() if WORD.search(lower(r.text))]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, wordy))
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same words here " * 10).alias("text"))
    assert sorted(r["rank"] for r in importance.importance_resampling(hot, docs).filter("rank IS NOT NULL").collect()) == list(range(1, 751))


def test_feature_ring():
    words = [w.encode() for w in "a bb ccc a été".split()]
    for n in (1, 2, 3, 7):
        want = [zlib.crc32(b" ".join(words[i : j + 1])) for j in range(5) for i in range(max(0, j - n + 1), j + 1)]
        assert importance.feature_hashes(words, n).tolist() == want
    long = importance.feature_hashes([b"x%d" % i for i in range(300_000)])
    assert len(long) == 599_999


def brute_fingerprint(text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", lower(text)) if w]
    runs = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, radius):
    """Least member of each fingerprint's component, from all pairs."""
    fps = sorted(fps)
    at = np.array(fps, np.uint64)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for f in fps:
        for g in at[np.bitwise_count(at ^ np.uint64(f)) <= radius].tolist():
            a, b = sorted((find(f), find(g)))
            root[b] = a
    return {f: find(f) for f in fps}


def test_simhash(spark, docs):
    got = rows(simhash.simhash(docs))
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    comp = brute_components({f for _, f in fps}, 2)
    least = {}
    for i, f in fps:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = sorted(((i is None, i or 0), f"{f:016x}", least.get(comp[f])) for i, f in fps)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_simhash_links(spark, radius, monkeypatch):
    """Random fingerprints, chains of near ones, and a bucket that is cut finer and into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 100)
    monkeypatch.setattr(simhash, "BIN", 1000)
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for f in list(fps)[:40]:
        for _ in range(12):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 1)))
            fps.add(f)
    base = rng.getrandbits(64)
    fps |= {base ^ rng.getrandbits(14) for _ in range(700)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df, radius).collect()]
    comp = brute_components(fps, radius)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in found:
        assert comp[u] == comp[v]
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert {f: find(f) for f in fps} == comp
    assert len(found) <= len(simhash.choices(radius)) * (radius + 2) * 10 * len(fps)


def test_bit_slices():
    rng = np.random.RandomState(1)
    fps = rng.randint(0, 1 << 62, 300).astype(np.uint64)
    fps[150:] = fps[:150] ^ (np.uint64(1) << rng.randint(0, 62, 150).astype(np.uint64))
    n = np.arange(300)
    for radius in (0, 1, 2, 4):
        root = simhash.linked(fps, n + 1, np.full(300, 300), radius)
        comp, first = brute_components(set(fps.tolist()), radius), {}
        for k, f in enumerate(fps.tolist()):
            first.setdefault(comp[f], k)
        assert root.tolist() == [first[comp[f]] for f in fps.tolist()]
    assert simhash.majority(np.array([1, 1, 2], np.uint64)) == 1 and simhash.majority(np.zeros(0, np.uint64)) == 0


def test_simhash_edges(spark, awkward):
    assert simhash.simhash(awkward.limit(0)).count() == 0
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == simhash.simhash(awkward).select(F.coalesce("component_id", F.lit(-1))).distinct().count()
    long = spark.createDataFrame([(1, "w " * 500_000), (2, "w " * 400_000), (3, None), (4, " \t"), (5, " ")], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.simhash(long).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == got[4].component_id == 3
    assert got[3].fingerprint == "0" * 16 and got[5].fingerprint == f"{brute_fingerprint(chr(0xA0)):016x}"


def brute_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    to_byte = {chr(x) if x in own else chr(next(rest)): x for x in range(256)}
    done = []
    for i, text in docs:
        if not text:
            done.append((i, [], [], []))
            continue
        ta = a.encode(" " + text, add_special_tokens=False)
        tb = b.encode(text)
        sides = [[(k, bytes(to_byte[c] for c in t)) for k, t in zip(ta.ids, ta.tokens, strict=True)]]
        sides.append([(k, bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()) for k in tb for p in [b.id_to_piece(k)]])
        if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
            done.append((i, [], [], []))
            continue
        spans = []
        for s in sides:
            at, out = 0, []
            for k, x in s:
                out.append((at, at + len(x), k))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(spans[0]) < 3000 else two_pointers(*spans)
        groups, start = [], 0
        by_end = [sorted(s) for s in spans]
        for c in cuts:
            groups.append("|".join(",".join(str(k) for s, e, k in side if start <= s and e <= c) for side in by_end) if len(cuts) < 3000 else "")
            start = c
        done.append((i, spans, links, groups))
    count = Counter(x for _, _, links, _ in done for x in links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for i, spans, links, groups in done:
        n = [len(s) for s in spans] or [0, 0]
        out.append((i, *n, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out


def two_pointers(a, b):
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        out.append((a[i][2], b[j][2]))
        x, y = a[i][1], b[j][1]
        i, j = i + (x <= y), j + (y <= x)
    return out


PATHS = (tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def test_alignment(spark, docs):
    odd = ["<|endoftext|> and <s> <0x41>", "under▁score", "nul\x00byte", " lead  and trail  ", "日本語 テキスト 🙂🙃", "é combining", "\n\n\t x", "a", " "]
    small = docs.filter(F.length("text") < 2500).limit(60).unionByName(docs.filter("text IS NULL OR text = ''"))
    df = small.unionByName(spark.createDataFrame(list(enumerate(odd, 7 * 10**15)), "doc_id long, text string"))
    got = alignment.align(df.repartition(3), *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment([tuple(r) for r in df.collect()])
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[4] == 0 for r in want) >= 2
    # the table of pairs and the links are those that the columns count
    table, links = alignment.vocabulary_links(df, *PATHS), alignment.token_links(df, *PATHS)
    assert table.agg(F.sum("n")).first()[0] == sum(r[4] for r in want) == links.count()
    again = links.groupBy("a_id", "b_id").count().withColumnRenamed("count", "n")
    assert table.select("a_id", "b_id", "n").exceptAll(again.select(F.col("a_id").cast("int"), F.col("b_id").cast("int"), "n")).count() == 0


def test_alignment_edges(spark, awkward, monkeypatch):
    assert alignment.align(awkward.limit(0), *PATHS).count() == 0
    assert alignment.align(awkward, *PATHS).count() == awkward.count()
    long = spark.createDataFrame([(1, "word and " * 60_000), (2, "y" * 300_000), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align(long, *PATHS).collect()}
    assert got[1].n_links >= got[1].n_a > 100_000 and got[2].n_groups > 0 and got[3].n_links == 0
    # a hot pair in every chunk, chunks of one document
    monkeypatch.setattr(alignment, "CHUNK", 1)
    hot = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text")).repartition(8)
    out = alignment.align(hot, *PATHS).collect()
    assert len(out) == 500 and {r.count_sum for r in out} == {500 * r.n_links for r in out} and all(r.n_best == r.n_links for r in out)
