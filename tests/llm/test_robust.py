"""All operators and stages on nulls, clashing names, empty tables, repeated rows and hostile texts."""

import html.parser
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noticeflow.llm import bpe, decontam, exact_dedup, langid, line_dedup, lm, near_dup, quality, secrets, warc
from noticeflow.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
HELPERS = (
    "row rid th node kept keep words wh text_hash block name names pos key a b at k w set sets items item fp fps known spans places start end n bits best label bands hashes counts weights "
    "_id _th _mth _node _kept _text _words _quality quality_score kept_text n_lines n_dropped score held_out chunk shard tokens answer page_id url whole n_tokens2 lang2 _y _first"
).split()


@pytest.fixture(scope="module")
def clashing(awkward):
    """Every awkward row, with a column of the user's for each name that an operator uses itself."""
    df = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    return df.withColumns({h: F.concat(F.lit("own "), F.lit(h)) for h in HELPERS})


def benchmark(spark):
    return spark.createDataFrame([(1, "Hello world second line"), (None, None), (2, ""), (2, "plage")], "item_id bigint, text string").withColumns({h: F.lit(1) for h in HELPERS})


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 1), (8, 0, 0), (None, 1, 0), (6, None, 0), (7, 3, 0)], "doc_id bigint, quality int, toxic int").withColumns({h: F.lit(1) for h in HELPERS})


BPE, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
OPERATORS = {
    "exact_dedup": lambda d: exact_dedup.exact_dedup(d),
    "bpe": lambda d: bpe.round_trip(d, BPE),
    "lm": lambda d: lm.score(d),
    "secrets": lambda d: secrets.secret_scan(d),
    "decontam": lambda d: decontam.decontaminate(d, benchmark(d.sparkSession)),
    "line_dedup": lambda d: line_dedup.line_dedup(d, 2),
    "near_dedup": lambda d: near_dup.near_dedup(d),
    "langid": lambda d: langid.language_id(d, PIECES),
    "quality": lambda d: quality.quality(d, labels(d.sparkSession)),
}
STAGES = {
    "keep_good": lambda d: quality.keep_good(d, labels(d.sparkSession)),
    "drop_common_lines": lambda d: line_dedup.drop_common_lines(d, 2),
    "keep_one": lambda d: near_dup.keep_one(d),
    "drop_contaminated": lambda d: decontam.drop_contaminated(d, benchmark(d.sparkSession)),
    "encode": lambda d: bpe.encode(d, BPE),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_clashing_names(clashing, name):
    f = OPERATORS[name]
    plain = clashing.select("doc_id", "text", "lang")
    got, want = f(clashing), f(plain)
    assert got.columns == want.columns and got.columns[0] == "doc_id"
    assert Counter(map(repr, got.collect())) == Counter(map(repr, want.collect()))
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(r.doc_id for r in plain.collect())
    assert f(clashing.limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_clashing_names(clashing, name):
    out = STAGES[name](clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns
    rows = out.collect()
    assert rows and all(r[h] == f"own {h}" for r in rows for h in HELPERS)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in clashing.collect()}
    whole = {(r.doc_id, r.text): r for r in clashing.collect()}
    if name != "drop_common_lines":
        assert all(r.asDict().items() >= whole[r.doc_id, r.text].asDict().items() for r in rows)
    assert STAGES[name](clashing.limit(0)).count() == 0


def test_keep_one_of_repeated_rows(spark):
    """Of rows that agree in id and text one stays, of those that only share the id each goes by its text."""
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (1, "other words stand here alone"), (2, text + " more"), (None, text), (3, None), (3, None), (4, "")], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.text) for r in near_dup.keep_one(df).collect())
    assert got == {(1, text): 1, (1, "other words stand here alone"): 1, (3, None): 1}


def test_keep_good_keeps_what_scores_well(spark):
    docs, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.score for r in quality.quality(docs, lab).collect()}
    kept = {r.doc_id for r in quality.keep_good(docs.withColumn("quality_score", F.lit(-1)), lab).collect()}
    assert kept == {d for d, s in score.items() if s >= 0.7} and 0 < len(kept) < len(score)


def test_lines_of_documents_without_id_count_once(spark):
    df = spark.createDataFrame([(None, "a\nb"), (None, "a\nc"), (1, "b"), (2, "c\nd")], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(df, 2).collect())
    assert got == {(None, 1): 2, (1, 1): 1, (2, 1): 1}  # 'a' is in one document only, as those without id are one


# hostile texts: the cost is that of their length


MB = 1 << 20
HOSTILE = {"marks": "#" * MB + "x", "jwt": "eyJ" * (MB // 3), "spaces": "token" + " " * MB, "words": "la " * (MB // 3), "long word": "x" * MB, "lines": "\n" * MB, "equals": "=" * MB, "letters": "ab" * (MB // 2)}
PAGES = {
    "scripts": "<script>" * (MB // 8), "open tags": "<a " * (MB // 3), "comments": "<!--" * (MB // 4), "attributes": "<a " + "a" * MB + ">", "quotes": '<a href="' * (MB // 9),
    "references": "&#" + "9" * MB + ";", "ends": "<style></style " * (MB // 15), "titles": "<title>" * (MB // 7), "html": "<html " * (MB // 6), "names": "<" * MB,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_text_scans(name):
    start = time.perf_counter()
    quality.features(HOSTILE[name])
    secrets.find(HOSTILE[name])
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("name", PAGES)
def test_hostile_pages(name):
    start = time.perf_counter()
    warc.plain_text(PAGES[name])
    warc.metadata(PAGES[name], "http://a/")
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("name", OPERATORS)
def test_hostile_texts_in_operators(spark, name):
    rows = [(i, t, "en") for i, t in enumerate(HOSTILE.values())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    start = time.perf_counter()
    assert OPERATORS[name](df).count() == len(rows)
    assert time.perf_counter() - start < 60


def test_decontamination_of_repeated_words(spark):
    n = 20_000
    df = spark.createDataFrame([(1, "la " * n), (2, "la " * 9), (3, "x " + "la " * 10)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, "la " * n) for i in range(3)], "item_id bigint, text string")
    start = time.perf_counter()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.decontaminate(df, bench).collect()}
    assert got == {1: (n, n, 3), 2: (9, 0, 0), 3: (11, 10, 3)} and time.perf_counter() - start < 40


# pages against an HTML parser, and two runs of the ledger


class Fields(html.parser.HTMLParser):
    LINKS = {"a": "href", "area": "href", "link": "href", "form": "action", "img": "src", "iframe": "src", "frame": "src", "source": "src"}

    def __init__(self):
        super().__init__()
        self.links, self.metas, self.language, self.title, self.inside = [], 0, None, None, False

    def handle_starttag(self, tag, attrs):
        a = dict(reversed(attrs))
        if tag in self.LINKS and (a.get(self.LINKS[tag]) or "").strip():
            self.links.append((tag, a[self.LINKS[tag]]))
        if tag == "meta" and ("charset" in a or "content" in a and (a.get("name") or a.get("property") or a.get("http-equiv"))):
            self.metas += 1
        if tag == "html" and self.language is None:
            self.language = a.get("lang")
        if tag == "title" and self.title is None:
            self.title, self.inside = "", True

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "title"

    def handle_data(self, data):
        if self.inside:
            self.title += data


def test_metadata_equals_parser(spark):
    from urllib.parse import urljoin

    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        f = Fields()
        f.feed(p.html)
        f.close()
        lines = warc.metadata(p.html, p.url).split("\r\n")[:-1]
        assert [x for x in lines if x.startswith("outlink: ")] == [f"outlink: {urljoin(p.url, ' '.join(to.split()))} {t}/@{Fields.LINKS[t]}" for t, to in f.links]
        assert sum(x.startswith(("meta-", "charset: ")) for x in lines) == f.metas
        assert [x[7:] for x in lines if x.startswith("title: ")] == ([" ".join(f.title.split())] if f.title is not None else [])
        assert [x[10:] for x in lines if x.startswith("language: ")] == ([f.language] if f.language else [])


def test_records_keep_headers_and_digests(spark):
    rows = [(1, "http://a/b", "<p>x</p>", "HTTP/1.1 200 OK\r\nServer: s\r\n\r\n", "2020-01-02T03:04:05Z"), (2, "http://a/c", "<p>y</p>", None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, http_headers string, warc_date string")
    records = warc.derivatives(df)
    raw = {(r.page_id, r.record_type): bytes(r.record) for r in warc.serialised(records).collect()}
    by = {(r.page_id, r.record_type): r for r in records.collect()}
    for kind in ("metadata", "conversion"):
        one, two = raw[1, kind], raw[2, kind]
        assert b"WARC-Source-HTTP-Header: Server: s\r\n" in one and b"WARC-Date: 2020-01-02T03:04:05Z" in one and b"Unknown" not in one
        assert f"WARC-Source-Block-Digest: {by[1, kind].source_block_digest}".encode() in one and b"WARC-Refers-To: <urn:uuid:" in one
        assert f"WARC-Source-Payload-Digest: {by[2, kind].source_payload_digest}".encode() in two
        assert b"WARC-Source-HTTP" not in two and b"WARC-Source-Date-Unknown: true" in two
        assert by[1, kind].synthetic == "" and by[2, kind].synthetic == "headers,date"


def test_ledger_grows_by_runs(spark, tmp_path):
    place = str(tmp_path / "ledger")
    one = spark.createDataFrame([("a.txt", 1, "token=abcdefghijklmnop"), ("b.txt", 1, "plain"), ("c.txt", 1, None)], "path string, version int, text string")
    first = {(r.path, r.version): len(r.spans) for r in secrets.scan_history(one, place).collect()}
    assert first == {("a.txt", 1): 1}
    before = spark.read.parquet(place).count()
    two = one.union(spark.createDataFrame([("copy.txt", 2, "token=abcdefghijklmnop"), ("b.txt", 2, "secret: qrstuvwxyzabcdef"), ("a.txt", 2, "gone")], one.schema))
    second = {(r.path, r.version) for r in secrets.scan_history(two, place).collect()}
    assert second == {("a.txt", 1), ("copy.txt", 2), ("b.txt", 2)}
    assert before == 3 and spark.read.parquet(place).count() == 5  # only the two new blobs were scanned
    secrets.append_ledger(two.select(F.lit(1).alias("doc_id"), "text"), place)
    assert spark.read.parquet(place).count() == 5
    secrets.append_ledger(two.select(F.lit(1).alias("doc_id"), "text"), place, version=2)
    assert Counter(r.rules for r in spark.read.parquet(place).collect()) == {1: 5, 2: 5}


def test_very_long_words_have_the_same_sum(monkeypatch):
    p = langid.pieces_of(PIECES)
    m = langid.fit(p, [("a", "hello", 3), ("a", "thing", 2), ("b", "bonjour", 3), ("b", "chose", 1)])
    words = ["hellothing" * 30, "字" + "bonjour" * 40]
    want = m.words(p, words)
    monkeypatch.setattr(langid, "VERY_LONG", 5)
    assert m.words(p, words) == pytest.approx(want, rel=1e-9)


def test_vocabulary_of_another_form(tmp_path):
    with pytest.raises(ValueError):
        bpe.Bpe(tokenizer_file("word_bpe_49k.json"))


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
