"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from noticeflow.llm.common import read


def op1_exact_dedup(spark, sf_dir):
    from noticeflow.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file: in the folder that NOTICEFLOW_TOKENIZERS names, if it is set, else where public_tokenizers has it."""
    folder = os.environ.get("NOTICEFLOW_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark, sf_dir):
    from noticeflow.llm.bpe import round_trip

    return round_trip(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_lm_score(spark, sf_dir):
    from noticeflow.llm.lm import score

    return score(read(spark, sf_dir, "documents"))


def op4_secret_scan(spark, sf_dir):
    from noticeflow.llm.secrets import secret_scan

    return secret_scan(read(spark, sf_dir, "documents"))


def secret_ledger(spark, sf_dir):
    """path, version, n_spans, spans of all versions with findings, after two runs over one ledger: documents first, then
    the documents again with pages beside them and a second version of every document, of which only the new blobs are scanned."""
    import uuid

    from pyspark.sql import functions as F

    from noticeflow.llm.secrets import scan_history, spans_text
    from noticeflow.runtime import checkpoint_root

    place = f"{checkpoint_root(spark)}/secrets-{uuid.uuid4().hex}"
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    first = docs.select(F.concat(F.lit("documents/"), "doc_id").alias("path"), F.lit(1).alias("version"), "text")
    scan_history(first, place)
    second = first.withColumns({"version": F.lit(2), "text": F.rtrim("text")})
    other = pages.select(F.concat(F.lit("pages/"), "page_id").alias("path"), F.lit(2).alias("version"), F.col("html").alias("text"))
    found = scan_history(first.unionByName(second).unionByName(other), place)
    return found.select("path", "version", F.size("spans").alias("n_spans"), spans_text(F.col("spans")).alias("spans"))


def op8_near_dedup(spark, sf_dir):
    from noticeflow.llm.near_dup import near_dedup

    return near_dedup(read(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    from noticeflow.llm.langid import language_id

    return language_id(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_quality(spark, sf_dir):
    from noticeflow.llm.quality import quality

    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_warc_derivatives(spark, sf_dir):
    from noticeflow.llm.warc import derivatives

    return derivatives(read(spark, sf_dir, "pages"))


def op6_decontamination(spark, sf_dir):
    from noticeflow.llm.decontam import decontaminate

    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark, sf_dir):
    from noticeflow.llm.line_dedup import line_dedup

    return line_dedup(read(spark, sf_dir, "documents"))


def op11_importance(spark, sf_dir):
    from noticeflow.llm.importance import importance_resampling

    return importance_resampling(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_simhash(spark, sf_dir):
    from noticeflow.llm.simhash import simhash

    return simhash(read(spark, sf_dir, "documents"))


def op13_alignment(spark, sf_dir):
    from noticeflow.llm.alignment import align

    return align(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_bpe, op3_lm_score, op4_secret_scan, op5_warc_derivatives, op6_decontamination, op7_line_dedup, op8_near_dedup, op9_language_id, op10_quality, op11_importance, op12_simhash, op13_alignment, secret_ledger)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)""",
    "op7_line_dedup": f"""
        WITH l AS (
          SELECT doc_id, line, pos, {_LOWER.format("trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')")} AS key
          FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
        common AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN common ON l.key = common.key GROUP BY doc_id""",
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
        g AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS gram
              FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
        ks AS (SELECT DISTINCT k FROM g),
        w AS (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS gram
              FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks)),
        m AS (SELECT doc_id, p, w.k, item_id FROM w JOIN g ON w.k = g.k AND w.gram = g.gram),
        hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
    "op11_importance": f"""
        WITH crc AS (
          SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
        d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
        b AS (SELECT list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
        df AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d),
        bf AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM b),
        u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
        h AS (SELECT f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda p: CAST('0x' || substr(h, p, 2) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM u, crc),
        s AS (SELECT bucket, count(*) AS n FROM df JOIN h USING (f) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM bf JOIN h USING (f) GROUP BY bucket),
        sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s, (SELECT coalesce(sum(n), 0) FROM t) AS t),
        gain AS (SELECT i AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (sums.s + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (sums.t + 10000)))) AS BIGINT) AS g
                 FROM range(10000) r(i) CROSS JOIN sums LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
        w AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
        x AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                     coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
              FROM d LEFT JOIN w ON d.doc_id = w.doc_id),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_words >= 20)
        SELECT x.doc_id, n_features, weight, score, r.rank FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND r.rank <= (SELECT 25 * count(*) // 100 FROM r)""",
}
