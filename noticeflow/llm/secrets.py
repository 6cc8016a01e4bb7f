"""Secret scans over an incremental blob ledger.

A text version is addressed by the hash of its content. The ledger has a row
for each scanned blob and rule version; a scan reads only blobs without one,
each once however many rows hold it, and the findings are joined back to every
row that has the blob.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import documents
from noticeflow.runtime import map_arrow, maybe_broadcast, release, staged

RULES_VERSION = 1
#: The base rules. Group and least length of what a match must have there.
BASE = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: Runs of hexadecimal digits are found as a whole, so that asking for 16 at once finds the same.
_HEX16 = re.compile(r"[0-9a-f]{16,}")
_HINT = re.compile(r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}")
#: Rules beyond the base.
MORE = {
    "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), "-----BEGIN "),
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"), "eyJ"),
    "login": (re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{1,128}@"), "://"),
}
KINDS = [*BASE, *MORE]
FINDINGS = "blob binary, rules int, spans array<struct<kind:string,start:int,end:int>>"


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end) of all spans, sorted."""
    out = []
    if _HINT.search(text):
        rule, group, least = BASE["assign"]
        out += [(m.start(), 0, m.end()) for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]
    if "AKIA" in text:
        rule, _, least = BASE["access"]
        out += [(m.start(), 1, m.end()) for m in rule.finditer(text) if m.end() - m.start() >= least]
    out += [(m.start(), 2, m.end()) for m in _HEX16.finditer(text)]
    for k, (rule, hint) in enumerate(MORE.values(), len(BASE)):
        if hint in text:
            out += [(m.start(), k, m.end()) for m in rule.finditer(text)]
    return sorted(out)


def with_blob(docs: DataFrame) -> DataFrame:
    return documents(docs).select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")


def blobs(docs: DataFrame) -> DataFrame:
    """Distinct (blob, text); copies within a task fall together before the shuffle."""
    return with_blob(docs).distinct()


def scan(unseen: DataFrame, version: int = RULES_VERSION) -> DataFrame:
    """A ledger row for each blob, with or without findings."""

    def run(batches):
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t)] for t in batch.column(1).to_pylist()]
            spans = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * batch.num_rows, pa.int32()), spans], names=["blob", "rules", "spans"])

    return map_arrow(unseen, run, FINDINGS)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, version: int = RULES_VERSION) -> DataFrame:
    """The ledger with rows for all blobs of ``docs``; blobs that it has under this version are not read again."""
    unseen = blobs(docs)
    if ledger is None:
        return staged(scan(unseen, version), "ledger")
    seen = ledger.filter(F.col("rules") == version).select("blob").distinct()
    return ledger.select("blob", "rules", "spans").unionByName(staged(scan(unseen.join(seen, "blob", "left_anti"), version), "ledger"))


def append_ledger(docs: DataFrame, path: str, version: int = RULES_VERSION) -> DataFrame:
    """The ledger stored at ``path``, with rows for all blobs of ``docs`` appended to it.

    Only blobs that it does not have under this rule version are scanned; what
    is there is never rewritten. A run that broke off left nothing or whole
    rows, and the next one goes on from there. One writer at a time.
    """
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    unseen, new = blobs(docs), None
    if there:
        # what is unseen is told by hashes alone; of the texts only those are moved that are to be scanned
        seen = spark.read.schema(FINDINGS).parquet(path).filter(F.col("rules") == version).select("blob")
        new = staged(with_blob(docs).select("blob").distinct().join(seen, "blob", "left_anti"), "unseen")
        unseen = with_blob(docs).join(maybe_broadcast(new), "blob", "left_semi").distinct()
    scan(unseen, version).write.mode("append").parquet(path)
    if new is not None:
        release(new)
    return spark.read.schema(FINDINGS).parquet(path)


def path_findings(history: DataFrame, ledger: DataFrame, version: int = RULES_VERSION) -> DataFrame:
    """path, version, blob, spans: the findings of every version of every path that has any.

    ``history`` has path, version and text; each blob was scanned once, in
    however many paths and versions it stands. Null texts count as empty.
    """
    # staged, so that both sides of the join are plain exchanges and a blob that stands in very many paths can be split
    known = staged(ledger.filter((F.col("rules") == version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"]), "known")
    rows = history.select("path", "version", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    return rows.join(known, "blob").select("path", "version", "blob", "spans")


def scan_history(history: DataFrame, path: str, version: int = RULES_VERSION) -> DataFrame:
    """``path_findings`` of a history (path, version, text) after its unseen blobs went into the ledger at ``path``."""
    return path_findings(history, append_ledger(history.select(F.lit(0).alias("doc_id"), "text"), path, version), version)


def findings(docs: DataFrame, ledger: DataFrame | None = None, version: int = RULES_VERSION) -> DataFrame:
    """doc_id, blob, spans for each row of ``docs``."""
    known = update_ledger(docs, ledger, version).filter(F.col("rules") == version).select("blob", "spans")
    rows = documents(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"))
    return rows.join(known, "blob").select("doc_id", "blob", "spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``.

    Null texts count as empty, which has no spans. Rows that repeat a text
    share one scan; rows that repeat a doc_id have a result each. An empty
    table gives an empty result; extra columns are ignored.
    """
    f = findings(docs, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return f.select("doc_id", *map(count, BASE), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
