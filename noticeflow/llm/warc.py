"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives two records. Both refer to the response by its record id
and repeat its target, date, headers and digests; the conversion holds the
page's text, the metadata record what the page says about itself and where it
links to. All ids follow from content, so a job that runs again after the loss
of an executor gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.runtime import map_arrow

DATE = "1970-01-01T00:00:00Z"
_TAG = re.compile(r"<(!|/?[a-zA-Z][^\s/>]*)([^>]*)>")
_SKIPPED = {"script", "style", "noscript", "template", "head"}
_RAW = {"script", "style"}
_BLOCK = set(
    "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section "
    "table tbody td tfoot th thead title tr ul".split()
)
_BREAKS = _BLOCK | {"/" + x for x in _BLOCK}
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"']+)""")
_LINK_ATTR = {"a": "href", "area": "href", "link": "href", "form": "action", "img": "src", "iframe": "src", "frame": "src", "source": "src"}
_TELLING = {"title", "html", "meta", *_LINK_ATTR}
_BLANKS = re.compile(r"[^\S\n]+")
_LONG_REF = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
SCHEMA = (
    "page_id {id}, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_headers string, source_block_digest string, source_payload_digest string, block_digest string, content_length long, block string, synthetic string"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return uuid.UUID(bytes=hashlib.sha256("\x00".join(parts).encode("utf-8", "replace")).digest()[:16], version=5).urn


def unescape(text: str) -> str:
    """Character references resolved; numbers of eight digits and more, which name no character, are U+FFFD."""
    return html.unescape(_LONG_REF.sub("\ufffd", text)) if "&" in text else text


class _Page:
    """One pass over a page's tags. What is not closed after some place is remembered, so no part is searched twice in vain."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()
        self.end_tags: dict[str, re.Pattern] = {}

    def _after(self, mark: str, at: int) -> int:
        """End of the next ``mark``, or -1."""
        if mark in self.missing:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.missing.add(mark)
            return -1
        return found + len(mark)

    def end_tag(self, name: str, at: int) -> tuple[int, int]:
        """Place of the next end tag of that name, or (-1, -1)."""
        if name in self.missing:
            return -1, -1
        rule = self.end_tags.setdefault(name, re.compile(rf"</{name}\s*+>", re.I))
        m = rule.search(self.page, at)
        if not m:
            self.missing.add(name)
            return -1, -1
        return m.span()

    def parts(self, skipped: set[str]):
        """(text before, tag name with / for end tags, match of the tag); last (rest, '', None). The contents of closed
        ``skipped`` elements, comments and declarations are left out. A tag ends at the next '>', so that what
        follows the last '>' is text."""
        page, at, text = self.page, 0, 0
        last = page.rfind(">") + 1
        while at < last:
            for m in _TAG.finditer(page, at, last):
                name = m[1].lower()
                stop = -1
                if name == "!":
                    stop = self._after("-->", m.start() + 4) if page.startswith("<!--", m.start()) else -1
                elif name in skipped:
                    stop = self.end_tag(name, m.end())[1]
                    name = name if stop < 0 else "!"
                yield page[text : m.start()], name, m
                text = m.end() if stop < 0 else stop
                if stop >= 0:
                    at = stop
                    break
            else:
                break
        yield page[text:], "", None


def plain_text(page: str) -> str:
    """Text between the tags of a whole page: a line for each block, blanks within it as one, empty lines left out."""
    out = []
    for text, name, _ in _Page(page).parts(_SKIPPED):
        out.append(text)
        if name in _BREAKS:
            out.append("\n")
    lines = (x.strip() for x in _BLANKS.sub(" ", unescape("".join(out))).split("\n"))
    return "\n".join(x for x in lines if x)


def _value(raw: str) -> str:
    return unescape(raw[1:-1] if raw[:1] in "\"'" else raw).strip()


def _attributes(raw: str) -> dict[str, str]:
    """Of equal names the first."""
    out: dict[str, str] = {}
    for k, v in _ATTR.findall(raw):
        out.setdefault(k.lower(), _value(v))
    return out


def metadata(page: str, url: str) -> str:
    """warc-fields of a page: title, language, meta elements and outlinks (target, tag/@attribute), each kind in order."""
    title, language, metas, links = None, None, [], []
    p = _Page(page)
    for _, name, m in p.parts(_RAW):
        if name not in _TELLING:
            continue
        if name == "title" and title is None and (close := p.end_tag("title", m.end()))[0] >= 0:
            title = " ".join(unescape(page[m.end() : close[0]]).split())
        elif name == "html" and language is None:
            language = _attributes(m[2]).get("lang") or None
        elif name == "meta":
            a = _attributes(m[2])
            if "charset" in a:
                metas.append("charset: " + " ".join(a["charset"].split()))
            elif (key := a.get("name") or a.get("property") or a.get("http-equiv")) and "content" in a:
                metas.append(f"meta-{' '.join(key.lower().split())}: {' '.join(a['content'].split())}")
        elif name in _LINK_ATTR and (to := _attributes(m[2]).get(_LINK_ATTR[name])):
            try:
                full = urljoin(url, to)
            except ValueError:
                full = to
            links.append(f"outlink: {' '.join(full.split())} {name}/@{_LINK_ATTR[name]}")
    out = ([f"title: {title}"] if title is not None else []) + ([f"language: {' '.join(language.split())}"] if language else [])
    return "".join(x + "\r\n" for x in out + metas + links)


def response_headers(payload: bytes) -> str:
    """Headers of a response of which only the page is known."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"


def derive(page_id, url: str, page: str, headers: str | None, date: str | None) -> list[tuple]:
    """The two records of a response, without its page_id."""
    payload = page.encode("utf-8", "replace")
    made = ",".join(name for name, known in (("headers", headers), ("date", date)) if known is None)
    headers = headers if headers is not None else response_headers(payload)
    whole, body = digest(headers.encode("utf-8", "replace") + payload), digest(payload)
    source = record_id("response", str(page_id), url, whole)
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", metadata(page, url)), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
        raw = block.encode("utf-8", "replace")
        out.append((kind, record_id(kind, source), source, url, date or DATE, content_type, headers, whole, body, digest(raw), len(raw), raw.decode(), made))
    return out


def derivatives(pages: DataFrame) -> DataFrame:
    """Two rows for each row of ``pages`` (page_id, url, html; also http_headers and warc_date, if they are there).

    Null pages count as empty: their conversion is empty. Null urls count as
    empty, against which links stay as they are. ``synthetic`` names what the
    table does not have and had to be made up (headers, date), so that nobody
    takes it for the source's. Rows that repeat each other give the same ids. An empty table gives an empty result; other columns
    are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    more = [F.col(c).cast("string").alias(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in ("http_headers", "warc_date")]
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), *more)

    def run(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                got = [derive(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                twice = pa.array([i for i in range(part.num_rows) for _ in (0, 1)], pa.int32())
                columns = list(zip(*(r for x in got for r in x), strict=True))
                arrays = [pa.array(c, pa.int64() if n == "content_length" else pa.string()) for c, n in zip(columns, names[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(twice), *arrays], names=names)

    return map_arrow(rows, run, SCHEMA.format(id=kind))


def serialised(records: DataFrame) -> DataFrame:
    """page_id, record_type, record: each derivative as the bytes of a WARC 1.1 record.

    Beside the fields of the standard, the source's digests and each line of
    its HTTP headers go along in fields of their own (WARC-Source-...), except
    where they were made up; a made-up date is marked.
    """
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    known = lambda what, c: F.when(F.array_contains(F.split("synthetic", ","), what), F.lit("")).otherwise(c)
    lines = F.filter(F.split("source_headers", "\r\n|\r|\n", -1), lambda x: x != "")
    source = F.array_join(F.transform(lines, lambda x: line("WARC-Source-HTTP-Header", x)), "")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("warc_date")),
        F.when(F.array_contains(F.split("synthetic", ","), "date"), F.lit("WARC-Source-Date-Unknown: true\r\n")).otherwise(""),
        known("headers", line("WARC-Source-Block-Digest", F.col("source_block_digest"))), line("WARC-Source-Payload-Digest", F.col("source_payload_digest")), known("headers", source),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return records.select("page_id", "record_type", F.encode(F.concat(head, "block", F.lit("\r\n\r\n")), "UTF-8").alias("record"))
