"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record is a row with its identifier, target, date, HTTP headers and
payload. For each, two records are made that refer to it by WARC-Refers-To: a
`metadata` record (JSON: the source's headers, digests, lengths, title and links)
and a `conversion` record with the payload's text. Identifiers are name-based UUIDs
of what they are derived from, so a rerun gives the same records. `serialise`
turns records into bytes of the format, `parse` reads such bytes.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marlpit.llm import markup

SCHEMA = (
    "record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, "
    "http_headers string, block binary, block_digest string, payload_digest string, length long"
)
HIDDEN = frozenset("script style template noscript".split())
LINES = frozenset(
    "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav aside blockquote pre".split()
)
BLANK_RUN = re.compile("  +")
DATE = "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def _flow(text: str, blanks: str = "\t\n\x0b\f\r") -> str:
    """Each run of blanks as one; single blanks, nearly all of them, are not touched."""
    for blank in blanks:
        text = text.replace(blank, " ")
    return BLANK_RUN.sub(" ", text)


def _texts(page: str) -> Iterator[tuple[str | None, str]]:
    """Each markup token's name, `/` before that of an end, and the text after it."""
    before, name = 0, None
    for token in markup.tokens(page, HIDDEN):
        yield name, page[before : token.start]
        before, name = token.end, ("/" if token.closing else "") + token.name
        if token.name in HIDDEN and not token.closing:
            before = markup.raw_end(page, token.name, token.end)
    yield name, page[before:]


def plain_text(page: str) -> str:
    """Visible text, a line for each block."""
    parts, hidden = [], False
    pieces = list(_texts(page))
    # A head that nothing ends hides nothing.
    ends = max((i for i, (name, _) in enumerate(pieces) if name in ("/head", "body")), default=0)
    for i, (name, text) in enumerate(pieces):
        if name == "head":
            hidden = i < ends
        elif name in ("/head", "body"):
            hidden = False
        if name and name.removeprefix("/") in LINES:
            parts.append("\n")
        elif name is not None and (name.removeprefix("/") in HIDDEN or name in ("head", "/head")):
            parts.append(" ")
        if not hidden:
            parts.append(_flow(text))
    body = html.unescape("".join(parts))
    lines = (line.strip() for line in _flow(body, "\t\x0b\f\r").split("\n"))
    return "\n".join(line for line in lines if line)


def title(page: str) -> str:
    """The text of the first title, up to other markup."""
    for name, text in _texts(page):
        if name == "title":
            return _flow(html.unescape(text)).strip()
    return ""


def links(page: str) -> list[str]:
    """The targets of all links."""
    found = (markup.attributes(t.attributes) for t in markup.tokens(page, HIDDEN) if t.name == "a" and not t.closing)
    return [html.unescape(known["href"]) for known in found if known.get("href")]


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html).

    A null url or page is empty. Repeated rows give equal records, with one id.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, url, page in zip(batch.page_id, batch.url, batch.html):
                payload = (page or "").encode()
                headers = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                block = headers.encode() + payload
                rows.append((page_id, identifier("response", str(page_id), url or "", digest(payload)), "response", None, url or "",
                             date, "application/http; msgtype=response", headers, block, digest(block), digest(payload), len(block)))
            yield pd.DataFrame(rows, columns=["page_id", *_names()])

    kept = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    made = kept.mapInPandas(run, f"page_id string, {SCHEMA}")
    return made.select(F.col("page_id").cast(kind).alias("page_id"), *_names())


def _names() -> list[str]:
    return [field.split()[0] for field in SCHEMA.split(", ")]


def derive(records: DataFrame, carry: tuple = ()) -> DataFrame:
    """The metadata and conversion records of all response records, with the columns in `carry`.

    Other kinds of records give none. A payload is what follows the HTTP headers in
    the block; it is read as UTF-8, wrong bytes being replaced. A null block is
    empty; then the conversion record is empty too. Digests of the source are kept
    as they are, not recomputed. Repeated records give repeated derivatives.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                source, block = row.record_id, bytes(row.block or b"")
                _, split, body = block.partition(b"\r\n\r\n")
                payload = body if split and (row.http_headers or "") else block
                page = payload.decode("utf-8", "replace")
                described = json.dumps(
                    {
                        "source": {"record_id": source, "headers": row.http_headers, "block_digest": row.block_digest,
                                   "payload_digest": row.payload_digest, "length": len(payload)},
                        "title": title(page), "links": links(page),
                    }, ensure_ascii=False, sort_keys=True,
                ).encode()
                for kind, content, data in (
                    ("metadata", "application/json", described), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode()),
                ):
                    rows.append((*(getattr(row, f"carried_{i}") for i in range(len(carry))), identifier(kind, source or ""), kind, source,
                                 row.target_uri, row.date, content, row.http_headers, data, digest(data), row.payload_digest, len(data)))
            yield pd.DataFrame(rows, columns=[*[f"carried_{i}" for i in range(len(carry))], *_names()])

    packed = records.filter("warc_type = 'response'").select(
        *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)], *[c for c in _names()]
    )
    kinds = "".join(f"carried_{i} {records.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    return packed.mapInPandas(run, kinds + SCHEMA).select(*[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)], *_names())


def serialise() -> Column:
    """The bytes of each record, ready to be written one after another."""
    optional = lambda name, column: F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}: "), column, F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "warc_type", F.lit("\r\nWARC-Record-ID: "), "record_id", F.lit("\r\n"),
        optional("WARC-Refers-To", "refers_to"), optional("WARC-Target-URI", "target_uri"), optional("WARC-Date", "date"),
        optional("WARC-Block-Digest", "block_digest"), optional("WARC-Payload-Digest", "payload_digest"),
        optional("Content-Type", "content_type"), F.lit("Content-Length: "), F.length("block").cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), F.col("block"), F.lit("\r\n\r\n").cast("binary"))


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of all records in the bytes of a WARC file."""
    found = []
    while data.startswith(b"WARC/"):
        head, _, data = data.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        found.append((headers, data[:size]))
        data = data[size + 4 :]
    return found
