"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is a row with its whole bytes. From each response record two records are derived: a
``conversion`` with the plain text and a ``metadata`` record with the response's HTTP headers, title and
digests. Both refer to the response by ``WARC-Refers-To`` and name each other by
``WARC-Concurrent-To``; target, date and payload digest of the source are kept. Record identifiers
are derived from the source's, so that a rerun writes the same files. It is a map over records: no
shuffle, a record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.common import table

VERSION = "WARC/1.1"
END = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Comments, scripts and styles without an end reach to the end of the page. The other elements need their
#: end tag, else only the tag goes; of a head only the title is text, so that a head may lack its end
#: tag. A tag has a letter, "/", "!" or "?" after its "<"; any other "<" is text.
DROPPED = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style)(?=[\s/>]|\Z).*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(noscript|template|svg|title)(?=[\s/>])(?![^>]*/>).*?</\2(?=[\s/>])[^>]*>"
    r"|<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>|<[/!?][^>]*>",
    re.S | re.I,
)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
#: Elements that end a line.
BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr li main nav ol p pre section table td th tr ul".split()
)
FIELDS = (
    "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string,"
    " content_type string, content_length long, block_digest string, source_payload_digest string, headers string,"
    " block string"
)


def sha1(data: bytes) -> str:
    """A labelled digest as WARC files write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def header(fields: list[tuple[str, str | None]]) -> str:
    """The record's head up to the empty line; fields without a value are left out and line breaks
    in values become spaces."""
    lines = [f"{k}: {' '.join(v.split())}" for k, v in fields if v]
    return END.join([VERSION, *lines]) + END + END


def response_record(key: str, url: str | None, body: str | None) -> bytes:
    """One response record with its HTTP head."""
    payload = (body or "").encode()
    head = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {len(payload)}{END}{END}"
    block = head.encode() + payload
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", named("response", key, url or "")),
        ("WARC-Target-URI", url),
        ("WARC-Date", DATE),
        ("WARC-Block-Digest", sha1(block)),
        ("WARC-Payload-Digest", sha1(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return header(fields).encode() + block


def parsed(record: bytes | None) -> tuple[dict[str, str], str, bytes]:
    """Fields (lower-case names), HTTP head and payload of a record; what is absent is empty."""
    head, _, block = (record or b"").partition(b"\r\n\r\n")
    fields = dict(
        (name.strip().lower(), value.strip())
        for name, colon, value in (x.partition(":") for x in head.decode("utf-8", "replace").split(END)[1:])
        if colon
    )
    size = fields.get("content-length", "")
    block = block[: int(size)] if size.isdecimal() else block
    http, empty_line, payload = block.partition(b"\r\n\r\n")
    if not empty_line:
        http, payload = b"", block
    return fields, http.decode("utf-8", "replace"), payload


def decoded(http: str, payload: bytes) -> str:
    charset = re.search(r"charset=[\"']?([\w.:-]+)", http, re.I)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """The text of a page: scripts, styles and comments dropped, a line for each block element,
    entities resolved, blanks collapsed, empty lines left out."""
    def instead(m: re.Match) -> str:
        return "\n" if (m[3] or "").lstrip("/").lower() in BLOCKS else " " if m[1] or m[2] else ""

    text = DROPPED.sub(instead, page)
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def derived(record: bytes | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    fields, http, payload = parsed(record)
    page = decoded(http, payload)
    source = fields.get("warc-record-id", "")
    digest = fields.get("warc-payload-digest") or sha1(payload)
    ids = {k: named(k, source, digest) for k in ("metadata", "conversion")}
    title = TITLE.search(page)
    about = [
        ("title", html.unescape(title[1]) if title else None),
        ("source-content-type", next((x[13:] for x in http.split(END) if x.lower().startswith("content-type:")), None)),
        ("source-payload-digest", digest),
        ("source-block-digest", fields.get("warc-block-digest")),
        ("source-payload-length", str(len(payload))),
        ("payload-digest-verified", str(digest == sha1(payload)).lower()),
        *((f"http-header-{i}", x) for i, x in enumerate(filter(None, http.split(END)))),
    ]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {' '.join(v.split())}{END}" for k, v in about if v)),
        "conversion": ("text/plain; charset=utf-8", plain_text(page)),
    }
    out = []
    for kind, (content_type, block) in blocks.items():
        raw = block.encode("utf-8", "replace")
        other = ids["conversion" if kind == "metadata" else "metadata"]
        head = header(
            [
                ("WARC-Type", kind),
                ("WARC-Record-ID", ids[kind]),
                ("WARC-Refers-To", source),
                ("WARC-Concurrent-To", other),
                ("WARC-Target-URI", fields.get("warc-target-uri")),
                ("WARC-Date", fields.get("warc-date")),
                ("WARC-Refers-To-Target-URI", fields.get("warc-target-uri")),
                ("WARC-Refers-To-Date", fields.get("warc-date")),
                ("WARC-Block-Digest", sha1(raw)),
                ("Content-Type", content_type),
                ("Content-Length", str(len(raw))),
            ]
        )
        out.append(
            (
                kind,
                ids[kind],
                source or None,
                other,
                fields.get("warc-target-uri"),
                fields.get("warc-date"),
                content_type,
                len(raw),
                sha1(raw),
                digest,
                head,
                raw.decode(),
            )
        )
    return out


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``(key, record)``: each page as a response record. Null urls give a record without a target,
    null pages an empty payload."""

    @F.pandas_udf("binary")
    def record(keys: pd.Series, urls: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series(
            [response_record(k or "", u, b) for k, u, b in zip(keys, urls, bodies)], dtype=object
        )

    return pages.select(key, record(F.col(key).cast("string"), F.col(url), F.col(body)).alias("record"))


def derivatives(records: DataFrame, record: str = "record") -> DataFrame:
    """Two rows for each row of ``records``: its other columns and the fields of ``FIELDS``.

    A null or malformed record gives records with what could be read of it and empty text."""
    kept = [c for c in records.columns if c != record]

    @F.pandas_udf(f"array<struct<{FIELDS.replace(' string', ':string').replace(' long', ':long')}>>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([[dict(zip(NAMES, r)) for r in derived(x)] for x in rows], dtype=object)

    return records.select(*kept, F.explode(both(F.col(record))).alias("made")).select(*kept, "made.*")


NAMES = [f.split()[0] for f in FIELDS.split(",")]


def write_warc(derived_rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """The records as WARC files, one for each partition, in any folder Spark can write to."""
    whole = derived_rows.select(F.concat("headers", "block").alias("value"))
    whole.write.option("lineSep", END + END).option("compression", compression).text(path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and the conversion record of every page."""
    return derivatives(responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
