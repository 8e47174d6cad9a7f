"""WARC derivative builder: response records become linked metadata and plain-text conversion records.

Each response record yields a ``metadata`` record (a JSON block with the source's
WARC headers, its HTTP status and headers, the page's title and links) and, where
its payload is text, a ``conversion`` record (the plain text). Both name the source
in WARC-Refers-To, WARC-Refers-To-Target-URI and WARC-Refers-To-Date, repeat its
payload and block digests, and carry digests of their own. Record ids are name-based,
so a run repeated after a failure gives the same records.

Digests are ``sha256:`` and lowercase hex of the block's or payload's bytes.

Edge cases: a null page or URL is empty; a response whose block is not HTTP yields
a metadata record that says so and no conversion record; chunked, gzip and deflate
payloads are decoded, broken ones leave ``payload_error``; unknown charsets fall
back to UTF-8 with replacement; repeated rows give repeated records with the same
ids; empty tables give empty results; extra columns are ignored. Nothing is cut.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_extract import _REST as REST
from .html_extract import BLOCKS, without_unseen

DATE = "2020-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122

RECORD_FIELDS = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, payload_digest string, source_block_digest string, source_payload_digest string, headers array<struct<name: string, value: string>>, block binary"

_TITLE = re.compile(r"<title(?=[\s/>])[^>]*>(.*?)</title(?=[\s/>])", re.S | re.I)
_BREAK = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS, key=len, reverse=True)) + r")(?=[\s/>])" + REST, re.S | re.I)
_MARKUP = re.compile(r"<[a-zA-Z/!?]" + REST, re.S)
_LINK = re.compile(r"<(a|area|link|img|script|iframe|source)(?=[\s/])[^>]*?\s(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S | re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table of pages: page_id, record_id, target_uri, date, block, block_digest, payload_digest."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("_body").cast("string"), F.lit("\r\n\r\n"))
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select("page_id", url.alias("target_uri"), body.alias("_body")).withColumn("block", F.concat(F.encode(head, "UTF-8"), F.col("_body")))
    name = F.sha2(F.concat_ws("\n", F.col("target_uri"), F.lit(date), F.sha2("_body", 256)), 256)
    dashed = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4))), F.concat(F.lit("8"), F.substring(name, 14, 3)), F.concat(F.lit("8"), F.substring(name, 18, 3)), F.substring(name, 21, 12))
    return rows.select(
        "page_id",
        F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        "block",
        F.concat(F.lit("sha256:"), F.sha2("block", 256)).alias("block_digest"),
        F.concat(F.lit("sha256:"), F.sha2("_body", 256)).alias("payload_digest"),
    )


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes] | None:
    """(status line, headers, raw body) of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not gap or not lines[0].startswith("HTTP/"):
        return None
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and headers:  # a folded header
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, body


_CHUNK_SIZE = re.compile(rb"[0-9A-Fa-f]{1,16}")


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        digits = body[at:eol].split(b";")[0].strip()
        if not _CHUNK_SIZE.fullmatch(digits):
            raise ValueError("a chunk has no size")
        size = int(digits, 16)
        if not size:
            return b"".join(out)
        if eol + 2 + size > len(body):
            raise ValueError("a chunk is cut off")
        out.append(body[eol + 2 : eol + 2 + size])
        at = eol + 4 + size


def payload(headers: list[tuple[str, str]], body: bytes) -> tuple[bytes, str | None]:
    """Decoded body, and what went wrong."""
    by = {k.lower(): v.lower() for k, v in headers}
    try:
        if "chunked" in by.get("transfer-encoding", ""):
            body = _unchunked(body)
        for coding in reversed([c.strip() for c in by.get("content-encoding", "").split(",")]):
            if coding in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif coding == "deflate":
                body = zlib.decompress(body) if body[:1] == b"\x78" else zlib.decompress(body, -15)
        return body, None
    except (ValueError, OSError, EOFError, zlib.error) as e:
        return body, f"{type(e).__name__}: {e}"


def decoded(content_type: str, body: bytes) -> str:
    m = _CHARSET.search(content_type) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except (LookupError, ValueError):  # an unknown name, or a codec that is no charset of texts
        return body.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """All visible text: a line for each block, blanks collapsed."""
    text = _MARKUP.sub("", _BREAK.sub("\n", without_unseen(page, " ")))
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _record(source: dict, kind: str, content_type: str, block: bytes) -> tuple:
    name = uuid.uuid5(_NAMESPACE, f"{kind} {source['record_id']} {source['block_digest']}")
    digest = _digest(block)
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", source["date"]),
        ("WARC-Target-URI", source["target_uri"]),
        ("WARC-Refers-To", source["record_id"]),
        ("WARC-Refers-To-Target-URI", source["target_uri"]),
        ("WARC-Refers-To-Date", source["date"]),
        ("WARC-Source-Block-Digest", source["block_digest"]),
        ("WARC-Source-Payload-Digest", source["payload_digest"]),
        ("WARC-Block-Digest", digest),
        ("WARC-Payload-Digest", digest),
        ("Content-Type", content_type),
        ("Content-Length", str(len(block))),
    ]
    own = f"<urn:uuid:{name}>"
    return (source["page_id"], kind, own, source["record_id"], source["target_uri"], content_type, len(block), digest, digest, source["block_digest"], source["payload_digest"], [{"name": k, "value": v} for k, v in headers], block)


def derivatives(source: dict) -> Iterator[tuple]:
    """The records that one response yields."""
    envelope = {"WARC-Type": "response", "WARC-Record-ID": source["record_id"], "WARC-Target-URI": source["target_uri"], "WARC-Date": source["date"], "WARC-Block-Digest": source["block_digest"], "WARC-Payload-Digest": source["payload_digest"], "Content-Length": len(source["block"])}
    about: dict = {"warc": envelope}
    parsed, text = parse_http(source["block"]), None
    if parsed is None:
        about["error"] = "the block is not an HTTP response"
    else:
        status, headers, raw = parsed
        body, wrong = payload(headers, raw)
        kind = next((v for k, v in headers if k.lower() == "content-type"), "")
        about["http"] = {"status": status, "headers": [list(h) for h in headers]}
        about["payload_length"] = len(body)
        if wrong:
            about["payload_error"] = wrong
        elif "html" in kind.lower():
            page = decoded(kind, body)
            title = _TITLE.search(page)
            about["title"] = " ".join(html.unescape(title[1]).split()) if title else None
            about["links"] = [{"element": m[1].lower(), "url": _joined(source["target_uri"], html.unescape(m[3] or m[4] or m[5] or ""))} for m in _LINK.finditer(page)]
            text = plain_text(page)
        elif kind.lower().startswith("text/"):
            text = decoded(kind, body)
    yield _record(source, "metadata", "application/json", json.dumps(about, ensure_ascii=False).encode())
    if text is not None:
        yield _record(source, "conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))


def _joined(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of ``records`` (the columns of ``responses``); no shuffle."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in re.sub(r"<[^>]*(?:<[^>]*>)?[^>]*>", "", RECORD_FIELDS).split(", ")]
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512].to_dict("records")
                rows = [r for source in part for r in derivatives(source | {"block": bytes(source["block"]), "page_id": None if pd.isna(source["page_id"]) else int(source["page_id"])})]
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    return records.select("page_id", "record_id", "target_uri", "date", "block", "block_digest", "payload_digest").mapInPandas(build, RECORD_FIELDS)


def serialised(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as bytes."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record in the bytes of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record starts at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = [(k, v.strip()) for k, _, v in (line.partition(":") for line in data[at:end].decode().split("\r\n")[1:])]
        size = int(next(v for k, v in headers if k.lower() == "content-length"))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def with_bytes(records: DataFrame) -> DataFrame:
    """``records`` with ``record``: each one serialised, ready to be written one after another."""
    head = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")
    return records.withColumn("record", F.concat(F.encode(F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n")), "UTF-8"), F.col("block"), F.encode(F.lit("\r\n\r\n"), "UTF-8")))
