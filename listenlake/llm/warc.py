"""WARC archives with revisit resolution.

Headers (payload digest, length, page id, URL) are shuffled by digest without payloads; the smallest page id of a digest is the
original response, and the others are joined to it as revisits. Revisit records are made of headers alone. Payloads stay
where they were scanned: rows that revisit are taken out by a broadcast of their keys, if a count shows that they are few;
beyond that Spark joins them by a shuffle.

Tasks put files together: a warcinfo record, then records with fresh headers, each a gzip member of its own, so that one record
can be read alone at its offset. A file closes once it holds a bounded number of bytes. Spark's text sink writes each file's
bytes; its names end in .txt, and its line separator is a zero byte, the padding that gzip readers skip.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from listenlake.runtime import discard, materialize, ship_package

#: Bytes of records, before compression, after which a file closes: bounds what a reader holds at once. A longer record is alone.
FILE_BYTES = 16 << 20
#: Keys (page id and digest, about 70 bytes each) of revisits up to which they are broadcast.
BROADCAST_KEYS = 250_000
#: The end of a header line and of a record, the profile of a revisit.
EOL, END = "\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, "
    "payload binary, file string, offset long, length long"
)
_FIELDS = ("page_id", "url", "date", "sha", "bytes", "html", "of_page", "of_url", "of_date")


def base32(sha: str) -> str:
    """A hexadecimal SHA-1 digest in upper-case base 32."""
    return base64.b32encode(bytes.fromhex(sha)).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    lines = "".join(f"{k}: {' '.join(v.split())}{EOL}" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(f"WARC/1.1{EOL}{lines}{EOL}".encode() + block + END, 6, mtime=0)


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(' '.join(map(str, parts)).encode()).hexdigest())}>"


def _page_record(r: dict) -> tuple[bytes, int]:
    """A page's record, and its bytes before compression."""
    page, digest = "" if r["page_id"] is None else str(r["page_id"]), base32(r["sha"])
    revisit = r["of_page"] is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page, r["sha"], r["url"])),
        ("WARC-Date", r["date"]),
        ("WARC-Target-URI", r["url"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page", page),
        ("X-Payload-Length", str(r["bytes"])),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", _urn(r["of_page"], r["sha"], r["of_url"])),
            ("WARC-Refers-To-Target-URI", r["of_url"]),
            ("WARC-Refers-To-Date", r["of_date"]),
            ("X-Refers-To-Page", str(r["of_page"])),
        ]
        block = b""
    else:
        payload = r["html"].encode()
        http = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: {len(payload)}{EOL}{EOL}"
        block = http.encode() + payload
    return _record(headers, block), len(block) + 600


def _files(date: str):
    """Rows of _FIELDS to rows (value): the bytes of one archive each."""

    def run(batches):
        info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("info", date)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        parts, held = [], 0
        close = lambda: pa.record_batch([pa.array([b"".join([info, *parts])], pa.binary())], names=["value"])
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                member, size = _page_record(dict(zip(_FIELDS, row, strict=True)))
                if parts and held + size > FILE_BYTES:
                    yield close()
                    parts, held = [], 0
                parts.append(member)
                held += size
        if parts:
            yield close()

    return run


def write_warc(
    pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-31T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None
) -> None:
    """Write a record for each row to WARC files at ``path``.

    Of rows with equal payloads (UTF-8 of ``html_col``; null: empty) of ``least`` bytes or more the smallest id is a
    response and the others revisit it; of that id's repeated rows each is a response. Shorter payloads are all
    responses, and so are rows without an id. Headers are fresh: record ids derive from page id, digest and URL; ``date_col``
    gives the time of capture, ``date`` stands where there is none. Null URLs are empty. Other columns are ignored; an empty
    table gives an archive without records.
    """
    spark = pages.sparkSession
    ship_package(spark)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    captured = F.coalesce(F.col(date_col).cast("string"), F.lit(date)) if date_col else F.lit(date)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), captured.alias("date"),
        F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).cast("long").alias("bytes"), html.alias("html"),
    )
    heads = rows.drop("html").where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    # Written, a row a digest, so that a hot payload's rows can be split in the join.
    origins = materialize(heads.groupBy("sha").agg(F.min(F.struct("page_id", "url", "date")).alias("origin")), "warc-origins")
    found = heads.join(origins, "sha").where(F.col("page_id") > F.col("origin.page_id"))
    found = found.select(*_FIELDS[:5], F.lit(None).cast("string").alias("html"), F.col("origin.page_id").alias("of_page"), F.col("origin.url").alias("of_url"), F.col("origin.date").alias("of_date"))
    revisits = materialize(found, "warc-revisits")
    discard(origins)
    gone = revisits.select("page_id", "sha").distinct()
    responses = rows.join(F.broadcast(gone) if revisits.count() <= BROADCAST_KEYS else gone, ["page_id", "sha"], "left_anti")
    none = {"of_page": F.lit(None).cast("long"), "of_url": F.lit(None).cast("string"), "of_date": F.lit(None).cast("string")}
    records = responses.withColumns(none).select(*_FIELDS).union(revisits.select(*_FIELDS))
    files = records.mapInArrow(_files(date), "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    discard(revisits)


def members(raw) -> list[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member of an archive; padding of zero bytes ends it."""
    raw, at, out = memoryview(raw), 0, []
    while at < len(raw) and raw[at] != 0:
        d, parts, to = zlib.decompressobj(31), [], at
        while not d.eof:  # piece by piece, as what follows the member is copied
            if to >= len(raw):
                raise ValueError(f"the member at {at} is cut off")
            parts.append(d.decompress(raw[to : to + (1 << 15)]))
            to = min(to + (1 << 15), len(raw))
        end = to - len(d.unused_data)
        out.append((at, end - at, b"".join(parts)))
        at = end
    return out


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    stop = data.index(END)
    version, *lines = data[:stop].decode().split(EOL)
    if version != "WARC/1.1":
        raise ValueError(f"no record: {version[:40]}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.removesuffix(":"), "") for x in lines)
    start = stop + 4
    end = start + int(headers["Content-Length"])
    if data[end:] != END:
        raise ValueError("a record does not end where its Content-Length says")
    return headers, data[start:end]


def _records(batches):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64())
    names = [x.split(" ")[0] for x in _READ.split(", ")]
    for b in batches:
        for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows = []
            for offset, length, data in members(content.as_buffer()):
                h, block = parse_record(data)
                kind = h["WARC-Type"]
                if kind == "warcinfo":
                    continue
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = block[block.index(END) + 4 :] if kind == "response" else None
                if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"page {h['X-Page']}: payload and digest differ")
                number = lambda k: int(h[k]) if h.get(k) else None  # noqa: B023, E731
                rows.append((number("X-Page"), number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page"), h["WARC-Target-URI"], payload, file, offset, length))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The page records of the WARC files at ``path``, one row each, with their place; payloads are checked against their digests."""
    ship_package(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(_records, _READ)
