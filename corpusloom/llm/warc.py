"""WARC archives: writer, and a reader that splits compressed archives.

Writer: each record is a gzip member of its own. Spark's text sink puts the bytes into
the files of a folder that all executors share; the sink ends every row with a line
separator, so the separator is the last byte of each member (a zero, the top byte of
its length) and the member is handed over without it.

Reader: the files' lengths are listed, cut into byte ranges and dealt to tasks. A task
looks for the gzip magic in its range, takes a candidate for a record only if the
member's first bytes decode to a WARC header, and owns the records that start inside
the range, reading beyond its end where a record does. Ranges need no index and no
agreement between tasks.

Of the pages with equal payloads the one with the largest id is the response and the
others are revisits that refer to it.

Defined results: a null payload counts as empty; empty payloads are equal payloads. A
page without an id is a response of its own and never referred to. Rows that repeat the
largest id of their payload are responses. A null url becomes a urn of the page.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import by_value, chunks, table
from corpusloom.session import lookup_join, staging_root

by_value(__name__)

SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


# Writing ---------------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """An uncompressed WARC record: HTTP header, and the payload of a response."""
    name = "none" if page is None else str(page)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{name}"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """``raw`` as a gzip member that ends with a zero byte. The top byte of the length
    of a larger record is no zero; an empty member follows it then."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(raw) + packer.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _members(batches):
    for batch in chunks(batches, column=2):
        rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([member(record(page, url, (html or "").encode(), to))[:-1] for page, url, html, to in rows], pa.binary())],
            names=["member"],
        )


def write_warc(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as compressed WARC records under ``path``."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").withColumn(
        "_digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    )
    # Digests are counted map-side first; only those with several pages are looked up.
    groups = (
        rows.filter("page_id is not null").groupBy("_digest")
        .agg(F.max("page_id").alias("_keeper"), F.min("page_id").alias("_least"))
        .filter("_keeper > _least").drop("_least")
    )
    told = lookup_join(rows, groups, ["_digest"])
    refers = F.when(F.col("page_id") < F.col("_keeper"), F.col("_keeper"))
    (
        told.select("page_id", "url", "html", refers.alias("refers"))
        .mapInArrow(_members, "member binary")
        .select(F.col("member").cast("string"))
        .write.option("lineSep", "\0").text(path)
    )


# Reading ---------------------------------------------------------------------


class _Range:
    """Bytes of a file from ``start`` on, read in steps and kept only while needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.at, self.size, self.data = file, start, size, b""

    def more(self) -> bool:
        end = self.at + len(self.data)
        if end >= self.size:
            return False
        self.file.seek(end)
        read = self.file.read(min(READ_BYTES, self.size - end))
        self.data += read
        return bool(read)

    def drop(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n


def _is_record(data: bytes) -> bool:
    """The bytes begin a gzip member whose content begins like a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def range_records(file, start: int, end: int, size: int):
    """Content of each record that starts in [start, end) of an archive."""
    window = _Range(file, start, size)
    while window.at < end:
        found = window.data.find(MAGIC)
        if found < 0:
            window.drop(max(0, len(window.data) - len(MAGIC) + 1))
            if not window.more():
                return
            continue
        window.drop(found)
        if window.at >= end:
            return
        while len(window.data) < 512 and window.more():
            pass
        if not _is_record(window.data[:512]):
            window.drop(1)
            continue
        unpacker, parts = zlib.decompressobj(31), []
        try:
            while True:
                parts.append(unpacker.decompress(window.data))
                if unpacker.eof:
                    window.drop(len(window.data) - len(unpacker.unused_data))
                    break
                window.drop(len(window.data))
                if not window.more():
                    raise ValueError(f"record cut off at the end of the archive, byte {size}")
        except zlib.error as error:
            raise ValueError(f"damaged record before byte {window.at}: {error}") from error
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Fields of a record: its header, and the payload behind the HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^Content-Length: *(\d+)", http)
    return {"fields": fields, "payload": payload, "payload_bytes": int(length[1]) if length else len(payload)}


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


_SCHEMA = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint"
)


def _read(batches, with_payload: bool):
    from pyarrow import fs

    names = [c.split()[0] for c in _SCHEMA.split(", ")] + (["payload"] if with_payload else [])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows):
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    systems: dict = {}
    for ranges in batches:
        for path, size, start, end in zip(*(ranges.column(i).to_pylist() for i in range(4))):
            scheme = path.partition("://")[0]
            if scheme not in systems:
                systems[scheme] = fs.FileSystem.from_uri(path)[0]
            name = fs.FileSystem.from_uri(path)[1] if scheme == "file" else path.partition("://")[2]
            rows, held = [], 0
            with systems[scheme].open_input_file(name) as file:
                for raw in range_records(file, start, end, size):
                    found = parse(raw)
                    fields, payload = found["fields"], found["payload"]
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and digest(payload) != stated:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
                    rows.append(
                        (
                            _page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], found["payload_bytes"],
                            stated, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")),
                            *([payload] if with_payload else []),
                        )
                    )
                    held += len(payload) if with_payload else 0
                    if len(rows) >= 5000 or held > READ_BYTES * 4:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def read_warc(spark, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])
    of every record in the files under ``path``."""
    # Only names and lengths: the content column is not read.
    files = (
        spark.read.format("binaryFile").load(path)
        .select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length").filter("length > 0")
    )
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint")))
    ranges = files.select("path", "length", starts.alias("start")).withColumn(
        "end", F.least(F.col("start") + split_bytes, F.col("length"))
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "path", "start").mapInArrow(
        lambda batches: _read(batches, with_payload), _SCHEMA + (", payload binary" if with_payload else "")
    )


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{staging_root(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, with_payload=False).drop("url")


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((strpos('0123456789abcdef', substr(h, (5 * i // 4 + 1)::INT, 1)) - 1) * 16
           + greatest(strpos('0123456789abcdef', substr(h || '0', (5 * i // 4 + 2)::INT, 1)) - 1, 0))
          // (CASE 5 * i % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END) % 32 + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN g USING (h)
"""
