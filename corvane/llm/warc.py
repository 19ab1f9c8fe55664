"""WARC archives written with an index first, and read back by coalesced byte ranges.

Each task writes one archive of gzip members, a record each, and returns the index: file,
offset, length, URL, digest. A record whose payload was seen before is a revisit of the
first. Readers take only index rows: sorted by file and offset, rows that lie near one
another are fetched by one ranged read. Archives lie in the shared folder under names
that hold the attempt, so what a lost or repeated task leaves behind is never indexed.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_IDS, scratch_path, sent, with_row_id, written

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Bytes of one ranged read at most (a longer record is read whole), and the gap that is read over.
READ_BYTES, GAP_BYTES = 4 << 20, 64 << 10
#: Bytes of an archive whose records are read by one task.
SPAN_BYTES = 32 << 20


def _store(folder: str):
    """(file system, path) of a folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(lines: Iterable[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode("utf-8", "replace")


def _one_line(value) -> str:
    return "" if value is None or value != value else "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in str(value))


def record(page_id, url, payload: bytes, digest: str, revisit: bool, refers_to) -> bytes:
    """One record, not yet compressed. A revisit holds no payload but its digest, length and the page it refers to."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", _one_line(page_id)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if revisit:
        lines[2:2] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", _one_line(refers_to))]
    return _header(lines) + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields | {"payload": body.partition(b"\r\n\r\n")[2]}


def _int(value) -> int | None:
    return None if value is None or value != value or value == "" else int(value)


def write_archives(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write (page_id, url, html, revisit, refers_to) rows; returns the index, itself written beside the archives."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        name, out, offset = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, revisit, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["revisit"], batch["refers_to"]):
                    payload = html.encode("utf-8", "replace") if isinstance(html, str) else b""
                    page_id, refers, digest = _int(page_id), _int(refers), _digest(payload)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    packed = packer.compress(record(page_id, url, payload, digest, bool(revisit), refers)) + packer.flush()
                    if out is None:
                        store.create_dir(path)
                        out = store.open_output_stream(posixpath.join(path, name), compression=None)
                    out.write(packed)
                    rows.append((name, offset, len(packed), page_id, url, digest, "revisit" if revisit else "response", refers, len(payload)))
                    offset += len(packed)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return written(pages.select("page_id", "url", "html", "revisit", "refers_to").mapInPandas(write, INDEX), "warc-index")


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, rows) of reads that cover (offset, length) rows sorted by offset."""
    start, end, held = 0, 0, []
    for i, (offset, length) in enumerate(rows):
        if held and (offset - end > GAP_BYTES or offset + length - start > READ_BYTES):
            yield start, end, held
            held = []
        if not held:
            start = end = offset
        held.append(i)
        end = max(end, offset + length)
    if held:
        yield start, end, held


def read_archives(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of (selected) index rows, read and checked against their digests.

    Raises where a stored payload does not have the digest of its record.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        file, name = None, None
        for batch in batches:
            for at in batch.groupby("file", sort=False).indices.items():
                if at[0] != name:
                    if file is not None:
                        file.close()
                    file, name = store.open_input_file(posixpath.join(path, at[0])), at[0]
                place = list(zip(batch["offset"].to_numpy()[at[1]].tolist(), batch["length"].to_numpy()[at[1]].tolist()))
                for start, end, held in _ranges(place):
                    file.seek(start)
                    data = file.read(end - start)
                    rows = []
                    for i in held:
                        offset, length = place[i]
                        fields = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                        payload, digest = fields["payload"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and _digest(payload) != digest:
                            raise ValueError(f"payload of {name} at {offset} is not what its digest says")
                        rows.append((_int(fields["X-Page-ID"]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], _int(fields.get("X-Refers-To-Page")), payload if with_payload else None))
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if file is not None:
            file.close()

    spans = index.select("file", "offset", "length", F.floor(F.col("offset") / SPAN_BYTES).alias("span"))
    # So many tasks as there are spans: an index is small, and would be read by one task where partitions are merged by size.
    n = 1 + (index.agg(F.sum("length")).first()[0] or 0) // SPAN_BYTES
    return spans.repartition(n, "file", "span").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInPandas(read, READ)


def payload_key(html: Column) -> Column:
    return F.sha1(F.encode(F.coalesce(html, F.lit("")), "UTF-8"))


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(row_id, refers_to) of rows whose payload another row has that comes first: the least page_id, then the row id.

    ``pages`` has row_id, page_id (null last) and html. Payloads under ``least_bytes`` are never revisits.
    """
    sums = pages.select("row_id", "page_id", payload_key(F.col("html")).alias("payload"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= least_bytes)
    sums = written(sums.select("row_id", "page_id", "payload"), "payloads")
    first = sums.groupBy("payload").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return written(sums.join(first, "payload").where("row_id != first.row_id").select("row_id", F.col("first.page_id").alias("refers_to")), "revisits")


def archive(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Archive every row and return the index. Page ids are integers.

    Null html is an empty payload, a null URL an empty one; null pages and repeated rows are
    records of their own; equal payloads of ``least_bytes`` or more refer to the first. No rows: an empty index.
    """
    rows = with_row_id(pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    seen = revisits(rows, least_bytes).withColumn("revisit", F.lit(True))
    marked = rows.join(sent(seen, BROADCAST_IDS), "row_id", "left").withColumn("revisit", F.coalesce("revisit", F.lit(False)))
    return write_archives(marked, folder)


def archive_folder(spark) -> str:
    return scratch_path(spark, "warc")
