"""WARC archives: a writer, and a splittable reader.

Writing: one record per page, each a gzip member of its own, one file per task. Of pages with equal payloads (of at
least `least_bytes`) the one with the smallest id is a response, the others are revisit records that name it and carry the
HTTP header only. Files go to the shared folder; a task attempt writes under its own name and only the attempts whose
rows arrive are in the manifest, so lost executors leave no half files behind in what is read.

Reading: files are cut into byte ranges, which tasks read on their own. A task looks for gzip magic from the start
of its range, takes a candidate only if it inflates to a WARC header with a length that the record then has, and owns
the records that start inside its range; the last of them may be read beyond its end. Records follow each other, so after the first
the next start is known. Every record has exactly one owner, whatever the range length.

Null html is an empty payload. Equal ids with equal payloads are responses each. Rows without an id: revisits of the smallest id
of their payload, else responses. Other columns play no part; the address is written if there is one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow_rows, written
from touchline.session import checkpoint_dir

MOST_TASKS = 100_000  # of a read; beyond that a task reads several ranges
RANGE = 8 << 20
READ = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    block = _http(size) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Archives of all pages under a folder that all tasks share; the manifest (path, size, records), written too."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    # The first page of each payload; narrow rows, summed up in tasks before the shuffle.
    first = (rows.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1 AND first IS NOT NULL").select(F.col("sha1").alias("s"), F.col("size").alias("z"), "first"))
    marked = rows.join(first, (F.col("sha1") == F.col("s")) & (F.col("size") == F.col("z")), "left").select("page_id", "url", "html", "sha1", "size", "first")

    def archive(source):
        path = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        system, place = _open(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        total, count = 0, 0
        with system.open_output_stream(place, compression=None) as out:
            for page_id, url, html, sha1, size, first in source:
                revisit = first is not None and page_id != first
                data = record(page_id, url, b"" if revisit else html.encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), size, first if revisit else None, revisit)
                out.write(data)
                total, count = total + len(data), count + 1
        yield path, total, count

    return written(arrow_rows(marked, "path string, size long, records long", archive), "manifest")


class _Window:
    """Bytes of a file from some place on, read as they are needed."""

    def __init__(self, handle, size: int, start: int):
        self.handle, self.size, self.start, self.data = handle, size, start, bytearray()

    def more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.handle.seek(at)
        got = self.handle.read(min(READ, self.size - at))
        self.data += got
        return len(got) > 0

    def drop(self, upto: int) -> None:
        """Forget what lies before a place."""
        del self.data[:upto - self.start]
        self.start = upto


def _headers(data: bytes) -> dict[str, str] | None:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        return None
    return dict(part for line in lines[1:] if len(part := line.split(": ", 1)) == 2)


def _member(window: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record that starts at a place of the file, None if none does. Of a candidate that is no record
    little is inflated."""
    inflate, parts, size, place, headers, head = zlib.decompressobj(31), [], 0, at, None, 0
    while not inflate.eof:
        if place - window.start >= len(window.data) and not window.more():
            return None
        chunk = window.data[place - window.start:place - window.start + (4096 if headers is None else READ)]
        try:
            got = inflate.decompress(chunk)
        except zlib.error:
            return None
        place += len(chunk) - len(inflate.unused_data)
        parts.append(got)
        size += len(got)
        if headers is None:
            text = b"".join(parts)
            if not text.startswith(b"WARC/1."[:len(text)]) or size > 1 << 16 and b"\r\n\r\n" not in text:
                return None
            if (head := text.find(b"\r\n\r\n")) >= 0:
                headers = _headers(text[:head])
                if headers is None or not headers.get("Content-Length", "").isdigit():
                    return None
    if headers is None:
        return None
    block = b"".join(parts)[head + 4:]
    length = int(headers["Content-Length"])
    return (headers, block[:length], place) if len(block) == length + 4 and block.endswith(b"\r\n\r\n") else None


def records_in(path: str, size: int, start: int, end: int):
    """(headers, block) of the records that start in start..end of a file."""
    system, place = _open(path)
    with system.open_input_file(place) as handle:
        window, at = _Window(handle, size, start), start
        while at < end:
            found = window.data.find(MAGIC, at - window.start)
            if found < 0:
                at = max(at, window.start + len(window.data) - len(MAGIC) + 1)
                if at >= end or not window.more():
                    return
                continue
            at = window.start + found
            if at >= end:
                return
            window.drop(at)
            got = _member(window, at)
            if got is None:
                at += 1
            else:
                yield got[0], got[1]
                at = got[2]
                window.drop(min(at, window.start + len(window.data)))


def read(manifest: DataFrame, range_bytes: int = RANGE, payloads: bool = False) -> DataFrame:
    """One row per record: page_id, record_type, refers_to, payload_bytes, payload_digest, url, and the payload if asked for (null
    for a revisit). The digest and length of a response are of the payload as read; a revisit tells its response's."""
    ranges = manifest.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    # A range is a few bytes as a row; only a stated number of tasks keeps adaptive execution from joining all ranges into one.
    spread = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)))

    def rows(source):
        number = lambda v: None if v is None else int(v)
        for path, size, start in source:
            for headers, block in records_in(path, size, start, min(size, start + range_bytes)):
                http, _, payload = block.partition(b"\r\n\r\n")
                told = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                revisit = headers.get("WARC-Type") == "revisit"
                if revisit:
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = told
                else:
                    length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                yield (number(headers.get("WARC-Page-ID")), headers.get("WARC-Type"), number(headers.get("WARC-Refers-To-Page-ID")), length, digest,
                       digest == told, headers.get("WARC-Target-URI"), payload if payloads and not revisit else None)

    return arrow_rows(spread, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_holds boolean, "
                              "url string, payload binary", rows)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives and read back: the contract's columns."""
    folder = f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_holds")
