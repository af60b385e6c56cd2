"""WARC records in ZIP-packaged archives: writing, and reading by ranges.

An archive is a ZIP file with two stored members: records, each compressed by
itself, and an index line per record with its place. Equal payloads from
``REVISIT_BYTES`` on are written once; other rows get a revisit record that
names the row which has the payload and carries its digest and length.

Defined results: a null page is an empty payload; a page of any length is one
record; rows with a null id come after others where the smallest id counts; of
repeated rows with one id the first by file (its hash) and place is the response;
other columns, whatever their names, are ignored; an empty table has no archives.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import ROW_KEY, spread_join, with_row_key, work_dir, written
from .zip_range import Ranges, Writing, ZipError, data_at, members

REVISIT_BYTES = 100
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed value: no page has a date, so that archives are reproducible.
DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record (an HTTP message), or a revisit record without payload."""
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    own = json.dumps(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own} {url}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Page-ID: {own}",
        f"Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {json.dumps(url)[1:-1]}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ZipError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def write_archive(uri: str, attempt: str, records: Iterator[tuple[str, bytes]]) -> None:
    """Stream records into the first member and their places into the second."""
    out, index, at = Writing(uri, attempt), [], 0
    with zipfile.ZipFile(out.file, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(_entry(RECORDS), "w", force_zip64=True) as member:
            for key, raw in records:
                packed = gzip.compress(raw, 1, mtime=0)
                member.write(packed)
                index.append(json.dumps({"page": key, "offset": at, "length": len(packed)}))
                at += len(packed)
        z.writestr(_entry(INDEX), "\n".join(index))
    out.commit()


def _entry(name: str) -> zipfile.ZipInfo:
    return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of an archive, by its index, in ranges of the stored member."""
    with Ranges(uri) as file:
        by_name = {m.name: m for m in members(file)}
        at = data_at(file, by_name[INDEX])
        lines = file.read(at, by_name[INDEX].size).decode().split("\n") if by_name[INDEX].size else []
        start, size = data_at(file, by_name[RECORDS]), by_name[RECORDS].size
        for line in lines:
            place = json.loads(line)
            if place["offset"] + place["length"] > size:
                raise ZipError("the index points outside the records")
            yield parsed(zlib.decompress(file.read(start + place["offset"], place["length"]), 31))


def _marked(pages: DataFrame, page_id: str, base: str) -> DataFrame:
    """Each row's key with its digest and, if another row has the payload, whose."""
    html = F.coalesce(F.col("html"), F.lit("").cast("binary"))
    first = F.struct(F.col(page_id).isNull().alias("no_id"), F.col(page_id).alias("id"), F.col(ROW_KEY).alias("at"))
    keys = pages.select(first.alias("entry"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    keys = written(keys.where(F.col("n") >= REVISIT_BYTES).select("entry", "digest"), f"{base}/digests")
    large = written(keys.groupBy("digest").agg(F.min("entry").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"), f"{base}/repeated")
    joined = spread_join(keys, large.drop("n"), "digest", large.select("digest", "n"), "entry")
    return joined.where(F.col("entry") != F.col("keep")).select(F.col("entry.at").alias(ROW_KEY), F.col("keep.id").alias("refers_to"), F.lit(True).alias("revisit"))


def archived(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = 32 << 20, folder: str | None = None) -> DataFrame:
    """Write archives of about ``archive_bytes`` of payload; a row for each: ``path, records``."""
    spark = df.sparkSession
    base = folder or work_dir(spark, "warc")
    pages = with_row_key(df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html")))
    revisits = written(_marked(pages, "page_id", base), f"{base}/revisits")
    rows = pages.join(revisits, ROW_KEY, "left").select("page_id", "url", "html", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task, attempt = context.partitionId(), f"{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        left = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        row, number = next(left, None), 0
        while row is not None:
            uri, count = f"{base}/archives/part-{task:05d}-{number:05d}.wacz", 0

            def some() -> Iterator[tuple[str, bytes]]:
                nonlocal row, count
                size = 0
                while row is not None and (not count or size + len(row[2] or b"") <= archive_bytes):
                    page, address, payload, refers_to, revisit = row
                    payload = payload or b""
                    size, count = size + len(payload), count + 1
                    digest = hashlib.sha256(payload).hexdigest()
                    yield json.dumps(page), record(page, address, payload, digest, json.dumps(refers_to) if revisit else None)
                    row = next(left, None)

            write_archive(uri, attempt, some())
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([count], pa.int64())], names=["path", "records"])

    return written(rows.mapInArrow(write, "path string, records long"), f"{base}/list")


RESULT = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
#: Tasks that read archives at most; one reads several then.
READERS = 10_000


def read_archives(archives: DataFrame, id_type: T.DataType = T.LongType()) -> DataFrame:
    """A row for each record of the archives listed in ``path``, a written table; payloads are checked against their digests.

    ``id_type`` is that of the page ids, a number or a string.
    """
    own = pa.string() if isinstance(id_type, T.StringType) else pa.int64()
    kinds = [own, pa.int64(), pa.string(), pa.string(), own]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(RESULT, [id_type, T.LongType(), T.StringType(), T.StringType(), id_type], strict=True)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(5)]
        return pa.RecordBatch.from_arrays([c.cast(pa.int32()) if isinstance(id_type, T.IntegerType) and k in (0, 4) else c for k, c in enumerate(columns)], names=list(RESULT))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[tuple] = []
                for headers, payload in read_records(path):
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    n, refers_to = int(headers["Payload-Length"]), None
                    if kind == "response":
                        n, found = len(payload), hashlib.sha256(payload).hexdigest()
                        if found != digest:
                            raise ZipError(f"{path}: a payload doesn't have its digest")
                    else:
                        refers_to = json.loads(headers["Refers-To-Page-ID"])
                    out.append((json.loads(headers["Page-ID"]), n, digest, kind, refers_to))
                    if len(out) == 8192:
                        yield batch_of(out)
                        out = []
                yield batch_of(out)

    # an explicit number, which adaptive execution leaves alone: paths are tiny, archives are not
    tasks = max(1, min(READERS, archives.count()))
    return archives.select("path").repartition(tasks).mapInArrow(read, schema)
