"""WARC 1.1 archives: one gzip member per record, written and read back.

Writing: payload digests are grouped (map-side partial minimum, so a hot payload is
one row per task), records that repeat an earlier payload become ``revisit`` records
without body.  Each task sorts its records by page and writes archives of about
``ARCHIVE_BYTES`` to the shared folder under a temporary name, renamed when complete;
names and content depend on the partition alone, so a repeated task replaces its
file by the same bytes.

Reading is sequential per archive: the gzip members are inflated incrementally in
small steps, blocks are framed by Content-Length, block and payload digests are
recomputed on the way and compared.  A wrong frame or digest raises.

Defined results: null html is an empty payload; payloads below ``MIN_REVISIT`` bytes
are always responses; null page ids are never referred to (a page whose equals have
no other id is a response); rows repeating a page are records of their own; null urls
are written as ``about:blank``; an empty table gives no archives and no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

MIN_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
_STEP = 1 << 16
# fixed values: identifiers of the WARC 1.1 standard
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", urn)
    if not found:
        raise ValueError(f"not a page's identifier: {urn}")
    return int(found[1]) if found[1] else None


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; ``first`` is the page a revisit refers to, None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if first is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(first)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _inflate(data: memoryview, at: int) -> Iterator[bytes]:
    """Pieces of the gzip member that starts at ``at``; then, as return value, its end."""
    member = zlib.decompressobj(wbits=31)
    while not member.eof:
        if at >= len(data):
            raise ValueError("a gzip member breaks off")
        step = data[at : at + _STEP]
        at += len(step)
        piece = member.decompress(step)
        at -= len(member.unused_data)
        if piece:
            yield piece
    return at


def read_records(data: memoryview) -> Iterator[tuple[dict[str, str], int, str]]:
    """(headers, payload length, payload sha256) of each record of an archive."""
    at = 0
    while at < len(data):
        pieces, end = _inflate(data, at), at
        held = bytearray()

        def more() -> bool:
            nonlocal end
            try:
                held.extend(next(pieces))
                return True
            except StopIteration as stop:
                end = stop.value
                return False

        def until(mark: bytes) -> bytes:
            while (cut := held.find(mark)) < 0:
                if not more():
                    raise ValueError("a record has no end of headers")
            found = bytes(held[:cut])
            del held[: cut + len(mark)]
            return found

        lines = until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"not a record: {lines[0]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        left = int(headers["Content-Length"])
        block_sum, payload_sum = hashlib.sha256(), hashlib.sha256()
        http = until(b"\r\n\r\n") + b"\r\n\r\n"
        block_sum.update(http)
        left -= len(http)
        stated = int(re.search(rb"(?i)\r\nContent-Length: (\d+)\r\n", http)[1])
        size = 0
        while left > 0:
            if not held and not more():
                raise ValueError("a block is shorter than its Content-Length")
            part = bytes(held[:left])
            del held[:left]
            left -= len(part)
            size += len(part)
            block_sum.update(part)
            payload_sum.update(part)
        while more():
            pass
        if bytes(held) != b"\r\n\r\n" or left < 0:
            raise ValueError("a record does not end where its Content-Length says")
        if headers["WARC-Block-Digest"] != f"sha256:{block_sum.hexdigest()}":
            raise ValueError(f"block digest differs in {headers['WARC-Record-ID']}")
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        if headers["WARC-Type"] == "response":
            if digest != payload_sum.hexdigest() or size != stated:
                raise ValueError(f"payload digest differs in {headers['WARC-Record-ID']}")
        yield headers, stated, digest
        at = end


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 4) -> DataFrame:
    """Write all pages below ``folder``; the manifest: archive, records, bytes."""
    payload = F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8")
    wide = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        wide.where(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select(F.col("digest").alias("f_digest"), "first")
    )
    records = wide.join(firsts, wide["digest"] == firsts["f_digest"], "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        part, names, counts, sizes = 0, [], [], []
        open_file, written, n = None, 0, 0

        def close() -> None:
            nonlocal open_file, part
            if open_file is None:
                return
            open_file[0].close()
            store.move(open_file[1], open_file[2])
            names.append(open_file[2])
            counts.append(n)
            sizes.append(written)
            open_file, part = None, part + 1

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if open_file is None:
                    name = f"{root}/part-{task.partitionId():05d}-{part:04d}.warc.gz"
                    held = f"{root}/.{task.partitionId()}-{part}-{task.taskAttemptId()}.tmp"
                    open_file, written, n = (store.open_output_stream(held, compression=None), held, name), 0, 0
                packer = zlib.compressobj(level, wbits=31)
                data = packer.compress(record(*row)) + packer.flush()
                open_file[0].write(data)
                written, n = written + len(data), n + 1
                if written >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            names=["archive", "records", "bytes"],
        )

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    ordered = records.sortWithinPartitions(F.col("page_id").asc_nulls_last(), "digest", "url")
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(run, "archive string, records long, bytes long").write.parquet(manifest)
    return pages.sparkSession.read.schema("archive string, records long, bytes long").parquet(manifest)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of all archives below ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = []
                for headers, size, digest in read_records(memoryview(content.as_buffer())):
                    refers = headers.get("WARC-Refers-To")
                    found.append((_page(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], _page(refers) if refers else None))
                columns = list(zip(*found)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    )
    return files.mapInArrow(run, RESULT)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
