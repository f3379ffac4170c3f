"""WARC archives with revisit resolution.

``write_archive`` writes one record per row as WARC/1.1, a gzip member a record,
through Spark's own writer, so any file system that Spark knows will do.
``read_headers`` and ``read_records`` stream records back from those files by
their content length.  ``resolve`` shuffles headers only: they are grouped by
payload digest and length, the record with the largest page id of each group is
the response, and the others revisit it.  ``deduplicate`` gives every file of an
archive the list of its own revisits and rewrites it with fresh headers, where
revisit records have no payload; payloads are read and written by the same task
and are never shuffled while the lists of all files are small enough to ship.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from culprit.llm.common import discard, freeing, materialize, remove, shared_dir

#: Compressed bytes of a chunk of records, or one record, and chunks in a file: a task holds a file's compressed bytes.
CHUNK_BYTES, FILE_CHUNKS = 4 << 20, 8
#: Bytes of revisit lists that are shipped to all executors; beyond them, files are joined with their lists.
SHIPPED_BYTES = 32 << 20
#: Compression level of members: the fastest.
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes from which a member's stored length ends with a byte that isn't zero.
_LONG = 1 << 24

_CONTROL = {k: " " for k in (*range(32), 127)}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(headers: dict[str, object], block: bytes) -> bytes:
    """A record; headers without a value are left out, control characters in values become spaces."""
    lines = "".join(f"{k}: {str(v).translate(_CONTROL)}\r\n" for k, v in headers.items() if v is not None)
    return b"".join((b"WARC/1.1\r\n", lines.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"))


def compressed(record: bytes) -> bytes:
    """A record as one gzip member, or several if it is so long that its length would not end with a zero byte."""
    if len(record) < _LONG:
        return gzip.compress(record, LEVEL, mtime=0)
    step = _LONG // 2
    return b"".join(gzip.compress(record[k : k + step], LEVEL, mtime=0) for k in range(0, len(record), step))


def chunked(records: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """Compressed records in chunks, each without its last byte, which is zero and comes from the writer."""
    found, size = [], 0
    for r in records:
        found.append(compressed(r))
        size += len(found[-1])
        if size >= CHUNK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(found)[:-1]], pa.binary())], names=["value"])
            found, size = [], 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(found)[:-1]], pa.binary())], names=["value"])


def _write(chunks: DataFrame, path: str) -> None:
    """The text writer puts out the bytes of its strings as they are, and the zero byte that ends a member after each."""
    chunks.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_CHUNKS).text(path)


def write_archive(pages: DataFrame, path: str) -> None:
    """Write ``page_id, url, html`` rows as response records; null html is an empty payload."""
    archive = uuid.uuid4().hex

    def records(batches):
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for page, url, html in zip(*(b.column(k) for k in range(3)), strict=True):
                block = (html.as_py() or "").encode()
                n += 1
                yield record_of(
                    {
                        "WARC-Type": "response", "WARC-Record-ID": _urn(f"{archive}/{task}/{n}"), "WARC-Date": DATE, "WARC-Target-URI": url.as_py(), "X-Page-Id": page.as_py(),
                        "WARC-Payload-Digest": "sha1:" + base32_sha1(block), "X-Payload-Length": len(block), "Content-Type": "text/html; charset=utf-8",
                    },
                    block,
                )

    _write(pages.select("page_id", "url", "html").mapInArrow(freeing(lambda batches: chunked(records(batches))), "value binary"), path)


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(name.encode()).hexdigest())}>"


def records_in(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one record in memory at a time."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {first[:40]!r}")
        headers = {}
        while line := stream.readline().strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.lower()] = v.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def _opened(content: pa.Scalar) -> BinaryIO:
    return gzip.open(pa.BufferReader(content.as_buffer()))


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), "content")


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers of an archive folder: ``file, ordinal`` in the file, ``record_id``, ``page_id, url, payload_bytes,
    payload_digest, record_type, refers_to``."""
    kinds = {"file": pa.string(), "ordinal": pa.int64(), "record_id": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    names = {pa.string(): "string", pa.int64(): "long"}

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [
                    (
                        file, k, h["warc-record-id"], _number(h.get("x-page-id")), h.get("warc-target-uri"), int(h["x-payload-length"]),
                        h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], _number(h.get("x-refers-to-page-id")),
                    )
                    for k, (h, _) in enumerate(records_in(_opened(content)))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return _files(spark, path).mapInArrow(freeing(run), ", ".join(f"{k} {names[t]}" for k, t in kinds.items()))


def verified(headers: dict[str, str], block: bytes) -> bytes:
    """The block, if it is what the headers say."""
    if headers["warc-type"] != "revisit" and (headers["warc-payload-digest"], headers["x-payload-length"]) != ("sha1:" + base32_sha1(block), str(len(block))):
        raise ValueError(f"payload of record {headers['warc-record-id']} does not have its digest")
    return block


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, record_type, html`` of an archive folder; digests of payloads are verified."""

    def run(batches):
        for b in batches:
            for content in b.column(1):
                for h, block in records_in(_opened(content)):
                    row = (_number(h.get("x-page-id")), h.get("warc-target-uri"), h["warc-type"], verified(h, block).decode())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["page_id", "url", "record_type", "html"])

    return _files(spark, path).mapInArrow(freeing(run), "page_id long, url string, record_type string, html string")


def resolve(headers: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Decide which records are responses: ``headers`` with new type and reference, and record id and address of the original.

    Of the records with equal digest and length, those with the largest page id
    are responses and the rest revisit it; records under ``least_bytes`` and
    those whose whole group has no page id are responses.  The group's largest
    id comes from a partial aggregate, and the join back may be split by Spark,
    so a group of any size needs no task of its own.
    """
    largest = headers.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "record_id", "url")).alias("__to"))
    both = headers.drop("record_type", "refers_to").join(largest, ["payload_digest", "payload_bytes"])
    again = (F.col("payload_bytes") >= least_bytes) & F.col("__to.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__to.page_id"))
    both = both.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("__to", F.when(again, F.col("__to")))
    found = {"refers_to": "page_id", "refers_record": "record_id", "refers_url": "url"}
    return both.select("*", *(F.col(f"__to.{v}").alias(k) for k, v in found.items())).drop("__to")


def deduplicate(spark: SparkSession, path: str, fresh: str, *, least_bytes: int = 0, shipped_bytes: int = SHIPPED_BYTES) -> None:
    """Rewrite the archive in ``path`` to ``fresh``: repeated payloads become revisit records.

    The lists of revisits by file are shipped whole while they have at most
    ``shipped_bytes``; larger ones meet their files' compressed bytes in a join.
    """
    headers = materialize(read_headers(spark, path), "warc-headers")  # read once, though resolution needs them twice
    decided = resolve(headers, least_bytes=least_bytes).where("record_type = 'revisit'")
    lists = decided.groupBy("file").agg(F.collect_list(F.struct("ordinal", "refers_to", "refers_record", "refers_url")).alias("revisits"))
    lists = materialize(lists, "warc-revisits")
    size = lists.agg(F.sum(F.aggregate("revisits", F.lit(0).cast("long"), lambda n, r: n + 80 + F.coalesce(F.octet_length(r["refers_url"]), F.lit(0))))).first()[0] or 0
    hinted = F.broadcast(lists) if size <= shipped_bytes else lists.hint("merge")

    def records(batches):
        for b in batches:
            for content, revisits in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                again = {r["ordinal"]: r for r in revisits or ()}
                for k, (h, block) in enumerate(records_in(_opened(content))):
                    verified(h, block)
                    made = {
                        "WARC-Type": "response", "WARC-Record-ID": h["warc-record-id"], "WARC-Date": DATE, "WARC-Target-URI": h.get("warc-target-uri"), "X-Page-Id": h.get("x-page-id"),
                        "WARC-Payload-Digest": h["warc-payload-digest"], "X-Payload-Length": h["x-payload-length"], "Content-Type": "text/html; charset=utf-8",
                    }
                    if r := again.get(k):
                        made |= {
                            "WARC-Type": "revisit", "WARC-Record-ID": _urn("revisit" + h["warc-record-id"]), "WARC-Profile": PROFILE, "WARC-Refers-To": r["refers_record"],
                            "WARC-Refers-To-Target-URI": r["refers_url"], "WARC-Refers-To-Date": DATE, "X-Refers-To-Page-Id": r["refers_to"],
                        }
                        block = b""
                    yield record_of(made, block)

    joined = _files(spark, path).join(hinted, "file", "left").select("content", "revisits")
    _write(joined.mapInArrow(freeing(lambda batches: chunked(records(batches))), "value binary"), fresh)
    discard(headers, lists)


def archive_and_deduplicate(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, shipped_bytes: int = SHIPPED_BYTES
) -> DataFrame:
    """Write an archive of ``pages``, resolve revisits, write the deduplicated one, read that back.

    Null html is an empty payload, null urls and ids give no such header; a
    control character in a url becomes a space.  Rows that repeat with the same
    id and payload are responses alike, each with a record id of its own.  An
    empty table gives an empty result.  A page of any length is one record; its
    task holds it whole.  Other columns, whatever their names, are ignored.
    Returns ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to``.
    """
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    folder = f"{shared_dir(spark)}/culprit/warc-{uuid.uuid4().hex}"
    write_archive(rows, f"{folder}/all")
    deduplicate(spark, f"{folder}/all", f"{folder}/deduplicated", least_bytes=least_bytes, shipped_bytes=shipped_bytes)
    remove(spark, f"{folder}/all")
    return read_headers(spark, f"{folder}/deduplicated").drop("file", "ordinal", "record_id")
