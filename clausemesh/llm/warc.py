"""WARC archives: from one gzip stream for each file to one gzip member for each record, with an offset index.

Writing: Spark's text writer makes each archive as one gzip stream of records (a record ends with two line breaks, which
is the writer's line separator). Files are bounded by a number of records. The writer's commit protocol keeps the
archives whole when tasks are lost or run twice.

Normalising: every archive is inflated once, from begin to end; its records are cut by Content-Length and each is
compressed as a member of its own, whose offset and length go to the sidecar index. Members are kept as rows (archive,
offset, bytes), and written out again by the text writer, whose rows are raw bytes: a member always ends with a zero
byte (the high byte of its length, see `_member`), which serves as line separator, so a file is exactly its members one
after the other and any WARC reader can read it, from the front or by offset.

Reading: archives are walked member by member, and every record has to be where the index lists it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import small_batches

MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 2000
_END = b"\r\n\r\n"
_INDEX = "archive string, record_id string, offset long, length long"
_MEMBERS = "archive string, record_id string, offset long, length long, member binary"


def capture_plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Among rows of equal payloads of MIN_REVISIT_BYTES bytes or more the smallest page_id is the response (each of its
    rows, if it occurs several times), the others revisit it; a group of null ids only is all response. A null html is
    an empty payload.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    named = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = F.col("payload_bytes") >= MIN_REVISIT_BYTES
    kinds = pages.select(F.col(id_col).cast("long").alias("page_id"), payload.alias("payload"))
    kinds = kinds.where(F.length("payload") >= MIN_REVISIT_BYTES).groupBy(F.sha2("payload", 256).alias("payload_digest"))
    first = kinds.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # as a table its size is known: payloads are shuffled only if it is too large to be sent to the tasks
    place = fresh_path(pages.sparkSession, "repeated-payloads")
    first.write.parquet(place)
    rows = named.join(pages.sparkSession.read.schema("payload_digest string, first long").parquet(place), "payload_digest", "left")
    revisit = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record_text(date: str) -> Column:
    """A WARC/1.1 record without its closing line breaks, from the columns of capture_plan()."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    is_response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(is_response, F.col("payload").cast("string")).otherwise(""))
    target = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("about:blank"))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(is_response, "").otherwise(F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", profile))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(http).cast("string")),
        F.lit("\r\n"),
        http,
    )


def write_archives(plan: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", records: int = RECORDS_PER_FILE) -> None:
    """Archives of at most `records` records below path, each one gzip stream."""
    out = plan.select(record_text(date).alias("value"))
    out.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(path)


def _member(record: bytes, level: int = 6) -> bytes:
    """A gzip member. Its last byte is the high byte of the record's length, zero below 16 MiB; a longer record is
    followed by an empty member, so that the result always ends with a zero byte."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    return out if out[-1] == 0 else out + _member(b"")


_EMPTY = _member(b"")


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(data: bytes, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and bytes of every record of a gzip file of one or many members, inflated piece by piece."""
    stream, buffer, at = zlib.decompressobj(31), bytearray(), 0
    need = None
    while True:
        while True:
            if need is None:
                cut = buffer.find(_END)
                if cut < 0:
                    break
                head = _headers(bytes(buffer[:cut]))
                need = cut + 4 + int(head["content-length"]) + 4
            if len(buffer) < need:
                break
            yield head, bytes(buffer[:need])
            del buffer[:need]
            need = None
        if stream.eof:
            rest = stream.unused_data
            if rest:
                stream = zlib.decompressobj(31)
                buffer += stream.decompress(rest)
                continue
            if at >= len(data):
                break
            stream = zlib.decompressobj(31)
        if at >= len(data):
            break
        buffer += stream.decompress(data[at : at + size])
        at += size
    if buffer:
        raise ValueError("the archive ends inside a record")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("member", pa.binary())])
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            name, offset, rows = re.sub(r"\W+", "_", path.as_py().rpartition("/")[2].partition(".")[0]), 0, []
            for head, record in records(content.as_py()):
                member = _member(record)
                rows.append((name, head["warc-record-id"], offset, len(member), member))
                offset += len(member)
                if len(rows) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite the gzip archives below source: `target/archives/archive=NAME/*` with one member for each record, and
    `target/index`, the sidecar (archive, record_id, offset, length)."""
    cut_members(spark, source, target)
    write_members(spark, target)


def cut_members(spark: SparkSession, source: str, target: str) -> None:
    """The first half of normalise(): inflate every archive once, and keep its records as members in `target/members`."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # an archive at a time
    try:
        members = _files(spark, source, "*.gz").select("path", "content").mapInArrow(_members, _MEMBERS)
        members.write.parquet(f"{target}/members")
    finally:
        small_batches(spark)


def write_members(spark: SparkSession, target: str) -> None:
    """The second half of normalise(): archives and index from `target/members`."""
    kept = spark.read.schema(_MEMBERS).parquet(f"{target}/members")
    kept.drop("member").write.parquet(f"{target}/index")
    raw = kept.select("archive", "offset", F.substring("member", 1, F.length("member") - 1).cast("string").alias("value"))
    raw = raw.repartition(F.col("archive")).sortWithinPartitions("archive", "offset").drop("offset")
    raw.write.partitionBy("archive").option("compression", "none").option("lineSep", "\u0000").text(f"{target}/archives")


def members(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and bytes of the records of an archive of one member for each record."""
    at = 0
    while at < len(data):
        stream, parts, size = zlib.decompressobj(31), [], 0
        while not stream.eof and at + size < len(data):  # in pieces, as what lies behind a member is copied
            piece = data[at + size : at + size + (1 << 14)]
            parts.append(stream.decompress(piece))
            size += len(piece)
        if not stream.eof:
            raise ValueError("the archive ends inside a member")
        record = b"".join(parts)
        size -= len(stream.unused_data)
        if data[at + size : at + size + len(_EMPTY)] == _EMPTY:  # what _member() adds to a very long record
            size += len(_EMPTY)
        yield at, size, _headers(record[: record.find(_END)]), record
        at += size


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page = lambda urn: None if urn is None or urn == "<urn:page:none>" else int(urn[10:-1])
    fields = [("archive", pa.string()), ("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())]
    for batch in batches:
        for content, name in zip(batch.column(0), batch.column(1).to_pylist()):
            out = []
            for offset, length, head, record in members(content.as_py()):
                block = record[record.find(_END) + 4 : -4]
                payload = block[block.find(_END) + 4 :]
                digest = head["warc-payload-digest"].partition(":")[2]
                if head["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["x-payload-length"])):
                    raise ValueError(f"the payload of {head['warc-record-id']} differs from its digest")
                out.append((name, head["warc-record-id"], offset, length, page(head["warc-record-id"]), int(head["x-payload-length"]), digest, head["warc-type"],
                            page(head.get("warc-refers-to")), head["warc-target-uri"]))
            columns = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """The records of normalised archives, checked against their digests; each must be where the index says, else the
    read fails. Archives are read where they are, and only their records' figures meet the index."""
    small_batches(spark)
    index = spark.read.schema(_INDEX).parquet(f"{target}/index")
    files = _files(spark, f"{target}/archives", "*.txt").select("content", F.regexp_extract("path", "/archive=([^/]+)/", 1).alias("name"))
    found = files.mapInArrow(
        _read, f"{_INDEX}, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    )
    placed = found.join(index.withColumn("_listed", F.lit(True)), ["archive", "record_id", "offset", "length"], "full_outer")
    wrong = F.raise_error(F.concat(F.lit("archive and index differ at "), "archive", F.lit(" "), F.col("offset").cast("string")))
    ok = F.when(F.col("_listed").isNotNull() & F.col("record_type").isNotNull(), F.col("record_type")).otherwise(wrong.cast("string"))
    return placed.select("page_id", "payload_bytes", "payload_digest", ok.alias("record_type"), "refers_to", "target_uri")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages as archives, normalise these, and read every record back. An empty table gives no record."""
    spark = pages.sparkSession
    raw, target = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    write_archives(capture_plan(pages, id_col, url_col, html_col), raw)
    cut_members(spark, raw, target)
    path = spark._jvm.org.apache.hadoop.fs.Path(raw)  # its records are kept as members now
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    write_members(spark, target)
    return read_archives(spark, target)
