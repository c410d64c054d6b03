"""WARC (10): archives of request, response or revisit, and metadata records; captures assembled by transaction.

Records are put together by DataFrame functions and written by Spark's text writer (a record's last line end is the
writer's), so archives land on any file system with the writer's commit protocol. Reading parses each archive by content
lengths, whatever the payloads hold. A transaction is joined through WARC-Concurrent-To: requests and metadata name the
record of the response or revisit.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_path, stored, text_of

#: Payload bytes that an archive holds, about, and that a task writes: more than one archive where the table is large.
ARCHIVE_BYTES, TASK_BYTES = 16 << 20, 512 << 20
#: Smaller payloads are never revisits.
MIN_REVISIT = 0
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 in base32: its forty hex digits five at a time give four letters."""
    digest = F.sha1(data)
    letters = []
    for k in range(8):
        n = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(n, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*letters)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, int]:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): of equal payloads the largest id is the response;
    and the captures that make an archive of about ``archive_bytes``.

    ``refers_to`` is null for responses. Null payloads are empty. A row without an id revisits the largest id of its
    payload, if there is any. Rows of the same id and payload are each a response if that id is the largest. Which id
    that is, is found on ids and digests alone, which are worked out and stored first; payloads move once, by id and digest, into as many tasks as the session
    shuffles to, or more where each would write over TASK_BYTES. Other columns aren't looked at.
    """
    spark, payload = pages.sparkSession, text_of(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), text_of(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("_none", F.col("page_id").isNull()).withColumn("_id", F.coalesce("page_id", F.lit(0)))
    key, what = ["_id", "_none", "payload_digest", "payload_bytes"], ["payload_digest", "payload_bytes"]
    noted, _ = stored(rows.select("page_id", *key), "marks")
    marks = noted.filter(F.col("payload_bytes") >= min_revisit).distinct()
    latest = marks.groupBy(*what).agg(F.max("page_id").alias("refers_to"))
    revisits = marks.join(latest, what).filter(~F.col("refers_to").eqNullSafe(F.col("page_id"))).select(*key, "refers_to")
    total, n = noted.select(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, min(-(-total // archive_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-total // TASK_BYTES))
    found = rows.repartition(tasks, *key).join(revisits.repartition(tasks, *key), key, "left").drop("_id", "_none")
    return found, max(1, n * archive_bytes // max(total, archive_bytes))


def _clean(value: Column) -> Column:
    """A header value has no line ends."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def _record(kind: str, record_id: Column, url: Column, content_type: str, block: Column, *headers: Column) -> Column:
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), record_id, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), _clean(url),
        F.lit(f"\r\nContent-Type: {content_type}\r\n"), *headers, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n"),
    ]
    return F.concat(*lines)


def record_texts(found: DataFrame) -> DataFrame:
    """(value): the three records of every capture, each but for its last line end.

    Ids are uuids of the role, the page id and the payload's digest, and for requests and metadata the url: rows that
    are equal in all these have the same records, written as often as they come.
    """

    def urn(role: str, of: Column, *more: Column) -> Column:
        h = F.md5(F.concat_ws("\0", F.lit(role), F.coalesce(of.cast("string"), F.lit("")), F.col("payload_digest"), *more))
        return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), *[x for at, n in ((9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, at, n))])

    page, url = F.col("page_id"), F.col("url")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"))
    capture = urn("capture", page)
    concurrent = F.concat(F.lit("WARC-Concurrent-To: <"), capture, F.lit(">\r\n"))
    kind = "application/http; msgtype=response"
    original = F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <"), urn("capture", F.col("refers_to")), F.lit(">\r\n")
    revisit = _record("revisit", capture, url, kind, http, digest, *original)
    response = _record("response", capture, url, kind, F.concat(http, F.col("payload")), digest)
    line = F.concat(F.lit("GET "), _clean(url), F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record("request", urn("request", page, url), url, "application/http; msgtype=request", line, concurrent)
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    notes = F.concat(F.lit("page-id: "), number(page), F.lit("\r\nrefers-to-page: "), number(F.col("refers_to")), F.lit("\r\n"))
    metadata = _record("metadata", urn("metadata", page, url), url, "application/warc-fields", notes, concurrent)
    return found.select(F.concat_ws("\r\n", request, F.when(F.col("refers_to").isNull(), response).otherwise(revisit), metadata).alias("value"))


def write(found: DataFrame, path: str, per_archive: int) -> None:
    """Write the captures as gzip archives of so many captures; a task goes on to the next when one is full."""
    record_texts(found).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (headers, block) of each record of an archive, in order; header names in lower case."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {name.strip().lower(): value.strip() for name, value in (line.split(":", 1) for line in lines)}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken WARC record at byte {at}")
        yield headers, block
        at = end + 8 + size


RECORD = "record_id string, type string, concurrent_to string, refers_to string, url string, digest string, payload_bytes long, payload binary, fields map<string,string>"


def _inflated(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in ``path``. ``payload_bytes`` and ``digest`` of a revisit are what its headers say;
    of a response the payload is measured and must match its digest."""
    import base64
    import hashlib

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "url", "digest")] + [("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in parse(_inflated(content.as_py())):
                    kind, payload, fields, digest, size = h["warc-type"], None, {}, None, None
                    if kind in ("response", "revisit"):
                        top, _, body = block.partition(b"\r\n\r\n")
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        size = next(int(x.split(b":")[1]) for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        if kind == "response":
                            found = base64.b32encode(hashlib.sha1(body).digest()).decode()
                            if found != digest or size != len(body):
                                raise ValueError(f"{h['warc-record-id']}: payload doesn't match its digest")
                            payload = body if with_payload else None
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in block.decode().split("\r\n") if x)
                    strip = lambda v: v and v.strip("<>")
                    rows.append((strip(h["warc-record-id"]), kind, strip(h.get("warc-concurrent-to")), strip(h.get("warc-refers-to")), h.get("warc-target-uri"), digest, size, payload, list(fields.items())))
                    held += len(payload or b"") + 300
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit record, and the requests and metadata concurrent to it.

    A capture without request or metadata has an empty array there. Of a capture written twice each record is a row;
    equal requests and metadata are one element, so a capture that a third of all rows repeat has one of each.
    """
    head = records.filter(F.col("type").isin("response", "revisit"))
    fields = F.array_sort(F.map_entries("fields")).alias("fields")  # maps can't be compared
    part = F.struct("record_id", "url", fields)
    beside = (
        records.filter(F.col("type").isin("request", "metadata"))
        .groupBy("concurrent_to")
        .agg(F.collect_set(F.when(F.col("type") == "request", F.struct("record_id", "url"))).alias("requests"), F.collect_set(F.when(F.col("type") == "metadata", part)).alias("metadata"))
        .withColumnRenamed("concurrent_to", "record_id")
    )
    named = F.transform("metadata", lambda m: F.struct(m["record_id"].alias("record_id"), m["url"].alias("url"), F.map_from_entries(m["fields"]).alias("fields")))
    out = head.join(beside, "record_id", "left").withColumn("metadata", named)
    return out.select("record_id", "type", "url", "digest", "payload_bytes", "payload", "refers_to", "requests", "metadata")


def archive(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write the captures of ``pages`` to the shared folder, read the archives back, and assemble them."""
    path = shared_path(pages.sparkSession, "warc")
    found, per_archive = captures(pages)
    write(found, path, per_archive)
    return assemble(read_records(pages.sparkSession, path, with_payload))
