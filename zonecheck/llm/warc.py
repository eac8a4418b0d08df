"""WARC archives with revisit records: write pages once per distinct payload, read the archives back.

Headers (digest and id, no payloads) are shuffled by payload digest to find the original of each group and the records
that revisit it; records with fresh headers are written as text whose line end is the record end, in files of a bounded
size. As payloads are UTF-8, the files are plain WARC/1.1. Reading goes by Content-Length, so payloads may hold anything,
also text that looks like a record. What was read is joined again: a revisit to the response that it names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import map_batches, salted_join, shared_dir, small, stored

_END = "\r\n\r\n"
_ID = "urn:x-page:"
#: Characters of records in a file.
FILE_BYTES = 16 << 20


def base32(hex_digits: str) -> Column:
    """The upper-case base32 form of a column of 40 hex digits: 32 digits of five bits, four of them from each five hex digits."""
    bits = f"shiftright(cast(conv(substr({hex_digits}, 5 * (i div 4) + 1, 5), 16, 10) as bigint), cast(15 - 5 * (i % 4) as int)) & 31"
    return F.concat_ws("", F.expr(f"transform(sequence(0, 31), i -> substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ({bits}) as int), 1))"))


def with_digest(pages: DataFrame, payload: str = "html") -> DataFrame:
    """(page_id, url, payload, sha1, payload_bytes): the payload as text (null: empty), its SHA-1 in hex and its size; other columns are left out."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    frame = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    return frame.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))


def revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to): a row for each page and payload that revisits an original; only headers are shuffled, by digest."""
    headers = stored(records.filter(F.col("payload_bytes") >= least_bytes).select("page_id", "sha1"))
    groups = headers.groupBy("sha1").agg(F.count("*").alias("n"), F.min("page_id").alias("refers_to")).filter("n > 1 and refers_to is not null")
    again = salted_join(headers, stored(groups), ["sha1"], ["page_id"])
    return again.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()


def resolve(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload_digest, record_type and refers_to.

    Of the records with equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id is the
    response, the others revisit it; records with the same smallest page_id are all responses, as is a group without
    any page_id. The revisits found go to the records by a broadcast if they are few (``small``), so that
    payloads stay where they are, else by a join on page and digest, a key that is never hot unless rows repeat.
    """
    again = stored(revisits(records, least_bytes).withColumnsRenamed({"page_id": "__page", "sha1": "__sha1"}))
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("sha1") == F.col("__sha1"))
    joined = records.join(small(again), same, "left")
    return joined.select(
        "page_id", "url", "payload", base32("sha1").alias("payload_digest"), "payload_bytes",
        F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to",
    )


def _header(name: str, value) -> F.Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))).otherwise(F.lit(""))


def write(resolved: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Writes one record per row, in files of about ``file_bytes`` before compression, or one record if that is longer. A revisit record has no payload, but names its original."""
    clean_url = F.regexp_replace(F.coalesce("url", F.lit("urn:x-none")), r"[\r\n\s]", "")
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record_id = F.concat(F.lit(_ID), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "record_type",
        _header("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))), _header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", clean_url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit(f"<{_ID}"), F.col("refers_to").cast("string"), F.lit(">")))),
        _header("Content-Type", F.when(~revisit, F.lit("text/html;charset=utf-8"))), F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END),
    )

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each file: records with the record end between them."""
        held: list[str] = []
        size = 0
        for batch in batches:
            for value in batch.column(0):
                record = value.as_py()
                if held and size + len(record) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([_END.join(held)])], names=["value"])
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_END.join(held)])], names=["value"])

    records = resolved.select(F.concat(head, block).alias("value")).mapInArrow(files, "value string")
    records.write.option("lineSep", _END).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        yield headers, data[start:stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end at its length")
        at = stop + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, refers_to, payload_bytes, payload_sha1) of every record below ``path``; the last two are of the block as read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def number(uri: str | None) -> int | None:
        text = (uri or "").strip("<>").removeprefix(_ID)
        return None if text in ("", "none") else int(text)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        import gzip

        out = []
        for x in batch.column(0):
            for h, block in parse(gzip.decompress(x.as_py())):
                uri = h.get("warc-target-uri")
                out.append((number(h["warc-record-id"]), None if uri == "urn:x-none" else uri, h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), number(h.get("warc-refers-to")), len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()))
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload_sha1"])

    return map_batches(files, rows, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload_sha1 string")


def resolved_read(records: DataFrame) -> DataFrame:
    """Read records, a stored table, with the payload size of each revisit taken from the response that it refers to."""
    again = records.filter("record_type = 'revisit'").drop("payload_bytes")
    asked = again.groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n"))
    responses = records.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    sized = salted_join(again, stored(responses.join(asked, ["refers_to", "payload_digest"])), ["refers_to", "payload_digest"], ["page_id"], "left")
    return records.filter("record_type = 'response'").unionByName(sized.select(*records.columns))


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages`` to archives (a new shared folder unless ``path`` is given) and returns what reading them gives.

    One row per page: null html counts as empty, empty payloads are a group like any other, repeated rows stay.
    Columns other than page_id, url and html are not archived.
    """
    path = path or shared_dir(pages.sparkSession)
    write(resolve(with_digest(pages), least_bytes), path, file_bytes=file_bytes)
    return resolved_read(stored(read(pages.sparkSession, path)))
