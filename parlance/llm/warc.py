"""Content-addressed WARC archive.

An archive is two tables in one folder:

``payloads``  digest (SHA-256 of the payload), length, packed (the payload's
              bytes, zlib): every distinct payload once;
``records``   one row per record: the exact bytes of its WARC header and of
              its HTTP header, and the digest of its payload.

Writing computes the digests, decides per (digest, length) which record
holds the payload, and stores that payload once.  Reading joins records and
payloads on the digest, checks both digests of the bytes found, and gives
back the original records: header, block, two line ends.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.arrow import map_rows
from parlance.llm.prefilter import bit_pages, marked
from parlance.plans.ordering import materialize
from parlance.session import scratch_path

RESPONSE, REVISIT = "response", "revisit"
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The date of records whose capture time nobody names.
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n"
_HEX5 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest):
    """Base 32 text of a 160-bit hex digest: five hex digits are four base-32 digits."""
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _HEX5, _BASE32)


_CONTROLS = [chr(i) for i in range(32)] + [chr(127)]
_ESCAPED = re.compile(r"\\(\\|x[0-9A-F]{2})")


def _clean(c):
    """A header value on one line: control characters become \\xNN and a backslash is doubled; other values stay as they are."""
    safe = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in _CONTROLS:
        safe = F.replace(safe, F.lit(x), F.lit(f"\\x{ord(x):02X}"))
    return F.when(F.rlike(c, F.lit(r"[\x00-\x1F\x7F\\]")), safe).otherwise(c)


def _restored(value: str | None) -> str | None:
    """The value that ``_clean`` wrote."""
    if value is None or "\\" not in value:
        return value
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else chr(int(m[1][1:], 16)), value)


def digested(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, sha1 (base 32), digest (SHA-256), length; a null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     payload.alias("payload"))
    return p.select("page_id", "url", "payload", base32_of_hex(F.sha1("payload")).alias("sha1"),
                    F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length"))


def record_types(keys: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``keys`` (page_id, digest, length, ...) with record_type and refers_to.

    Of records with one digest and length the smallest page_id holds the
    payload; a shorter payload than ``min_bytes`` is always stored with its
    record.  A null page_id comes after all others.
    """
    first = keys.filter(F.col("length") >= min_bytes).groupBy("digest", "length").agg(F.min("page_id").alias("_first"))
    told = keys.join(first, ["digest", "length"], "left")
    holds = (F.col("length") < min_bytes) | F.col("page_id").eqNullSafe(F.col("_first"))
    return (told.withColumn("record_type", F.when(holds, F.lit(RESPONSE)).otherwise(F.lit(REVISIT)))
                .withColumn("refers_to", F.when(~holds, F.col("_first"))).drop("_first"))


def _header(*fields):
    parts = [F.lit(VERSION + _END)]
    for name, value in fields:
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(_END))).otherwise(F.lit("")))
    return F.concat(*parts, F.lit(_END))


def headers(typed: DataFrame, date: str = DATE) -> DataFrame:
    """The records table: page_id, digest, header, http."""
    http = F.concat(F.lit("HTTP/1.1 200 OK" + _END + "Content-Type: text/html; charset=utf-8" + _END
                          + "Content-Length: "), F.col("length").cast("string"), F.lit(_END + _END))
    is_response = F.col("record_type") == RESPONSE
    block = F.octet_length(http) + F.when(is_response, F.col("length")).otherwise(F.lit(0))
    ident = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = _header(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.coalesce(ident(F.col("page_id")), F.lit("<urn:page:>"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _clean(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Payload-Length", F.col("length").cast("string")),
        ("WARC-Profile", F.when(~is_response, F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", F.when(~is_response, ident(F.col("refers_to")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block.cast("string")))
    return typed.select("page_id", "digest", head.cast("binary").alias("header"), http.cast("binary").alias("http"))


def _packed(batches):
    """Payloads packed before they are shuffled, once their digest is verified."""
    for batch in batches:
        digests, payloads, ids = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
        for i, digest in enumerate(digests):
            data = payloads[i].as_py()
            if hashlib.sha256(data).hexdigest() != digest:
                raise ValueError(f"payload does not have the digest {digest}")
            yield digest, ids[i], zlib.compress(data, 6)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Archive every row of ``pages`` (page_id, url, html) under ``path``; ``date`` is that of all records.

    A null html is an empty payload, a null url is left out of the header.
    Rows with one page_id and payload are records of one type; the payload
    is still stored once.  An empty table gives an empty archive.
    """
    full = digested(pages)
    typed = materialize(record_types(full.drop("payload"), min_bytes))
    headers(typed, date).write.parquet(f"{path}/records")
    # The record that holds a payload is found by both keys: copies of one payload spread over all tasks.
    held = typed.filter(F.col("record_type") == RESPONSE)
    held = materialize(held.groupBy("digest").agg(F.min("page_id").alias("_page")))
    # Copies leave before they are packed and shuffled, but for the few that the bit table lets through.
    key = lambda page: F.concat_ws(":", "digest", page.cast("string"))
    pages_of, bits = bit_pages(held, key(F.col("_page")), held.count())
    holders = marked(full.select("digest", "payload", "page_id"), key(F.col("page_id")), materialize(pages_of), bits, "_may")
    candidates = map_rows(holders.filter("_may").select("digest", "payload", "page_id"), _packed,
                          "digest string, page_id long, packed binary")
    stored = candidates.join(held, (candidates["digest"] == held["digest"])
                             & candidates["page_id"].eqNullSafe(held["_page"])).select(
        candidates["digest"], "page_id", "packed").dropDuplicates(["digest", "page_id"])
    stored.select("digest", "packed").write.parquet(f"{path}/payloads")


def _rebuilt(batches):
    """The original records, payload digests checked against the bytes."""
    for batch in batches:
        names = batch.schema.names
        cols = {n: batch.column(i) for i, n in enumerate(names)}
        for i in range(batch.num_rows):
            header, http = cols["header"][i].as_py(), cols["http"][i].as_py()
            packed = cols["packed"][i].as_py()
            payload = b""
            if packed is not None:
                payload = zlib.decompress(packed)
                if hashlib.sha256(payload).hexdigest() != cols["digest"][i].as_py():
                    raise ValueError("stored payload does not have its digest")
            yield (header + http + payload + b"\r\n\r\n",)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the bytes of every record of the archive."""
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    is_response = F.startswith(F.col("header"), F.lit(f"{VERSION}\r\nWARC-Type: {RESPONSE}\r\n").cast("binary"))
    responses = records.filter(is_response)
    # One record per payload as a rule: the join is one to one, its key is not skewed by copies.
    full = responses.join(payloads, "digest", "left").select("header", "http", "digest", "packed")
    bare = records.filter(~is_response).select("header", "http", "digest", F.lit(None).cast("binary").alias("packed"))
    return map_rows(full, _rebuilt, "record binary").unionByName(map_rows(bare, _rebuilt, "record binary"))


def _number(text: str) -> int | None:
    digits = text.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def _parsed(batches):
    for batch in batches:
        for value in batch.column(0):
            record = value.as_py()
            head, _, block = record.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
            block = block[:int(fields["Content-Length"])]
            payload = block.partition(b"\r\n\r\n")[2]
            kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            length = int(fields["WARC-Payload-Length"])
            if kind == RESPONSE:
                found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if found != said or len(payload) != length:
                    raise ValueError(f"record {fields['WARC-Record-ID']} does not match its payload digest")
            refers = fields.get("WARC-Refers-To")
            yield (_number(fields["WARC-Record-ID"]), _restored(fields.get("WARC-Target-URI")), length, said, kind,
                   None if refers is None else _number(refers), payload if kind == RESPONSE else None)


_PARSED = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, payload binary")


def parse_records(records: DataFrame) -> DataFrame:
    """Fields and payload of record bytes; the digests of responses are verified."""
    return map_rows(records.select("record"), _parsed, _PARSED)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to a fresh archive in the shared folder and read it back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, min_bytes)
    return parse_records(read_records(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = ", ".join(f"'{c}'" for c in _BASE32)
ARCHIVE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, octet_length(encode(html))::BIGINT AS n, sha1(html) AS x,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         [{_CHARS}][((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1]), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN '{RESPONSE}' ELSE '{REVISIT}' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h
"""
