"""WARC archives: a writer on Spark's text sink and a reader that salvages what can be read of damaged files.

The reader takes whole archives (the writer bounds their size) as rows of the ``binaryFile`` source. A file is a run of gzip members and
plain records, which are parsed one after the other. Only where a member doesn't inflate, or a record's version line, headers, length,
closing blank lines or digests fail, the reader searches for the next place at which a whole member or a record that holds begins, goes on
there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, shared_path, small

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        """The block without an HTTP head."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def sha256_of(value: str) -> bytes | None:
    """The digest of a ``sha256:`` header in hex or base32; None for other algorithms."""
    kind, _, text = value.partition(":")
    if kind.lower() != "sha256":
        return None
    try:
        return bytes.fromhex(text) if len(text) == 64 else base64.b32decode(text.upper())
    except ValueError:
        return b""


def parse_record(data: bytes, at: int) -> Record | str:
    """The record at an offset, or what is wrong there."""
    if not (m := VERSION.match(data, at)):
        return "no version line"
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        return "headers are cut off"
    headers: dict[str, str] = {}
    last = None
    for line in data[m.end() : end].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:  # a folded header goes on
            headers[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return "a header has no colon"
        last = name.strip().lower().decode("utf-8", "replace")
        headers[last] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,15}", headers.get("content-length", "")):
        return "no length"
    start, n = end + 4, int(headers["content-length"])
    if start + n > len(data):
        return "the block is cut off"
    if data[start + n : start + n + 4] != b"\r\n\r\n":
        return "no blank lines after the block"
    record = Record(at, start + n + 4 - at, headers, data[start : start + n])
    block = sha256_of(headers.get("warc-block-digest", ""))
    if block is not None and hashlib.sha256(record.block).digest() != block:
        return "the block's digest differs"
    payload = sha256_of(headers.get("warc-payload-digest", ""))
    if payload is not None and headers.get("warc-type") != "revisit" and hashlib.sha256(record.payload).digest() != payload:
        return "the payload's digest differs"
    return record


def plain_records(data: bytes, base: int = 0) -> Iterator[Record | tuple[int, int, str]]:
    """Records of uncompressed bytes, and gaps (start, end, reason); offsets count from ``base``."""
    at = 0
    while at < len(data):
        found = parse_record(data, at)
        if isinstance(found, Record):
            at += found.length
            found.offset += base
            yield found
            continue
        following = at
        while True:  # the next version line of a record that holds
            m = VERSION.search(data, following + 1)
            following = m.start() if m else len(data)
            if not m or isinstance(parse_record(data, following), Record):
                break
        yield base + at, base + following, found
        at = following


def member_at(data: bytes, at: int, most: int) -> tuple[bytes | None, int] | None:
    """What the gzip member at an offset holds and its length, if it is whole (its check sum and size hold).

    It is inflated step by step; of more than ``most`` bytes only the end is found, and None stands for them.
    """
    inflate, out, n, end = zlib.decompressobj(31), [], 0, at
    view = memoryview(data)
    try:
        while not inflate.eof:
            part = inflate.unconsumed_tail or view[end : end + 65536]
            if not len(part):
                return None
            end += 0 if inflate.unconsumed_tail else len(part)
            some = inflate.decompress(part, 1 << 20)
            n += len(some)
            if n <= most:
                out.append(some)
            else:
                out.clear()
    except zlib.error:
        return None
    return b"".join(out) if n <= most else None, end - at - len(inflate.unused_data)


def salvage(data: bytes, most: int = 1 << 28) -> Iterator[Record | tuple[int, int, str]]:
    """Records and gaps (start, end, reason) of an archive, compressed by member, plain or both. Offsets are those of the file.

    A member that inflates to more than ``most`` bytes is a gap.
    """
    at, known, version = 0, None, -1

    def next_version(after: int) -> int | None:
        """The next version line, looked for once only: what has been looked through for one gap isn't for the next."""
        nonlocal version
        if version is not None and version <= after:
            m = VERSION.search(data, after + 1)
            version = m.start() if m else None
        return version

    while at < len(data):
        if data.startswith(MEMBER, at):
            member = known or member_at(data, at, most)
            known = None
            if member:
                inner, length = member
                if inner is None:
                    yield at, at + length, f"a member of more than {most} bytes"
                for x in plain_records(inner or b""):
                    if isinstance(x, Record):
                        x.offset, x.length = at, length
                        yield x
                    else:
                        yield at, at + length, f"in a member: {x[2]}"
                at += length
                continue
            why = "a member is damaged"
        else:
            found = parse_record(data, at)
            if isinstance(found, Record):
                yield found
                at += found.length
                continue
            why = found
        following = at
        while True:  # the next place at which a member or a record holds
            nexts = [x for x in (data.find(MEMBER, following + 1), next_version(following)) if x is not None and x >= 0]
            following = min(nexts, default=len(data))
            if not nexts or (known := member_at(data, following, most) if data.startswith(MEMBER, following) else None):
                break
            if not data.startswith(MEMBER, following) and isinstance(parse_record(data, following), Record):
                break
        yield at, following, why
        at = following


READ = "path string, offset long, length long, gap string, gap_before long, warc_type string, record_id string, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, payload_sha256 string, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True, most: int = 1 << 28) -> DataFrame:
    """Records of all archives under ``path``, and a row with ``gap`` (the reason) for each quarantined range of bytes.

    ``gap_before`` of a record counts the quarantined bytes since the record before it. ``payload_bytes`` and ``payload_sha256`` come from
    the bytes read; a revisit has none of its own, and there they are what its headers state. An empty file gives no row. With
    ``payloads=False`` the payload column is null. Members that inflate to more than ``most`` bytes are gaps.
    """

    def of(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size, lost = [], 0, 0
                for x in salvage(content.as_py() or b"", most):
                    if isinstance(x, tuple):
                        rows.append((name.as_py(), x[0], x[1] - x[0], x[2], *[None] * 9))
                        lost += x[1] - x[0]
                    else:
                        h, body = x.headers, x.payload
                        stated = sha256_of(h.get("warc-payload-digest", "")) or b""
                        again = h.get("warc-type") == "revisit"
                        n = int(h["warc-payload-length"]) if again and h.get("warc-payload-length", "").isdigit() else None if again else len(body)
                        digest = stated.hex() or None if again else hashlib.sha256(body).hexdigest()
                        rows.append((name.as_py(), x.offset, x.length, None, lost, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), n, digest, body if payloads else None))
                        size += len(body) * payloads
                        lost = 0
                    if size > 8_000_000 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(of, READ)


NAMES = [x.split()[0] for x in READ.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in READ.split(", ")]


def record_types(digests: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to) of the payloads (page_id, n, digest) of ``least`` bytes or more that a smaller page_id has as well."""
    large = digests.where(F.col("n") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return large.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def records_for(digests: DataFrame, bytes_per_file: int = 64_000_000, most_bytes: int = 1_000_000_000) -> int:
    """Records for an archive of about so many bytes, and of at most ``most_bytes``."""
    mean, most = digests.agg(F.avg("n"), F.max("n")).first()
    return max(1, min(10_000, int(bytes_per_file / (1000 + (mean or 0))), int(most_bytes / (1000 + (most or 0)))))


#: A gzip member ends with its size, of which the last byte is 0 below 16 MB; that byte is written as the separator of lines. Larger
#: members get an empty one behind them, which ends so too.
EMPTY = gzip.compress(b"", mtime=0)


def _members(records: DataFrame) -> DataFrame:
    """``records`` (value string, damaged boolean) as gzip members without their last byte; a byte of the checksum is wrong where one is damaged."""

    def of(batches):
        for batch in batches:
            out, size = [], 0
            for x, damaged in zip(batch.column("value"), batch.column("damaged"), strict=True):
                member = gzip.compress(x.as_buffer(), 6, mtime=0)
                if damaged.as_py():
                    member = member[:-8] + bytes([member[-8] ^ 0xFF]) + member[-7:]
                out.append(member[:-1] if member[-1] == 0 else member + EMPTY[:-1])
                size += len(out[-1])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return records.select(F.col("value").cast("binary"), "damaged").mapInArrow(of, "value binary").select(F.col("value").cast("string"))


def write_warc(pages: DataFrame, path: str, least: int = 100, records_per_file: int | None = None, date: str = "2024-01-01T00:00:00Z", members: bool = True, damage: Column | None = None) -> None:
    """Write a record per row of ``pages`` (page_id, url, html; others are ignored) below ``path``, each a gzip member, or plain.

    Of records with equal payloads of ``least`` bytes or more, those with the smallest page_id are responses, the others are revisits
    without a payload. A null html is an empty payload, a null url an empty address; without a page_id a row is a response whose record has
    no number. Rows that repeat a page_id are each written. An archive holds about 64 MB of records, and 1 GB at most, unless
    ``records_per_file`` is given. An empty table gives no record. Gzip members of pages for which ``damage`` holds are written with a wrong
    checksum, to try out what a reader recovers.
    """
    body = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "").alias("url"), body.alias("payload"), F.sha2(body.cast("binary"), 256).alias("digest"), F.coalesce(F.lit(False) if damage is None else damage, F.lit(False)).alias("damaged"))
    digests = cut(pages.select("page_id", F.octet_length("payload").alias("n"), "digest"), "digests")
    again = cut(record_types(digests, least), "revisits")
    rows = pages.join(small(again), ["page_id", "digest"], "left")
    crlf = "\r\n"
    n = F.octet_length("payload")
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), n.cast("string"), F.lit(crlf * 2))
    block = F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))
    record = F.concat_ws(
        crlf,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Payload-Length: "), n.cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("b").cast("string")),
        F.lit(""),
        F.col("b"),
        F.lit(""),
    )
    lines = rows.withColumn("b", block).select(record.alias("value"), "damaged")
    lines = _members(lines.select(F.concat("value", F.lit(crlf)).alias("value"), "damaged")) if members else lines.select("value")
    lines.write.option("lineSep", "\0" if members else crlf).option("maxRecordsPerFile", records_per_file or records_for(digests)).text(path)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and gap_before of the records that ``read_warc`` could read."""
    page = lambda c: F.nullif(F.regexp_extract(c, "urn:page:(-?[0-9]+)", 1), F.lit("")).cast("long")
    return records.where("gap is null").select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        F.col("payload_sha256").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(F.col("refers_to_id").isNotNull(), page("refers_to_id")).alias("refers_to"),
        "gap_before",
    )


def quarantine(records: DataFrame) -> DataFrame:
    """The log of what ``read_warc`` couldn't read: path, offset, length and the reason."""
    return records.where("gap is not null").select("path", "offset", "length", "gap")


def archived_pages(pages: DataFrame, damage: Column | None = None) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back; a row per record, as ``pages_of`` gives it.

    With ``damage``, a condition on a page's columns, a second copy is written in which the members of those pages are damaged; the column
    ``salvaged`` tells whether that copy, too, gave the page, past the damage before it. All that was read stays as tables there, gaps included; a
    record behind a gap names the bytes lost before it. A null html is empty; rows that repeat a page_id, or have none, are records each; an empty
    table gives an empty result; other columns are ignored; a very long html is one record up to the reader's bound of a member (256 MB).
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    read = pages_of(cut(read_warc(spark, path, payloads=False), "warc-records"))
    if damage is None:
        return read
    other = shared_path(spark, "warc-damaged")
    write_warc(pages, other, damage=damage)
    found = cut(pages_of(cut(read_warc(spark, other, payloads=False), "warc-salvaged")).select(F.col("page_id").alias("found")).distinct(), "warc-found")
    return read.join(small(found.withColumn("salvaged", F.lit(True))), read["page_id"].eqNullSafe(F.col("found")), "left").select(*read.columns, F.coalesce("salvaged", F.lit(False)).alias("salvaged"))
