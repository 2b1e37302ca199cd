"""WARC archives without repeated payloads: written, read back and resolved.

Headers are grouped by payload digest.  Of equal payloads of at least ``least_bytes`` bytes the
one with the largest ``page_id`` is written as a response, the others as revisit records that
refer to it; every record gets fresh headers.  A record is one line of Spark's text writer whose
line end is the blank line that closes a WARC record, so archives go through Spark's commit to
any store it knows and a lost executor leaves no half file behind.

Null html is an empty payload and always a response.  A null ``page_id`` is smaller than any
other; a group without any ``page_id`` has responses only.  Rows that repeat ``page_id`` and
payload of a response are that response again, under the same record id.  Line ends in a URL are
percent-encoded in the header, a null URL has no header.  No pages give no archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk.llm.registry import query, table
from nightdesk.llm.rows import split_by
from nightdesk.llm.store import run_folder, written
from nightdesk.llm.text import map_arrow

LEAST_BYTES = 1000
#: An archive is read back whole, so it must stay well below two gigabytes.
MOST_RECORDS = 10_000
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, record_type string, refers_to_record string, page_id long, url string, payload_bytes long, "
    "payload_digest string"
)


def _record_id(page_id, digest):
    """A name-based URN of page and payload."""
    name = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value):
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, written_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``record``: the text of one record per page, up to the blank line that closes it."""
    payload = F.coalesce("html", F.lit(""))
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    held = held.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    # Headers alone are shuffled by digest, and copies collapse before.  Only pages whose digest may be
    # shared meet the originals; the others pass with their payloads where they are.  The key is spelled
    # anew so that both sides of the join are shuffled on their own and a shared payload can be split.
    first = held.where(F.col("bytes") >= least_bytes).groupBy(F.unhex("digest").alias("raw")).agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    first = first.where("n > 1 AND original IS NOT NULL").select(F.lower(F.hex("raw")).alias("digest"), "original")
    first = written(first, f"{run_folder(pages.sparkSession, 'warc')}/originals")
    asked, alone = split_by(held, F.col("digest"), first.select("digest"))
    joined = asked.join(first.hint("merge"), "digest", "left").unionByName(alone.withColumn("original", F.lit(None).cast("long")))
    revisit = ~F.coalesce(F.col("page_id") == F.col("original"), F.col("original").isNull())
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(written_at)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("original"), F.col("digest")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("record"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, compression: str = "gzip") -> None:
    """Archives under ``path``, each of what one task has and of ``MOST_RECORDS`` records at most."""
    out = records(pages, least_bytes)
    out.write.mode("overwrite").option("lineSep", RECORD_END).option("compression", compression).option("maxRecordsPerFile", MOST_RECORDS).text(path)


def _parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record in a stream of bytes."""
    buffer = b""
    chunks = iter(chunks)

    def fill(size: int) -> bool:
        nonlocal buffer
        parts, have = [buffer], len(buffer)
        while have < size:
            more = next(chunks, None)
            if more is None:
                break
            parts.append(more)
            have += len(more)
        buffer = b"".join(parts)
        return have >= size

    while fill(1):
        while (at := buffer.find(b"\r\n\r\n")) < 0:
            if not fill(len(buffer) + 1):
                raise ValueError("an archive ends within a header")
        lines = buffer[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record starts here")
        fields = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines[1:])}
        size = int(fields["content-length"])
        if not fill(at + 4 + size + 4) or buffer[at + 4 + size : at + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, buffer[at + 4 : at + 4 + size]
        buffer = buffer[at + 8 + size :]


def _chunks(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The archive's bytes, unpacked piece by piece where it is gzip (one member or many)."""
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), size):
            yield content[at : at + size]
        return
    rest = content
    while rest:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            piece = unpack.decompress(rest, size)
            rest = unpack.unconsumed_tail
            if piece:
                yield piece
            elif not rest and not unpack.eof:
                raise ValueError("an archive is cut short")
        rest = unpack.unused_data


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record.  Size and digest of a response are those of the payload that was read;
    a revisit record has the digest of its header and no size.  ``payload`` follows if asked for.
    """
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")] + ["payload"] * with_payload
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column("content"):
                rows, held = [], 0
                for fields, block in _parse(_chunks(content.as_py())):
                    response = fields["warc-type"] == "response"
                    page = fields.get("x-page-id")
                    rows.append((
                        fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to"), None if page is None else int(page),
                        fields.get("warc-target-uri"), len(block) if response else None,
                        hashlib.sha1(block).hexdigest() if response else fields["warc-payload-digest"].removeprefix("sha1:"),
                        *([block if response else None] if with_payload else []),
                    ))
                    held += len(block) if with_payload else 200
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, work, RECORD_SCHEMA + ", payload binary" * with_payload)


def resolve(found: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of written records.

    Revisit records take the size from the response they refer to.
    """
    spark = found.sparkSession
    folder = run_folder(spark, "warc")
    found = written(found.drop("payload", "url"), f"{folder}/records")
    response = found.where("record_type = 'response'")
    plain = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    originals = response.groupBy("record_id").agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("size"))
    originals = written(originals, f"{folder}/originals").select(F.col("record_id").alias("refers_to_record"), "refers_to", "size")
    revisit = found.where("record_type = 'revisit'").join(originals.hint("merge"), "refers_to_record", "left")
    return response.select(*plain, F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisit.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    )


@query(
    "op6_warc_revisits",
    """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM g
""",
)
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{run_folder(spark, 'warc')}/archives"
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolve(read_archives(spark, path))
