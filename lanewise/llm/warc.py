"""WARC archives with per-archive Zstandard dictionaries, written and read by Spark.

An archive is one text file of Spark's own writer: its first row is the dictionary in a skippable frame
(magic 0x184D2A5D), each further row one record compressed alone with that dictionary, and the row separator is an
empty skippable frame, so the file is a valid run of Zstandard frames and Spark's commit protocol, not a task, names
it. Archives are read with the binaryFile source. A dictionary is trained on the first SAMPLE_BYTES of its archive.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shared_path, stage, table

#: Fixed values of the Zstandard format (RFC 8878) and the WARC profile for it.
DICTIONARY_MAGIC, SKIPPABLE_LOW, SKIPPABLE_HIGH = 0x184D2A5D, 0x184D2A50, 0x184D2A5F
#: An empty skippable frame; all its bytes are ASCII, so Spark takes it as a row separator.
SEPARATOR = struct.pack("<II", SKIPPABLE_LOW, 0).decode("ascii")
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 8 << 20, 2 << 20, 32 << 10, 3
#: Payloads below this many bytes are never written as revisits.
LEAST_REVISIT = 100
#: The date of every record: the tables have none.
DATE = "1970-01-01T00:00:00Z"
ROWS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A row of ROWS from one record; a response's length and digest come from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    told = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda x: None if x == "<urn:page:>" else int(x[len("<urn:page:") : -1])
    url = fields.get("WARC-Target-URI")
    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    if fields["WARC-Type"] == "response":
        if (digest := hashlib.sha256(payload).hexdigest()) != told:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        return number(fields["WARC-Record-ID"]), url, "response", None, len(payload), digest, payload
    length = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return number(fields["WARC-Record-ID"]), url, "revisit", number(fields["WARC-Refers-To"]), length, told, None


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed one by one."""
    at, dictionary = 0, None
    view = memoryview(data)
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if SKIPPABLE_LOW <= magic <= SKIPPABLE_HIGH:
            (size,) = struct.unpack_from("<I", data, at + 4)
            if magic == DICTIONARY_MAGIC and at == 0:
                dictionary = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size]))
            at += 8 + size
            continue
        frame, out = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), []
        while not frame.eof:
            piece = bytes(view[at : at + 65536])
            if not piece:
                raise ValueError("the archive ends within a frame")
            out.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(out)


def compress_archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's records to one archive: dictionary first, trained on its first records."""

    def records() -> Iterator[bytes]:
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                yield record(*r)

    rows, sample, size = records(), [], 0
    for r in rows:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not sample:
        return
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, [x[: 64 << 10] for x in sample], level=LEVEL)
    except zstandard.ZstdError:  # too few records to train on: an archive without a dictionary is valid too
        dictionary = None
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
    out = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary.as_bytes())) + dictionary.as_bytes()] if dictionary else []
    size = 0
    for source in (sample, rows):
        for r in source:
            out.append(press.compress(r))
            size += len(out[-1])
            if size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def read_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split(" ")[0] for x in ROWS.split(", ")]
    for b in batches:
        for i in range(b.num_rows):
            rows, size = [], 0
            for raw in frames(b.column("content")[i].as_py()):
                rows.append(parse(raw))
                size += len(raw)
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def write_warc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) to archives under path.

    Null html is an empty payload; a null page_id is written as an empty number and is never a revisit nor referred
    to; rows that repeat a page_id and its payload are all of the same type; other columns are ignored. An empty table
    writes no record.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    keys = stage(keyed.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n")), "warc-keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    candidates = keys.where((F.col("n") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = candidates.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    revisits = candidates.join(first, "digest").where("page_id > refers_to").distinct()
    archives = max(1, -(-total // archive_bytes))
    rows = keyed.repartition(archives, "page_id", "digest").join(revisits, ["page_id", "digest"], "left")
    frames_ = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(compress_archive, "value binary")
    frames_.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records (ROWS) of all archives under path; a revisit has no payload."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read_archives, ROWS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) n, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first from p where n >= 100 group by d)
select page_id, n as payload_bytes, p.d as payload_digest,
  case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id > first then first end as refers_to
from p left join f on p.d = f.d
"""
