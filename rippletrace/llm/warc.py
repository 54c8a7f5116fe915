"""WARC archives whose records are compressed one by one with a dictionary of their own archive.

An archive starts with a skippable frame that holds a Zstandard dictionary, built
from records of this archive; each record is a frame of its own, so that it can
be read alone. Archives are rows of Spark's text writer, one to a file, and go
through its commit protocol to any file system that Spark knows; what the writer
puts after each row as the line separator is an empty skippable frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.llm.common import materialise

#: Magic numbers of frames with a dictionary, of other skippable frames (16 of them) and of data.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
DATA_FRAME = 0xFD2FB528
#: Fixed value: what a dictionary in Zstandard's own format starts with.
DICTIONARY_MAGIC = struct.pack("<I", 0xEC30A437)
#: An empty skippable frame. All its bytes are ASCII, so that it can be a line separator.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records that a dictionary is built from, and of the dictionary, at most.
SAMPLE_BYTES, DICTIONARY_BYTES = 8 << 20, 64 << 10
#: A payload that this share of the rows has is looked up by a broadcast; there are a thousand such payloads at most.
HOT_SHARE = 1000


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Which page becomes which record: ``key``, url, payload, payload_bytes, payload_digest (hexadecimal SHA-1), record_type and refers_to.

    The payload is the text in UTF-8; null is empty. Of equal payloads of
    ``least_bytes`` or more, that with the largest key is a response and the
    others revisit it; a row that repeats the largest key is a response as well.
    Rows without a key revisit one that has a key, if there is one. Payloads are
    compared by length and SHA-256.

    Only keys and digests are shuffled to find repeated payloads. Those that are
    common get a broadcast, and so no task gets all their rows.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    size = F.octet_length("payload")
    rows = rows.withColumns({"payload_bytes": size.cast("long"), "payload_digest": F.sha1("payload"), "same": F.when(size >= least_bytes, F.sha2("payload", 256))})
    groups = rows.where("same is not null").groupBy("same", "payload_bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.where("n > 1 and last is not null"), "warc-repeated")
    least = max(2, -(-pages.count() // HOT_SHARE))
    hot = groups.where(F.col("n") >= least).select("same", "payload_bytes", F.col("last").alias("hot"))
    rows = rows.join(F.broadcast(hot), ["same", "payload_bytes"], "left")
    # Rows without a partner and those of common payloads have keys of their own, so that they don't meet in one task.
    apart = F.col("same").isNull() | F.col("hot").isNotNull()
    rows = rows.withColumn("by", F.when(apart, F.concat_ws(":", F.lit("-"), "page_id", "payload_digest")).otherwise(F.col("same")))
    rest = groups.where(F.col("n") < least).select(F.col("same").alias("by"), "payload_bytes", "last")
    rows = rows.join(rest, ["by", "payload_bytes"], "left").withColumn("last", F.coalesce("hot", "last"))
    first = F.col("last").isNull() | F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("last")).alias("refers_to"))


def record_id(key: int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def make_record(kind: str, key: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: an HTTP response, of a revisit only its header, which tells how long the payload is."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key)), ("WARC-Date", date)]
    if url is not None:
        # A header is one line of printable characters.
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], most: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from records spread evenly over the archive; too few of them are the dictionary themselves, as plain content."""
    sample, step = [], max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    for r in records[::step]:
        sample.append(r[: 4 * most])  # what is far inside of a long record
    try:
        return zstandard.train_dictionary(most, sample, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-most:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == DICTIONARY_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def make_archive(records: list[bytes], level: int = 3) -> bytes:
    """A frame with the dictionary, then a frame for each record."""
    data = build_dictionary(records)
    pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data), write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(data)), data, *(pack.compress(r) for r in records)])


def records_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame after the other; raises on anything that isn't such an archive."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_FRAME:
        raise ValueError("an archive starts with its dictionary")
    unpack, at = zstandard.ZstdDecompressor(dict_data=_dictionary(archive[8 : 8 + size])), 8 + size
    view = memoryview(archive)
    while at < len(archive):
        magic, size = struct.unpack_from("<II", archive, at)
        if magic in SKIPPABLE_FRAMES:
            at += 8 + size
            continue
        if magic != DATA_FRAME:
            raise ValueError(f"no frame starts at byte {at}")
        one, parts = unpack.decompressobj(), []
        step = 1 << 16
        while not one.eof:
            if at >= len(archive):
                raise ValueError("the last frame is cut off")
            parts.append(one.decompress(view[at : at + step]))
            at += min(step, len(archive) - at)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    """The fields of a record that ``make_record`` made; a payload that doesn't fit its digest is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where it should")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(v) if (v := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {"record_type": kind, "page_id": number("WARC-Record-ID"), "target_uri": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
            "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To")}


def write_archives(records: DataFrame, path: str, archive_bytes: int = 32 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``records`` (as of ``plan_records``) as archives under ``path``, a new folder; no record gives no archive.

    Each task fills archives of about ``archive_bytes`` before compression and
    holds one at a time; a record that is longer has an archive of its own or
    ends one. ``date`` is that of all records, so that equal input gives equal
    records. Files have the names that Spark's text writer gives them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([make_archive(held, level)], pa.binary())], ["archive"])
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("record_type", "page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"))):
                held.append(make_record(*(v.as_py() for v in row), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    # A revisit has no payload to send.
    sent = records.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")))
    archives = sent.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInArrow(work, "archive binary")
    archives.select(F.col("archive").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """record_type, page_id, target_uri, payload, payload_bytes, payload_digest and refers_to of all records under ``path``.

    Each payload is held against its digest; damaged archives are an error. A
    revisit has a null payload, and payload_bytes and payload_digest of that
    which it refers to. Without ``payloads`` they are checked and then left out.
    """
    form = "record_type string, page_id long, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    names = [f.split()[0] for f in form.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)
        for batch in batches:
            for archive in batch.column("content"):
                rows, size = [], 0
                for record in records_of(archive.as_py()):
                    rows.append(parse_record(record))
                    size += len(record)
                    if not payloads:
                        rows[-1]["payload"] = None
                    if size > 8 << 20:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, form)
