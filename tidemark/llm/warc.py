"""WARC archives compressed record by record with a dictionary of their own.

Each page becomes one record, WARC/1.1. Of pages with equal payloads of at least ``SHORTEST`` bytes the one with the smallest id is a
``response``, the others are ``revisit`` records that name it and carry no payload. An archive begins with a skippable frame that
holds a Zstandard dictionary built from its records, and each record is a Zstandard frame of its own, so that any record can be
read from its offset. Zstandard tools read such a file given the dictionary.

Archives are written by Spark's text writer, whose line separator here is an empty skippable frame, so they can lie on any
store that Spark reaches. One archive is what one task writes: rows are dealt by number, so that archives are of about
equal size whatever ids or payloads repeat. The dictionary is trained on the archive's first ``SAMPLE_BYTES`` of records at most,
which are held for that; records behind them are compressed as they come.

A null payload counts as empty. A null id or address is left out of the record and read back as null; the smallest id of a group may be null,
which comes first. Control characters of an address are written percent-encoded. Rows that repeat id and payload are records of
their own: one is the response. No pages: no records.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, landed, record_batch, schema

SHORTEST = 100  # bytes of payload from which copies become revisits
ARCHIVE_BYTES = 32 << 20  # payload of an archive, before compression
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
DICTIONARY_FRAME = 0x184D2A5D  # fixed values: magic numbers of skippable and of data frames
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DATA_FRAME = 0xFD2FB528
SEPARATOR = struct.pack("<II", SKIPPABLE[0], 0)
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAMES = schema("frame binary")
RECORDS = schema(
    "archive string, offset long, length long, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def _identity(page_id: int | None, row: int) -> bytes:
    return b"<urn:x-page:%s:%d>" % (b"" if page_id is None else b"%d" % page_id, row)


def _page_id(identity: bytes) -> int | None:
    number = identity.split(b":")[2]
    return int(number) if number else None


def _address(url: str) -> bytes:
    return re.sub(rb"[\x00-\x1f\x7f]", lambda c: b"%%%02X" % c[0][0], url.encode())


def record(page_id, row, url, payload: bytes, digest: str, date: str, original: tuple[int | None, int] | None) -> bytes:
    """One record; a revisit if the page of its payload, ``original``, is another."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if original else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if original else b"response"),
        b"WARC-Record-ID: " + _identity(page_id, row),
        b"WARC-Date: " + date.encode(),
        b"Content-Type: application/http;msgtype=response",
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"Content-Length: %d" % len(block),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _address(url))
    if original:
        head += [b"WARC-Refers-To: " + _identity(*original), b"WARC-Profile: " + PROFILE]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[bytes, bytes]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}


def parsed(data: bytes) -> tuple:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of a record.

    Size and digest of a response are those of the payload found, of a revisit those it states.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = _headers(lines)
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    address, page_id = fields.get(b"warc-target-uri"), _page_id(fields[b"warc-record-id"])
    url = None if address is None else address.decode()
    kind, stated = fields[b"warc-type"].decode(), fields[b"warc-payload-digest"].decode().removeprefix("sha256:")
    if kind == "revisit":
        size = int(_headers(http.split(b"\r\n")[1:])[b"content-length"])
        return page_id, url, kind, _page_id(fields[b"warc-refers-to"]), size, stated, None
    found = hashlib.sha256(payload).hexdigest()
    if found != stated:
        raise ValueError("a payload does not have the digest its record states")
    return page_id, url, kind, None, len(payload), found, payload


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples; none where they are too few or too short to train one."""
    size = min(size, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return None


def _frames(date: str, sample_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, held, size = None, [], 0

        def begun() -> list[bytes]:
            nonlocal compressor
            dictionary = trained(held)
            compressor = zstandard.ZstdCompressor(LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
            first = []
            if dictionary is not None:
                data = dictionary.as_bytes()
                first.append(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
            out = first + [compressor.compress(r) for r in held]
            held.clear()
            return out

        for batch in byte_batches(batches, "payload"):
            records = []
            for row in batch.to_pylist():
                original = (row["keep_id"], row["keep_row"]) if row["keep_row"] is not None else None
                records.append(record(row["page_id"], row["row_id"], row["url"], row["payload"], row["digest"], date, original))
            if compressor:
                yield record_batch(FRAMES, [[compressor.compress(r) for r in records]])
                continue
            held += records
            size += sum(map(len, records))
            if size >= sample_bytes:
                yield record_batch(FRAMES, [begun()])
        if held:
            yield record_batch(FRAMES, [begun()])

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    date: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shortest: int = SHORTEST,
    archive_bytes: int = ARCHIVE_BYTES,
    sample_bytes: int = SAMPLE_BYTES,
) -> None:
    """Write a record per row of ``pages``, captured at ``date`` (such as ``2024-01-01T00:00:00Z``), as archives below ``folder``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).alias("size"),
        F.sha2(payload, 256).alias("digest"),
    )
    rows = landed(rows, "warc-pages")
    copies = rows.filter(F.col("size") >= shortest).groupBy("digest")
    copies = copies.agg(F.min(F.struct("page_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = landed(copies.select("digest", "keep.*").toDF("digest", "keep_id", "keep_row"), "warc-copies")
    # Both sides are written tables, so adaptive execution can split a payload that very many pages share.
    revisits = rows.select("row_id", "digest").join(copies, "digest").filter("row_id <> keep_row")
    revisits = landed(revisits.select("row_id", "keep_id", "keep_row"), "warc-revisits")
    total = rows.agg(F.sum("size")).first()[0] or 0
    dealt = rows.drop("size").repartition(max(1, -(-total // archive_bytes)), "row_id")
    dealt = dealt.join(revisits, "row_id", "left").sortWithinPartitions("row_id")
    frames = dealt.mapInArrow(_frames(date, sample_bytes), FRAMES)
    # The cast keeps the bytes as they are, and so does the writer.
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR.decode()).text(folder)


def frame_spans(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """Offset, length and whether it holds data of each frame of a file; nothing is decompressed."""
    at = 0
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic in SKIPPABLE:
            length = 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == DATA_FRAME:
            checksum = 4 if data[at + 4] & 4 else 0
            end = at + zstandard.frame_header_size(data[at : at + 18])
            last = False
            while not last:
                block = int.from_bytes(data[end : end + 3], "little")
                last = bool(block & 1)
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a run of one byte is stored as that byte
            length = end + checksum - at
        else:
            raise ValueError(f"no frame at {at}")
        yield at, length, magic == DATA_FRAME
        at += length


def opened(data: bytes) -> zstandard.ZstdDecompressor:
    """A decompressor for the frames of an archive, with the dictionary from its leading frame."""
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    return zstandard.ZstdDecompressor()


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data, name = content.as_py(), path.as_py().rsplit("/", 1)[-1]
                reader = opened(data)
                out: list[list] = [[] for _ in RECORDS]
                held = 0
                for at, length, is_record in frame_spans(data):
                    if not is_record:
                        continue
                    *fields, payload = parsed(reader.decompress(data[at : at + length]))
                    values = [name, at, length, *fields, payload if with_payload else None]
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    held += len(payload or b"") if with_payload else 64
                    if held > 4 << 20:
                        yield record_batch(RECORDS, out)
                        out, held = [[] for _ in RECORDS], 0
                yield record_batch(RECORDS, out)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives below ``folder``, with the archive, offset and length it can be read from alone."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_read(with_payload), RECORDS)
