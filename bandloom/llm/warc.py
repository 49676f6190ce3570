"""WARC archives of web pages: records compressed one by one with a Zstandard dictionary of their own archive."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm.shared import materialize, new_path, with_lookup

#: Magic number of the skippable frame that holds an archive's dictionary, first in the file.
DICTIONARY_FRAME = 0x184D2A5D
#: An empty skippable frame, which the text writer puts after each record; readers skip it.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
#: Bytes of an archive's first records that its dictionary is built from, and the dictionary's size.
TRAIN_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Bytes of payload aimed at in one archive, each with its own dictionary.
ARCHIVE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
#: Payloads of fewer bytes are never revisits.
MIN_PAYLOAD = 0

_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, as in WARC-Payload-Digest."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or one that revisits page ``refers_to`` and leaves the payload out."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=-._~") if url else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    value = re.fullmatch(r"<urn:page:(none|-?\d+)>", urn)[1]
    return None if value == "none" else int(value)


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of an archive: its dictionary, built from the first records, and a frame for each record."""
    held, size = [], 0
    for item in records:
        held.append(item)
        size += len(item)
        if size >= TRAIN_BYTES:
            break
    if not held:
        return
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, held, level=LEVEL)
    except zstandard.ZstdError:  # too few records: their start is the dictionary
        trained = zstandard.ZstdCompressionDict(b"".join(held)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    yield struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained.as_bytes()
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    for item in held:
        yield packer.compress(item)
    for item in records:
        yield packer.compress(item)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, whose first frame is its dictionary."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_FRAME:
        raise ValueError("an archive starts with its dictionary")
    raw = content[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    stream = io.BufferedReader(unpacker.stream_reader(io.BytesIO(memoryview(content)[8 + size :]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {line[:20]!r}")
        fields = {}
        while (line := stream.readline().decode().rstrip("\r\n")):
            name, _, value = line.partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block


def planned(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``page_id, url, html, refers_to`` per row; refers_to is the page whose payload a row repeats.

    Of equal payloads (told by SHA-256 and length) of at least MIN_PAYLOAD bytes, the smallest page_id is a response, as
    are rows that repeat it; others revisit it. A null html is an empty payload. Among equal payloads without any page_id
    all are responses. Other columns are ignored. Rows are dealt over partitions of ``archive_bytes`` of payload on
    average, those of an often repeated payload over all of them.
    """
    rows = pages.selectExpr("cast(page_id AS long) AS page_id", "cast(url AS string) AS url", "coalesce(cast(html AS string), '') AS html")
    rows = rows.withColumn("key", F.sha2("html", 256))
    seen = materialize(rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.max(F.octet_length("html")).alias("size")), "warc-payloads")
    total = seen.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    parts = max(-(-total // archive_bytes), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    again = seen.where((F.col("n") > 1) & (F.col("size") >= MIN_PAYLOAD)).select("key", "first", "n")
    found = with_lookup(rows, again, "key", "n", outer=True, parts=parts)
    return found.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages``; every task's rows, of bounded size (``planned``), are one archive."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[k].as_py() for c in b.columns) for b in batches for k in range(b.num_rows))
        for frame in frames(record(*row) for row in rows):
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["frame"])

    planned(pages, archive_bytes).mapInArrow(of, "frame binary").selectExpr("cast(frame AS string) AS value").write.option("lineSep", EMPTY_FRAME).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record of the archives at ``path``.

    The payload of a response is checked against its digest; that of a revisit isn't in its record, whose HTTP header
    and WARC fields tell its length and digest.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in records(content.as_buffer().to_pybytes()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != sha1):
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} was changed")
                    refers = fields.get("WARC-Refers-To")
                    rows.append((_page(fields["WARC-Record-ID"]), length, sha1, fields["WARC-Type"], refers and _page(refers)))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(of, _OUT)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives and read them back; see ``planned`` and ``read``. An empty table gives an empty result."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
