"""WARC archives with a shared Zstandard dictionary, written and read by Spark.

`write_archives` turns rows (id, uri, payload) into WARC/1.1 records, one per row. Equal payloads of at least
`min_bytes` bytes are stored once: the row with the largest id is a `response`, the others are `revisit` records that
refer to it. A dictionary is trained on a bounded sample of records, every file begins with it in a skippable frame,
and every record is a Zstandard frame of its own. Files are written through Spark's committed text sink (bytes pass
unchanged; its line separator is an empty skippable frame, which every Zstandard reader steps over), so a lost
executor or a second attempt leaves no half archive. `read_archives` decodes such files from any Spark path.

Defined results: a null payload is empty; a null id gives a `response` that is never referred to (its record id is
"null"); rows that repeat an id with the same payload as the chosen response are all responses; an empty table writes
no file and reads back as no row; a sample too small to train on gives archives without a dictionary frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path

#: Magic numbers of skippable frames (any of 16 for padding, this one for dictionaries), and the profile of revisits.
DICTIONARY_MAGIC = 0x184D2A5D
PADDING = struct.pack("<II", 0x184D2A50, 0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SENT_DIGESTS = 500_000  # digests of repeated payloads that go to every task; beyond, payloads are dealt out by digest
RECORDS = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, with the full payload's length, and no payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        fields.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[int | None, str | None, str, int | None, int, str, bytes | None]:
    """The RECORDS columns of one record. Length and digest are those of the bytes read, or of the head for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    number = lambda x: None if x.endswith(":null>") else int(x.rpartition(":")[2][:-1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, refers, length, digest, payload if kind == "response" else None


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary, or nothing if the samples are too few."""
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 3,
    dictionary_bytes: int = 65_536,
    sample_records: int = 400,
    sample_bytes: int = 6 << 20,
) -> None:
    """Write the archives under `path`. The dictionary sees whole records, of the `sample_records` with the smallest hashes
    those that fit into `sample_bytes` one after the other."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("string")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    hashed = rows.withColumn("h", F.xxhash64("page_id", "uri"))
    drawn = hashed.select("h", F.octet_length("payload").alias("size")).orderBy("h", "size").limit(sample_records).collect()  # lengths alone meet
    chosen, left = [], sample_bytes
    for r in drawn:
        if r["size"] <= left:
            chosen.append(r["h"])
            left -= r["size"]
    fits = F.octet_length("payload") <= sample_bytes
    sample = hashed.filter(F.col("h").isin(chosen) & fits).orderBy("h", F.octet_length("payload"), "payload").limit(len(chosen)).collect() if chosen else []
    trained = train_dictionary([record(r["page_id"], r["uri"], r["payload"].encode(), None, date) for r in sample], dictionary_bytes)

    keyed = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("large", F.octet_length("payload") >= min_bytes)
    again = (
        keyed.filter("large and page_id is not null").groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").select("digest", "response")
    )  # only payloads that occur again: small, and unique by digest
    again = F.broadcast(again) if again.count() <= SENT_DIGESTS else again  # then payloads stay where they are
    decided = keyed.join(again, "digest", "left").select("page_id", "uri", "payload", F.when(F.col("large") & (F.col("page_id") != F.col("response")), F.col("response")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)
        first = [struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained] if trained else []
        for batch in batches:
            ids, uris, bodies, refs = (batch.column(c) for c in range(4))
            out = first + [press.compress(record(i, u, b or b"", r, date)) for i, u, b, r in zip(ids.to_pylist(), uris.to_pylist(), bodies.cast(pa.binary()).to_pylist(), refs.to_pylist(), strict=True)]
            first = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    frames = decided.mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", PADDING.decode("ascii")).text(path)
    _name_files(pages, path)


def _name_files(df: DataFrame, path: str) -> None:
    """part-….txt → part-….warc.zst: one rename a file in the file system's index."""
    jvm = df.sparkSession._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(root, name.removesuffix(".txt") + ".warc.zst"))


def frames_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive file, in order."""
    at, press = 0, zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at + 8 <= len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == DICTIONARY_MAGIC:
            press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
        elif 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + size
        else:
            frame = press.decompressobj()
            out, step = [], 0
            while not frame.eof:
                chunk = view[at + step : at + step + 65_536]
                if not chunk:
                    raise ValueError("archive ends within a frame")
                out.append(frame.decompress(chunk))
                step += len(chunk)
            at += step - len(frame.unused_data)
            yield b"".join(out)


def read_archives(spark, path: str, *, payloads: bool = True) -> DataFrame:
    """RECORDS rows of all archives under `path`; payload is null for revisits, or everywhere without `payloads`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for data in frames_of(content.as_py()):
                    row = parse_record(data)
                    rows.append(row if payloads else (*row[:6], None))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write the archives to the shared folder, read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path, **how)
    return read_archives(spark, path, payloads=False).drop("payload")
