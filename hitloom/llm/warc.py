"""WARC archives: one gzip member per record, written and read record by record.

Tasks write archives of their own under fresh names and return a manifest; only archives that a finished task
lists count, so a task that runs twice leaves an orphan and no duplicate. Reading hands whole
archives to tasks. Each is read front to back in small pieces: the members are decompressed as they arrive, a record's
length comes from its header, and digests are checked. One record is in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.columns import back, own
from hitloom.operators.lookups import skew_proof_lookup

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"

ARCHIVE_BYTES = 512 << 20
_PIECE = 1 << 16
_ROWS_OUT = 256
_LEVEL = 4

MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _header_value(text: str) -> str:
    """Control characters and spaces percent-encoded, so that no value can end its line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record_bytes(
    record_type: str, record_id: str, date: str, payload: bytes,
    target_uri: str | None = None, refers_to: str | None = None,
) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    if record_type != "revisit":
        block += payload
    lines = [VERSION, f"WARC-Type: {record_type}", f"WARC-Record-ID: <{_header_value(record_id)}>", f"WARC-Date: {date}"]
    if target_uri is not None:
        lines.append(f"WARC-Target-URI: {_header_value(target_uri)}")
    if record_type == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_header_value(refers_to or '')}>"]
    lines += [
        f"Content-Type: {HTTP_TYPE}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member, decompressed piece by piece."""
    inflate, held = zlib.decompressobj(31), bytearray()
    started = False
    while piece := stream.read(_PIECE):
        while piece:
            started = True
            held += inflate.decompress(piece)
            piece = b""
            if inflate.eof:
                yield bytes(held)
                piece = inflate.unused_data
                inflate, held, started = zlib.decompressobj(31), bytearray(), False
    if started:
        raise ValueError("the archive ends inside a gzip member")


def _fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def parse_record(content: bytes) -> dict:
    """Take a record apart; ValueError if its framing or a digest is wrong."""
    head, found, rest = content.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    fields = _fields(head)
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest)} bytes, {length + 4} announced")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    announced = int(_fields(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != announced or sha1_base32(payload) != digest):
        raise ValueError("wrong payload digest")
    refers_to = fields.get("warc-refers-to")
    return {
        "record_type": fields["warc-type"],
        "record_id": fields["warc-record-id"].strip("<>"),
        "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "refers_to": None if refers_to is None else refers_to.strip("<>"),
        "payload_digest": digest,
        "payload_bytes": announced,
        "payload": None if revisit else payload,
    }


def mark_revisits(rows: DataFrame, id_column: str, payload_column: str, least_bytes: int = 0) -> DataFrame:
    """Append ``record_type`` and ``refers_to``.

    Of rows with equal payloads of at least ``least_bytes``, that with the largest id is the response and the
    others revisit it; shorter ones are responses. Null ids come last; rows repeated with the
    largest id are all responses. Payloads that own many rows are looked up in a small broadcast.
    """
    digest = F.sha1(F.col(f"`{payload_column}`"))
    identity = F.col(f"`{id_column}`").alias("_id")
    keyed = rows.select(*own(rows, ("record_type", "refers_to")), identity, F.when(F.octet_length(f"`{payload_column}`") >= least_bytes, digest).alias("_digest"))
    largest = keyed.filter("_digest is not null").groupBy("_digest").agg(
        F.max("_id").alias("_largest"), F.count("*").alias("_rows")
    )
    answers = largest.withColumn("_answer", F.when(F.col("_rows") > 1, F.struct("_largest")))
    marked = skew_proof_lookup(keyed, "_digest", answers, "_digest", "_answer", "_rows", "_original", ["_id"])
    revisits = F.col("_original").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_original._largest"))
    return marked.select(
        *back(rows, ("record_type", "refers_to")),
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisits, F.col("_original._largest")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write records to ``folder``, a path or URI that all executors share; the manifest comes back.

    Columns used: ``record_type``, ``record_id``, ``date``, ``target_uri`` (may be null), ``refers_to`` and
    ``payload`` (binary; null is empty). Every row is a record; no rows give no archive. The manifest
    is lazy: store it, and read the archives by the stored one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        stream, name, count, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in range(batch.num_rows):
                values = {f: batch.column(i)[row].as_py() for i, f in enumerate(batch.schema.names)}
                if stream is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                content = record_bytes(
                    values["record_type"], values["record_id"], values["date"], values["payload"] or b"",
                    values["target_uri"], values["refers_to"],
                )
                deflate = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                packed = deflate.compress(content) + deflate.flush()
                stream.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= archive_bytes:
                    stream.close()
                    done.append((f"{folder}/{name}", count, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((f"{folder}/{name}", count, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["path", "records", "bytes"],
        )

    wanted = records.select("record_type", "record_id", "date", "target_uri", "refers_to", F.col("payload").cast("binary").alias("payload"))
    return wanted.mapInArrow(run, MANIFEST)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives that ``manifest`` lists in ``path``.

    A record whose framing or digest is wrong, or an archive cut short, fails the task. The payload of a
    revisit is null; its ``payload_bytes`` and ``payload_digest`` are those of the full payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                filesystem, name = fs.FileSystem.from_uri(path)
                rows: list[dict] = []
                held = 0
                with filesystem.open_input_stream(name, compression=None) as stream:
                    for content in members(stream):
                        rows.append(parse_record(content))
                        if not with_payload:
                            rows[-1]["payload"] = None
                        held += len(rows[-1]["payload"] or b"")
                        if len(rows) >= _ROWS_OUT or held >= 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    text = pa.string()
    schema = pa.schema(
        [(n, text) for n in ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")]
        + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
    )
    return manifest.select("path").mapInArrow(run, RECORDS)


def stored_manifest(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Run the writers, keep the manifest at ``path``, and return it dealt out by archive."""
    manifest.write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path).repartition(F.col("path"))
