"""WARC archives: one gzip member per record, and a sequential reader that verifies them.

Writer: each task writes archives of at most ``archive_bytes`` (compressed) into the shared
folder and returns a manifest of what it finished. The manifest is itself a table, committed
by Spark, so files of lost or repeated attempts are never read.

Reader: inflates a file piece by piece with ``zlib.decompressobj``; where a member ends the
next one begins with the unused bytes. A record's header is read up to the empty line, its
block by ``Content-Length``, then CR LF CR LF must follow and the member must end. Block and
payload digests are verified. Memory: one record and one piece of the file.

Records are ``response`` with the HTTP head and payload as block, or, for a payload already
held by another page, ``revisit`` with the HTTP head alone: its ``Content-Length`` and the
payload digest are those of the full payload.

Defined results: null or empty html is an empty payload; payloads under ``dedup_bytes`` are
always response; repeated rows each get a record, and those of the smallest page_id of a
payload are all response; rows with a null page_id get a response record that nothing refers
to; a null url is left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path

ARCHIVE_BYTES, DEDUP_BYTES, PIECE = 128 << 20, 100, 1 << 16
#: Most tasks that read archives at once.
READERS = 10_000
WARC_DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long, bytes long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


class WarcError(ValueError):
    """An archive that isn't framed as it should be, or whose digests don't match."""


def _digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: bytes) -> bytes:
    """One record, uncompressed. ``digest``: SHA-256 of the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {WARC_DATE}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "WARC-Payload-Digest: sha256:" + base64.b32encode(digest).decode(),
        "WARC-Block-Digest: " + _digest(block),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + END + block + END


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member of the stream, an iterator of its inflated pieces. Consume each before the next."""
    raw = stream.read(PIECE)
    while raw:
        z = zlib.decompressobj(31)

        def pieces(z=z) -> Iterator[bytes]:
            nonlocal raw
            while not z.eof:
                if not raw:
                    raw = stream.read(PIECE)
                    if not raw:
                        raise WarcError("the archive ends within a gzip member")
                try:
                    out = z.decompress(raw, PIECE)
                except zlib.error as e:
                    raise WarcError(f"not a gzip member: {e}") from e
                raw = z.unused_data if z.eof else z.unconsumed_tail
                if out:
                    yield out
            raw = raw or stream.read(PIECE)

        yield pieces()


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, one gzip member at a time."""
    for inflated in members(stream):
        buf = bytearray()
        head = -1
        for piece in inflated:
            seen = max(0, len(buf) - 3)
            buf += piece
            if head < 0 and (head := buf.find(END, seen)) >= 0:
                break
        if head < 0:
            raise WarcError("a record without a header")
        first, *lines = bytes(buf[:head]).decode("utf-8").split("\r\n")
        if not first.startswith("WARC/1."):
            raise WarcError(f"not a WARC version line: {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        try:
            size = int(fields["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record without a Content-Length") from e
        del buf[: head + 4]
        for piece in inflated:
            buf += piece
            if len(buf) > size + 4:
                break
        if len(buf) != size + 4 or buf[size:] != END:
            raise WarcError(f"a block of {size} bytes isn't followed by CR LF CR LF and the member's end")
        block = bytes(buf[:size])
        if fields.get("warc-block-digest", d := _digest(block)) != d:
            raise WarcError("a block digest doesn't match")
        yield fields, block


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(fields: dict[str, str], block: bytes) -> tuple:
    """A row of ``RECORD``; verifies a response's payload digest."""
    head, _, payload = block.partition(END)
    length = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    want = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha256:"))
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).digest() != want):
        raise WarcError("a payload doesn't match its length or digest")
    refers = fields.get("warc-refers-to")
    return (
        _page(fields["warc-record-id"]),
        fields.get("warc-target-uri"),
        kind,
        _page(refers) if refers else None,
        length,
        want.hex(),
        payload if kind == "response" else None,
    )


def write_archives(
    pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, dedup_bytes: int = DEDUP_BYTES
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; returns the manifest, materialised.

    Who refers to whom: the smallest page_id by payload digest, aggregated map-side so that a
    payload of a third of all pages is a few partial rows, then joined back for payloads held
    by several pages only. Each page crosses the network once, keyed by digest; a hot digest's
    side is the many side of a sort-merge join, which adaptive execution splits.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest"),
    )
    first = (
        rows.where(F.octet_length("html") >= dedup_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
        .where("first_id < last_id")
        .select("digest", "first_id")
    )
    known = rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, records, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            for page, url, text, digest, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers = first_id if page is not None and first_id is not None and page != first_id else None
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(record(page, url, text.encode(), refers, digest)) + z.flush()
                if out is not None and size + len(member) > archive_bytes:
                    yield done()
                    out = None
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                records += 1
                size += len(member)
        if out is not None:
            yield done()

    return materialise(known.mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in a manifest, as ``RECORD``; without ``payloads`` that column is null.

    Archives are dealt out by name; each is read by one task from front to back, and its size
    is bounded by the writer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        schema = pa.schema(list(zip(names, types, strict=True)))

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, found = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None, buffer_size=PIECE) as f:
                    for fields, block in read_records(f):
                        row = parse(fields, block)
                        rows.append(row if payloads else (*row[:-1], None))
                        found += 1
                        held += len(block) if payloads else 300
                        if held > 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if found != records:
                    raise WarcError(f"{name} has {found} records; its manifest has {records}")
                if rows:
                    yield made(rows)

    # a stated number, for the tiny rows of a manifest would else be gathered in one task
    return manifest.repartition(max(1, min(READERS, manifest.count())), "archive").mapInArrow(run, RECORD)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, the cluster's default if it names none, as :mod:`pyarrow.fs` writes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, _, rest = whole.partition(":")
    return f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }://{rest if not rest.startswith('//') else rest[2:]}"


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Archive ``pages`` in a fresh shared folder and read the archives back."""
    folder = qualified(pages.sparkSession, scratch_path(pages.sparkSession, "warc"))
    return read_archives(write_archives(pages, folder), folder, payloads)
