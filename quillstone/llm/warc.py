"""WARC archives: a writer and a sequential reader, one gzip member per record.

Reader: members are inflated incrementally with zlib from a bounded read buffer;
the header block is read up to its empty line, Content-Length then says how many
bytes the block takes, and the payload's SHA-1 is checked against
WARC-Payload-Digest as it passes. Memory holds the headers and one read buffer,
and the payload of one record where the caller asks for payloads.

Files are opened through ``pyarrow.fs`` by URI, so the shared folder may be a
mounted path or a store that pyarrow knows. A writer task writes to a name of
its own and renames at the end, so a lost and repeated task leaves one archive.

Defined results: null html is an empty payload; an empty table gives no archive
and no row; rows that repeat the largest page_id of a payload are all responses;
a null page_id is never the response of a payload that another id carries, and
comes back as null; extra columns of ``pages`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._shared import new_shared_path, table

READ_BYTES = 1 << 16
ROWS_BYTES = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, archive string"


class WarcError(ValueError):
    """A record that breaks the format: truncated, badly framed, or with a wrong digest."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def _open(uri: str, mode: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store, path, store.open_output_stream(path, compression=None)
    return store, path, store.open_input_stream(path, compression=None)


def digest_label(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def digest_hex(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def encode_record(headers: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class _Member:
    """One gzip member, inflated as far as its reader asks."""

    def __init__(self, stream: BinaryIO, rest: bytes):
        self.stream, self.rest = stream, rest
        self.z, self.held = zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflate another piece; False once the member has ended."""
        if self.z.eof:
            return False
        self.rest = self.rest or self.stream.read(READ_BYTES)
        if not self.rest:
            raise WarcError("archive ends inside a gzip member")
        try:
            self.held += self.z.decompress(self.rest, READ_BYTES * 4)
        except zlib.error as e:
            raise WarcError(f"bad gzip member: {e}") from e
        self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def headers(self) -> dict[str, str]:
        """The header block, up to its empty line."""
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(self.held) - 3)
            if not b"WARC/".startswith(self.held[:5]) or not self.more():
                raise WarcError("no WARC header block")
        lines = self.held[:end].decode("utf-8").split("\r\n")
        del self.held[: end + 4]
        if not lines[0].startswith("WARC/"):
            raise WarcError("no WARC header block")
        return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def block(self, size: int) -> Iterator[bytes]:
        """``size`` bytes in pieces of at most what one step inflates, then the end of the record and of the member."""
        left = size
        while left:
            if not self.held and not self.more():
                raise WarcError(f"Content-Length is {size}, the block has {size - left} bytes")
            piece = bytes(self.held[:left])
            del self.held[: len(piece)]
            left -= len(piece)
            if piece:
                yield piece
        while len(self.held) <= 4 and self.more():
            pass
        if self.held != b"\r\n\r\n":
            raise WarcError(f"Content-Length is {size}, the record does not end there")


def streamed_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(headers, pieces of the block) of each record. Content-Length says how much is read; no record is held whole. Pieces that the caller leaves are read over."""
    rest = b""
    while rest := rest or stream.read(READ_BYTES):
        member = _Member(stream, rest)
        headers = member.headers()
        length = headers.get("Content-Length", "")
        if not (length.isascii() and length.isdigit()):
            raise WarcError("no valid Content-Length")
        pieces = member.block(int(length))
        yield headers, pieces
        for _ in pieces:
            pass
        rest = member.rest


def verified(headers: dict[str, str], pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The pieces as they are; after the last one an error if their SHA-1 is not the payload digest. Revisits carry another record's digest."""
    label, sha1 = headers.get("WARC-Payload-Digest"), hashlib.sha1()
    for piece in pieces:
        sha1.update(piece)
        yield piece
    if label and headers.get("WARC-Type") != "revisit" and digest_hex(label) != sha1.hexdigest():
        raise WarcError(f"digest differs in {headers.get('WARC-Record-ID')}")


def read_records(stream: BinaryIO, verify: bool = True) -> Iterator[Record]:
    """Whole records of an archive. Checks framing and, if verify, each payload digest."""
    for headers, pieces in streamed_records(stream):
        yield Record(headers, b"".join(verified(headers, pieces) if verify else pieces))


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to.

    Only ids and digests are grouped and joined to find the response of each
    repeated payload; the html itself is not shuffled while the revisits are few
    enough for Spark to broadcast, and else once, by page_id.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    ids = base.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    response = ids.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    revisits = ids.join(response, "payload_digest").filter("not page_id <=> refers_to").select(F.col("page_id").alias("revisit_id"), F.col("payload_digest").alias("revisit_digest"), "refers_to").distinct()
    joined = base.join(revisits, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("payload_digest") == F.col("revisit_digest")), "left")
    return joined.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def write_archives(plan: DataFrame, folder: str, level: int = 6) -> list[str]:
    """Write one archive per partition; returns the archives' URIs (one per task, a few bytes each)."""

    def task(batches):
        number = TaskContext.get().partitionId()
        final, out, n = f"{folder}/part-{number:06d}.warc.gz", None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    store, path, out = _open(f"{final}.{uuid.uuid4().hex}.tmp", "w")
                shown = "null" if r["page_id"] is None else r["page_id"]
                headers = {"WARC-Type": r["record_type"], "WARC-Record-ID": f"<urn:page:{shown}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": digest_label(r["payload_digest"]), "X-Payload-Bytes": str(r["payload_bytes"]), "Content-Type": "text/html; charset=utf-8"}
                if r["url"]:
                    headers["WARC-Target-URI"] = "".join(c if c > " " else f"%{ord(c):02X}" for c in r["url"])
                if r["record_type"] == "revisit":
                    headers |= {"WARC-Refers-To": f"<urn:page:{r['refers_to']}>", "WARC-Profile": REVISIT_PROFILE}
                out.write(encode_record(headers, b"" if r["record_type"] == "revisit" else r["payload"], level))
                n += 1
        if out is not None:
            out.close()
            store.move(path, path[: -len(".tmp") - 33])
            yield pa.RecordBatch.from_pydict({"archive": [final], "records": pa.array([n], pa.int64())})

    return sorted(r["archive"] for r in plan.mapInArrow(task, "archive string, records long").collect())


def read_archives(spark: SparkSession, archives: list[str], payload: bool = True) -> DataFrame:
    """Every record of the archives, each digest verified; one task reads an archive from start to end.

    Without ``payload`` that column is null and blocks pass through a task piece by piece, however long they are.
    """

    def page(urn: str | None) -> int | None:
        number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number.lstrip("-").isdigit() else None

    def task(batches):
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("archive", pa.string())])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                with _open(uri, "r")[2] as stream:
                    for headers, pieces in streamed_records(stream):
                        size, n, block = int(headers["X-Payload-Bytes"]), 0, []
                        for piece in verified(headers, pieces):
                            n += len(piece)
                            if payload:
                                block.append(piece)
                        if headers["WARC-Type"] == "response" and size != n:
                            raise WarcError(f"payload of {headers['WARC-Record-ID']} has {n} bytes")
                        rows.append({"record_id": headers["WARC-Record-ID"], "page_id": page(headers["WARC-Record-ID"]), "url": headers.get("WARC-Target-URI"), "record_type": headers["WARC-Type"], "refers_to": page(headers.get("WARC-Refers-To")), "payload_digest": digest_hex(headers["WARC-Payload-Digest"]), "payload_bytes": size, "payload": b"".join(block) if payload else None, "archive": uri})
                        held += n if payload else 0
                        if held > ROWS_BYTES or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    names = spark.createDataFrame([(x,) for x in archives], "archive string").repartition(max(1, len(archives)))
    return names.mapInArrow(task, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder and read them back; the result needs digests and sizes, so payloads are verified and not held."""
    archives = write_archives(plan_records(table(spark, sf_dir, "pages")), new_shared_path(spark, "warc"))
    return read_archives(spark, archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB: SHA-1 over the UTF-8 payload; the response is the largest page_id of equal payloads of 1000 bytes or more.
ORACLE_OP1 = """
with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, '')))::bigint b from pages),
g as (select h, max(page_id) m from p where b >= 1000 group by h having count(*) > 1)
select p.page_id, p.b as payload_bytes, sha1(p.h) as payload_digest,
  case when g.m is not null and p.page_id is distinct from g.m then 'revisit' else 'response' end as record_type,
  case when g.m is not null and p.page_id is distinct from g.m then g.m end as refers_to
from p left join g on p.h = g.h"""
