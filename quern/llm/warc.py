"""WARC archives of pages: a writer, and a sequential reader.

Archives lie in the shared folder, one for each task, one gzip member for each record. The reader takes an archive
as a stream: zlib inflates it piece by piece, a record's content length frames its block, and the digests of block and
payload are verified; it holds one record at a time.

Of pages with equal payloads of at least `least` bytes the one with the smallest page_id is the response, the
others revisit it and have no payload of their own.

Defined results: null html is an empty payload; a null url has no WARC-Target-URI; a null page_id comes before all
others; rows that share page_id and payload are all response; payloads of any length are written and read whole; other
columns are ignored; an empty table gives no archive and an empty table. A damaged archive, one whose records tell no
content length among them, raises ValueError. Digests by sha256, sha1, md5 and sha512, in hexadecimal or base32, are
verified; a digest of another kind raises ValueError, as it can't be.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import NULL_ID, column, shared_path, written

LEAST, DATE, PIECE = 100, "2024-01-01T00:00:00Z", 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary, archive string, offset long"


def _id(page_id: int) -> str:
    return f"<urn:page:{'null' if page_id == NULL_ID else page_id}>"


def _page(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, compressed as one gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class Inflated:
    """Reads gzip members from a stream, piece by piece."""

    def __init__(self, stream):
        self.stream, self.raw, self.at = stream, b"", 0

    def member(self) -> bool:
        """Begins the next member; False at the end."""
        if not self.raw:
            self.raw = self.stream.read(PIECE)
        self.begin = self.at
        self.inflater, self.ready = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def more(self) -> bool:
        if self.inflater.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(PIECE)
            if not self.raw:
                raise ValueError(f"the archive ends within the member at {self.begin}")
        try:
            self.ready += self.inflater.decompress(self.raw, PIECE)
        except zlib.error as e:
            raise ValueError(f"the member at {self.begin} is damaged: {e}") from e
        rest = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        self.at += len(self.raw) - len(rest)
        self.raw = rest
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                raise ValueError(f"the record at {self.begin} has no end of its head")
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError(f"the record at {self.begin} is shorter than its content length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def close(self) -> None:
        while self.more():
            pass
        if self.ready:
            raise ValueError(f"the member at {self.begin} has more than one record")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _length(told: dict[str, str], at: int) -> int:
    if not re.fullmatch(r"\d+", told.get("content-length", "")):
        raise ValueError(f"the record at {at} tells no content length")
    return int(told["content-length"])


def _verify(data: bytes, digest: str | None, what: str) -> None:
    """Raises unless data has the digest, `name:value`."""
    if not digest:
        return
    name, _, value = digest.partition(":")
    if name.lower().replace("-", "") not in ("md5", "sha1", "sha256", "sha512"):
        raise ValueError(f"{what} has a digest of a kind that can't be verified: {name}")
    own = hashlib.new(name.lower().replace("-", ""), data).digest()
    if value.lower() != own.hex() and value.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("="):
        raise ValueError(f"{what} doesn't have its digest")


def read_records(stream) -> Iterator[dict]:
    """The records of one archive, in order, each verified. payload_bytes is what a response has, and what a revisit's HTTP head tells."""
    source = Inflated(stream)
    while source.member():
        at = source.begin
        head = source.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        told = _fields(head)
        block = source.take(_length(told, at))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is longer than its content length")
        source.close()
        _verify(block, told.get("warc-block-digest"), f"the block at {at}")
        kind, size, payload = told.get("warc-type"), None, None
        if told.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            if kind == "response":
                size = len(payload)
            elif re.fullmatch(r"\d+", length := _fields(http).get("content-length", "")):
                size = int(length)
        digest = told.get("warc-payload-digest")
        if kind == "response":
            _verify(payload or b"", digest, f"the payload at {at}")
        yield {
            "page_id": _page(told.get("warc-record-id")), "record_type": kind, "refers_to": _page(told.get("warc-refers-to")), "target_uri": told.get("warc-target-uri"), "payload_bytes": size,
            "payload_digest": digest.partition(":")[2] if digest else None, "payload": payload if kind == "response" else None, "offset": at,
        }


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes the archives; (archive, records, bytes) of those that count, as a written table.

    A task that is run again writes another file, and only the file of the run that succeeded is listed.
    """
    root = shared_path(pages.sparkSession, "warc")
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("met"), "first")
    # small payloads never revisit, and get keys of their own, so that they don't meet in one task
    rows = rows.withColumn("meet", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    rows = rows.join(first, F.col("meet") == F.col("met"), "left").select("page_id", "url", "payload", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))

    def run(batches):
        where, path, sink, n, size = None, "", None, 0, 0
        for batch in batches:
            cols = [column(batch, c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                if sink is None:
                    where, path = fs.FileSystem.from_uri(root)
                    where.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink = where.open_output_stream(f"{path}/{name}", compression=None)
                packed = record(*(c[i].as_py() for c in cols))
                sink.write(packed)
                n, size = n + 1, size + len(packed)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([n]), pa.array([size])], ["archive", "records", "bytes"])

    return written(rows.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of all archives of a table with their URIs: RECORDS, a task for each archive at most."""
    spark: SparkSession = archives.sparkSession
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def run(batches):
        for batch in batches:
            for uri in column(batch, "archive").to_pylist():
                where, path = fs.FileSystem.from_uri(uri)
                with where.open_input_stream(path, compression=None) as stream:
                    held, size = [], 0
                    for r in read_records(stream):
                        size += r["payload_bytes"] or 0
                        held.append(r | {"archive": uri} | ({} if with_payload else {"payload": None}))
                        if size > 1 << 22 or len(held) == 5000:
                            yield packed(held)
                            held, size = [], 0
                    yield packed(held)

    def packed(rows):
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary(), "offset": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)

    tasks = max(1, min(archives.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return archives.select("archive").repartition(tasks).mapInArrow(run, RECORDS)


#: op1's digests in DuckDB SQL, over the view pages.
SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as response from p),
j as (select *, payload_bytes >= {LEAST} and response < page_id as again from f)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then response end as refers_to from j
"""
