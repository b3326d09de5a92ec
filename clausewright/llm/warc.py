"""WARC archives as a chunked record table.

Reading gives one row for each chunk of a record: record id, chunk number, the chunk's length (and bytes, if asked
for) and the SHA-1 of the payload up to its end, so a payload of any size passes in pieces of CHUNK bytes and the last
row of a record has its digest. Writing streams a payload from where it lies in memory through the compressor in pieces
of CHUNK; the whole record is never put together.

Of records with equal payloads one is a response; the others revisit it and carry no payload, but its digest and,
in their HTTP header, its length. Equal payloads are found by digest and length before writing: the table of those
that occur more than once is sent to all executors when it is small (SENT rows) and joined by a shuffle when not.

Archives are gzip files with one member a record, in a folder that all executors share; any file system that pyarrow
opens by its URI will do. A task writes under a name of its own and then renames, so a task that is run again replaces
its file. Each file is listed with its size when it is written; reading goes by that list, several files a task.

Defined results: a null payload is empty, and empty payloads are equal; a null url is an empty target; among rows with
the largest page_id of a payload one is the response; a null page_id counts as the smallest and is read back as null;
an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CHUNK = 1 << 16
LINE = 1 << 20  # a header line is not longer
SENT = 200_000
DATE = "2000-01-01T00:00:00Z"
_NULL_ID = 1 << 64


def record_id(page_id: int | None) -> str:
    """A UUID whose low half is the page's id; a bit of the high half stands for no id."""
    low = _NULL_ID if page_id is None else page_id & 0xFFFFFFFFFFFFFFFF
    x = f"{low:032x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def page_of(record: str) -> int | None:
    low = int(re.sub(r"[^0-9a-f]", "", record.split("uuid:")[1]), 16)
    if low >= _NULL_ID:
        return None
    return low - (1 << 64) if low >> 63 else low


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def planned(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with record_type and refers_to."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    narrow = keyed.select("digest", "size", "page_id")
    again = narrow.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("page")).where("n > 1")
    again = C.cut(again.select(F.col("digest").alias("d"), F.col("size").alias("s"), "page", "n"))
    many = again.count()
    small = F.broadcast(again.drop("n")) if many <= SENT else again.drop("n")
    if many <= SENT:
        joined = keyed.join(small, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    else:  # a payload may be on a third of all rows
        mark = lambda d, s: F.concat(d, F.lit(":"), s.cast("string"))
        joined = C.salted_join(
            keyed.withColumn("_mark", mark(F.col("digest"), F.col("size"))).withColumn("_nth", F.xxhash64("page_id", "url")), again.withColumn("_mark", mark(F.col("d"), F.col("s"))),
            "_mark", "_nth", "left", counts=again.select(mark(F.col("d"), F.col("s")).alias("_mark"), "n"),
        )
    top = F.col("page_id").eqNullSafe(F.col("page"))
    # several rows may have the largest id: only these few are numbered, a row for each payload as a rule
    if many and not narrow.join(small, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")) & top).groupBy("d", "s").count().where("count > 1").isEmpty():
        ties = joined.where(F.col("d").isNotNull() & top).withColumn("nth", F.row_number().over(Window.partitionBy("d", "s").orderBy("url")))
        joined = joined.where(F.col("d").isNull() | ~top).withColumn("nth", F.lit(1)).unionByName(ties)
    else:
        joined = joined.withColumn("nth", F.lit(1))
    first = F.col("d").isNull() | (top & (F.col("nth") == 1))
    return joined.select("page_id", "url", "html", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("page")).alias("refers_to"))


def _header(pairs: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def record_bytes(page_id, url, payload: memoryview, kind: str, refers_to, chunk: int = CHUNK) -> Iterator[bytes | memoryview]:
    """A record in pieces, before compression."""
    digest = hashlib.sha1()
    for at in range(0, len(payload), chunk):
        digest.update(payload[at : at + chunk])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = len(payload) if kind == "response" else 0
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    pairs = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{base32(digest.digest())}")]
    if kind == "revisit":
        pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    yield _header([*pairs, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + body))])
    yield http
    for at in range(0, body, chunk):
        yield payload[at : at + chunk]
    yield b"\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def write(plan: DataFrame, folder: str, chunk: int = CHUNK, level: int = 1) -> DataFrame:
    """Writes plan (page_id, url, html, record_type, refers_to) and returns (file, bytes, records) of what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _filesystem(folder)
        name = f"part-{task.partitionId():06d}.warc.gz"
        out, records = None, 0
        for batch in batches:
            ids, urls, kinds, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for first, last, parts in C.text_blocks(batch.column(2)):
                for i, payload in zip(range(first, last), parts, strict=True):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/.{name}.{task.taskAttemptId()}", compression=None)
                        out.write(b"")
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    for piece in record_bytes(ids[i], urls[i], payload, kinds[i], refers[i], chunk):
                        if packed := member.compress(piece):
                            out.write(packed)
                    out.write(member.flush())
                    records += 1
        if out is not None:
            size = out.tell()
            out.close()
            store.move(f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}")
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], schema=C.fields("file:s,bytes:l,records:l"))

    return plan.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, "file string, bytes long, records long")


class _Member:
    """The lines and bytes of a gzip file whose members follow one another."""

    def __init__(self, stream, chunk: int):
        self.stream, self.chunk, self.held, self.ended = stream, chunk, bytearray(), False
        self.unpack = zlib.decompressobj(31)
        self.packed = b""

    def fill(self) -> bool:
        """More bytes, at most chunk of them at once."""
        while True:
            if not self.packed:
                self.packed = self.stream.read(self.chunk)
                if not self.packed:
                    return False
            got = self.unpack.decompress(self.packed, self.chunk)
            if self.unpack.eof:  # the next member
                self.packed, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
            else:
                self.packed = self.unpack.unconsumed_tail
            if got:
                self.held += got
                return True

    def line(self) -> bytes | None:
        while (at := self.held.find(b"\r\n")) < 0:
            if len(self.held) > LINE:
                raise ValueError("a header line is too long")
            if not self.fill():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + 2]
        return out

    def take(self, most: int) -> bytes:
        if not self.held and not self.fill():
            raise ValueError("the archive ends within a record")
        out = bytes(self.held[:most])
        del self.held[:most]
        return out

    def headers(self) -> dict[str, str] | None:
        """Of the next block of header lines; None at the end of the file."""
        first = self.line()
        while first == b"":  # between records
            first = self.line()
        if first is None:
            return None
        out = {"": first.decode()}
        while line := self.line():
            k, _, v = line.decode().partition(":")
            out[k.strip().lower()] = v.strip()
        return out


def records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunk rows of an open archive. A record without payload bytes has one row of no bytes."""
    data = _Member(stream, chunk)
    while head := data.headers():
        block = int(head["content-length"])
        row = {"record_id": head["warc-record-id"], "record_type": head["warc-type"], "refers_to": head.get("warc-refers-to")}
        claimed = head.get("warc-payload-digest", "").rpartition(":")[2] or None
        http_length, left = None, block
        if head.get("content-type", "").startswith("application/http"):
            line = data.line()
            left -= len(line) + 2
            while line := data.line():
                left -= len(line) + 2
                k, _, v = line.partition(b":")
                if k.strip().lower() == b"content-length":
                    http_length = int(v)
            left -= 2
        row |= {"claimed": claimed, "full": http_length if row["record_type"] == "revisit" else left}
        digest, k = hashlib.sha1(), 0
        while True:
            piece = b""
            while left and len(piece) < chunk:
                got = data.take(min(left, chunk - len(piece)))
                piece += got
                left -= len(got)
            digest.update(piece)
            yield row | {"chunk": k, "last": not left, "length": len(piece), "bytes": piece, "digest": base32(digest.copy().digest())}
            k += 1
            if not left:
                break


def read(files: DataFrame, chunk: int = CHUNK, with_bytes: bool = False, last_only: bool = False) -> DataFrame:
    """The chunked record table of files (file): page_id, record_type, refers_to, chunk, last, length, running_digest,
    payload_bytes and claimed_digest (as the header has them)[, bytes]. last_only: just the last row of each record."""
    names = "page_id:l,record_type:s,refers_to:l,chunk:l,last:b,length:l,running_digest:s,payload_bytes:l,claimed_digest:s" + ",bytes:y" * with_bytes
    ddl = "page_id long, record_type string, refers_to long, chunk long, last boolean, length long, running_digest string, payload_bytes long, claimed_digest string" + ", bytes binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = C.fields(names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _filesystem(path)
                held, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for r in records(stream, chunk):
                        if last_only and not r["last"]:
                            continue
                        held.append((page_of(r["record_id"]), r["record_type"], page_of(r["refers_to"]) if r["refers_to"] else None, r["chunk"], r["last"], r["length"], r["digest"], r["full"], r["claimed"], *([r["bytes"]] if with_bytes else [])))
                        size += r["length"] if with_bytes else 64
                        if size >= 1 << 20:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return files.select("file").mapInArrow(run, ddl)


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages into folder; returns the list of files, dealt evenly to the tasks that read them."""
    files = C.cut(write(planned(pages), folder))
    return files.repartition(max(1, min(files.count(), 100_000)))


def chunk_table(files: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of files with the chunks' bytes, written into folder as Parquet and read from there."""
    read(files, chunk, with_bytes=True).write.option("compression", "zstd").parquet(folder)
    return files.sparkSession.read.parquet(folder)


def summaries(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, from its last chunk.

    A response's digest is the running digest there; one that its header contradicts is null. A revisit's is the one in
    its header, if a response of the page that it refers to really has it, else null."""
    last = C.cut(chunks.where("last").select("page_id", "payload_bytes", "running_digest", "claimed_digest", "record_type", "refers_to"))
    sound = F.col("claimed_digest").isNull() | (F.col("claimed_digest") == F.col("running_digest"))
    responses = last.where(F.col("record_type") != "revisit").withColumn("payload_digest", F.when(sound, F.col("running_digest")))
    # a page is read back by id: of no id there may be many
    key = lambda page, digest: F.concat(F.coalesce(page.cast("string"), F.lit("-")), F.lit(":"), digest)
    have = responses.select(key(F.col("page_id"), F.col("payload_digest")).alias("_key")).where("_key IS NOT NULL").distinct().withColumn("_has", F.lit(True))
    revisits = last.where("record_type = 'revisit'").withColumn("_key", key(F.col("refers_to"), F.col("claimed_digest"))).withColumn("_nth", F.xxhash64("page_id"))
    held = C.salted_join(revisits, have, "_key", "_nth", "left").withColumn("payload_digest", F.when(F.col("_has"), F.col("claimed_digest")))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*cols).unionByName(held.select(*cols))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    files = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), C.new_folder(spark, "warc"))
    return summaries(chunk_table(files, C.new_folder(spark, "warc-chunks")))


OP4_SQL = r"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), ranked AS (
  SELECT page_id, strlen(html) AS payload_bytes, hex,
    row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS nth, max(page_id) OVER (PARTITION BY html) AS top
  FROM hashed
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN top END AS refers_to
FROM ranked
"""
