"""WARC archives: writing, normalising monolithic gzip, indexing and reading.

``write_archives`` writes one gzip stream per partition, the way crawlers that
compress a whole file at once leave it.  Such a file can't be read from the middle,
so ``normalise`` inflates it once from start to end, rewrites every record as a gzip
member of its own and writes a sidecar index of (record id, offset, length) beside
it.  ``read_records`` then reads single records by offset, in parallel within a file.

Files go to a folder that all executors share, under names that depend on the
partition only, and appear by renaming: a task that runs again puts the same file in
place of its own.

Defined cases: a null payload counts as empty; of records with equal payloads of at
least ``min_revisit_bytes`` bytes the one with the smallest id is a response and the
others revisit it (rows with that same id all are responses; null ids revisit, or are
responses if no other id has the payload); null URLs leave the header out; control
characters in URLs are percent-encoded; a very long payload is one record, held whole by
its task; repeated rows have a record each; an empty table gives no archive and no row;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, shared_path, table_bytes, text_bytes, written

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_URN = "urn:x-row:"
#: Bytes read, inflated or written at a time.
_BLOCK = 1 << 18


def open_folder(path: str):
    """(file system, path in it) of a URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(row_id, url: str | None, payload: bytes, refers_to, revisit: bool, digest: str, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header (with the payload's length)
    but no payload."""
    http = _HTTP % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_URN}{'null' if row_id is None else row_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{_URN}{refers_to}>")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers in lower case, HTTP header, payload) of one whole record."""
    at = record.index(b"\r\n\r\n")
    headers = {}
    for line in record[:at].decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    block = record[at + 4 : at + 4 + int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


class _Records:
    """Cuts a growing stream of inflated bytes into whole records."""

    def __init__(self):
        self.held, self.need = bytearray(), None

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while True:
            if self.need is None:
                at = self.held.find(b"\r\n\r\n")
                if at < 0:
                    return
                found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", bytes(self.held[:at]))
                if not found:
                    raise ValueError("a WARC record without Content-Length")
                self.need = at + 4 + int(found[1]) + 4
            if len(self.held) < self.need:
                return
            yield bytes(self.held[: self.need])
            del self.held[: self.need]
            self.need = None


def inflate_records(source) -> Iterator[bytes]:
    """Records of a gzip file of one or many members, inflated once, block by block."""
    inflater, records = zlib.decompressobj(31), _Records()
    while data := source.read(_BLOCK):
        while data:
            chunk = inflater.decompress(data, _BLOCK)
            yield from records.feed(chunk)
            data = inflater.unconsumed_tail
            if inflater.eof:
                data, inflater = inflater.unused_data, zlib.decompressobj(31)
    while rest := inflater.decompress(inflater.unconsumed_tail, _BLOCK):
        yield from records.feed(rest)
    if records.held:
        raise ValueError("the last WARC record is cut short")


#: Bytes of the table of repeated digests up to which it is broadcast; beyond, it is joined
#: by a shuffle.
_BROADCAST_BYTES = 32 << 20


def classified(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """``(id, url, payload, refers_to, revisit)``: who is a response, who revisits whom.
    Digests and ids are grouped by a shuffle; payloads stay where they are read unless
    the digests that occur more than once fill over ``_BROADCAST_BYTES``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_bytes(payload_col).alias("payload"))
    # A null digest meets no other.
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= min_revisit_bytes, F.unhex(F.sha1("payload"))))
    several = rows.filter("sha IS NOT NULL").groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").select("sha", "first")
    several = written(several, "digests")
    met = rows.join(F.broadcast(several) if table_bytes(several) <= _BROADCAST_BYTES else several, "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return met.select("id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write ``classified`` rows as monolithic ``.warc.gz`` files; returns a table of
    ``(path, n_records)``.  A partition starts a new file after ``archive_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        task, out, state = TaskContext.get().partitionId(), [], None

        def close():
            sink, deflater, temp, final, n, _ = state
            sink.write(deflater.flush())
            sink.close()
            fs.move(temp, final)
            out.append((final.rsplit("/", 1)[-1], n))

        for b in batches:
            for r in zip(*(b.column(k) for k in range(5)), strict=True):
                row_id, url, payload, refers, revisit = (x.as_py() for x in r)
                if state is None:
                    final = f"{base}/part-{task:06d}-{len(out):04d}.warc.gz"
                    temp = f"{final}.{uuid.uuid4().hex}.tmp"
                    state = [fs.open_output_stream(temp, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), temp, final, 0, 0]
                record = make_record(row_id, url, payload, refers, revisit, payload_digest(payload), date)
                state[0].write(state[1].compress(record))
                state[4] += 1
                state[5] += len(record)
                if state[5] >= archive_bytes:
                    close()
                    state = None
        if state is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["path", "n_records"])

    return written(rows.select("id", "url", "payload", "refers_to", "revisit").mapInArrow(run, "path string, n_records bigint"), "archives")


def normalise(archives: DataFrame, folder: str, out_folder: str, level: int = 1) -> DataFrame:
    """Rewrite each archive (column ``path``, a name below ``folder``) record by
    record; returns, and writes beside each file, ``(path, record_id, offset, length)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source_fs, source = open_folder(folder)
        fs, base = open_folder(out_folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for name in b.column(0).to_pylist():
                temp, index, at = f"{base}/{name}.{uuid.uuid4().hex}.tmp", [], 0
                with source_fs.open_input_stream(f"{source}/{name}", compression=None) as stream, fs.open_output_stream(temp, compression=None) as sink:
                    for record in inflate_records(stream):
                        deflater = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = deflater.compress(record) + deflater.flush()
                        sink.write(member)
                        found = re.search(rb"(?im)^warc-record-id:\s*<(.*?)>", record)
                        index.append((name, found[1].decode() if found else None, at, len(member)))
                        at += len(member)
                side = f"{base}/{name}.idx.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(side, compression=None) as sink:
                    for _, rid, offset, length in index:
                        sink.write(f"{rid}\t{offset}\t{length}\n".encode())
                fs.move(temp, f"{base}/{name}")
                fs.move(side, f"{base}/{name}.idx")
                for k in range(0, max(1, len(index)), 10_000):
                    part = index[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.string()), pa.array([x[2] for x in part], pa.int64()), pa.array([x[3] for x in part], pa.int64())], ["path", "record_id", "offset", "length"])

    return written(archives.select("path").mapInArrow(run, "path string, record_id string, offset bigint, length bigint"), "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read records by their index rows: ``(record_id, record_type, target_uri,
    refers_to, payload_digest, payload_bytes, digest_ok)``.  Payload length and digest
    of a response are taken from the bytes read; of a revisit from its headers."""
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "digest_ok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        name, file = None, None
        for b in batches:
            out = []
            for path, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != name:
                    if file:
                        file.close()
                    name, file = path, fs.open_input_file(f"{base}/{path}")
                file.seek(offset)
                headers, http, payload = parse_record(zlib.decompress(file.read(length), 31))
                stated = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response":
                    size, digest = len(payload), payload_digest(payload)
                else:
                    size, digest = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1]), stated
                refers = headers.get("warc-refers-to")
                out.append((headers["warc-record-id"].strip("<>"), headers["warc-type"], headers.get("warc-target-uri"), refers.strip("<>") if refers else None, digest, size, digest == stated))
            kinds = [pa.string()] * 5 + [pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)
        if file:
            file.close()

    # Neighbouring records of a file stay together.
    ranged = index.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return ranged.mapInArrow(run, "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, digest_ok boolean")


def archive_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write all rows to archives, normalise them and read every record back:
    ``(id, payload_bytes, payload_digest, record_type, refers_to, target_uri, digest_ok)``."""
    spark = df.sparkSession
    raw, whole = shared_path(spark, "warc-monolithic"), shared_path(spark, "warc")
    id_type = df.schema[id_col].dataType.simpleString()
    archives = write_archives(classified(df, id_col, url_col, payload_col, min_revisit_bytes), raw)
    index = normalise(archives, raw, whole)
    drop_path(spark, raw)
    bare = lambda c: F.nullif(F.expr(f"substring({c}, {len(_URN) + 1})"), F.lit("null")).cast(id_type)
    read = read_records(index, whole)
    return read.select(bare("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", bare("refers_to").alias("refers_to"), "target_uri", "digest_ok")
