"""WARC records in ZIP packages: writing, and reading by ranges.

An archive is a ZIP file with stored (uncompressed) members, as web archive
collections use it: ``archive/data.warc.gz``, in which every record is a gzip
member of its own, and ``indexes/index.cdxj``, which has a line with offset
and length for each record.  A reader takes the end of the file, the central
directory (with its ZIP64 forms), the index, and then only the byte ranges of
the records it wants; nothing is extracted.

Archives are written by the tasks themselves to a folder that all executors
share.  A file's name holds the task attempt, and only attempts that succeed
are in the returned manifest, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.store import bound_batches, materialize, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_SIEVE_BITS = 28
# fixed values of the ZIP format: signatures and the id of the ZIP64 extra field
_END, _END64, _LOCATOR, _CENTRAL, _LOCAL, _EXTRA64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04", 1


def _clean(url: str) -> str:
    """A url for a header line: control characters and blanks as %XX."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x21 or ord(c) == 0x7F else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, serial: str = "0") -> bytes:
    """One WARC record, not compressed.  A revisit has the HTTP header alone, with the length of the full payload.

    ``serial`` tells records without a page_id apart.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{f':{serial}' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    page_id: int | None
    url: str | None
    kind: str
    payload: bytes | None
    size: int
    digest: str
    refers_to: int | None


def parse_record(data: bytes) -> Record:
    """A record from its bytes; a response's digest and length are those of the payload found."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]

    def number(name: str) -> int | None:
        text = fields.get(name, "").strip("<>").removeprefix(_ID).partition(":")[0]
        return int(text) if text else None

    kind = fields["warc-type"]
    said = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "revisit":
        return Record(number("warc-record-id"), fields.get("warc-target-uri"), kind, None, lengths[0], said, number("warc-refers-to"))
    found = hashlib.sha256(payload).hexdigest()
    if found != said or lengths[0] != len(payload):
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    return Record(number("warc-record-id"), fields.get("warc-target-uri"), kind, payload, len(payload), found, None)


class _Sink:
    """A stream for zipfile that can only be written on."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass


class ArchiveWriter:
    """One archive; the index stays in memory until it closes."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out = uri, system.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Sink(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.offset, self.lines = 0, []

    def add(self, name: str, url: str | None, data: bytes, digest: str) -> None:
        packed = gzip.compress(data, 1, mtime=0)
        self.member.write(packed)
        self.lines.append(f"{name} {json.dumps({'url': url, 'digest': 'sha256:' + digest, 'offset': self.offset, 'length': len(packed)})}\n")
        self.offset += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            for line in self.lines:
                f.write(line.encode())
        self.zip.close()
        self.out.close()
        return self.uri, len(self.lines), self.offset


def write_archives(pages: DataFrame, page_id: Column, url: Column, payload: Column, folder: str, least: int = 100, most_records: int = 20_000, most_bytes: int = 1 << 28, broadcast_digests: int = 200_000) -> DataFrame:
    """Write one record per row under ``folder``; returns the manifest (path, records, bytes).

    ``payload`` is binary; null is empty, and payloads of any length are written
    whole.  Of rows with equal payloads of at least ``least`` bytes that with the
    least page_id becomes the response and the others revisits of it; rows
    without an id that have no such response are responses.  Repeated rows of
    that page_id are responses each, under the one record id of their page;
    records without a page_id have numbers of their own.

    Digests that occur once are not looked at again.  Those of copies are
    broadcast while there are at most ``broadcast_digests``; beyond that
    bounded sieves tell which rows may have copies, and only those rows are
    shuffled, revisits without their payloads.
    """
    spark = pages.sparkSession
    bound_batches(spark, 8)
    body = F.coalesce(payload, F.lit(b""))
    rows = pages.select(page_id.cast("long").alias("page_id"), url.alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("size") >= least).select("digest", "page_id")
    copies = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    copies = materialize(copies, "copies")
    n = copies.count()
    if n <= broadcast_digests:
        marked = rows.join(F.broadcast(copies), "digest", "left")  # payloads of small sizes are not among them
    else:
        marked = _by_sieves(rows, copies, least, broadcast_digests)
    revisit = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = marked.select("page_id", "url", "payload", "digest", "size", revisit.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer, number, done = None, 0, []
        for batch in batches:
            for page, url_, data, digest, size, refers in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if writer is None:
                    writer = ArchiveWriter(f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{number}.zip")
                    number += 1
                writer.add(str(page), url_, record(page, url_, data, digest, size, refers, f"{context.partitionId()}.{number}.{len(writer.lines)}"), digest)
                if len(writer.lines) >= most_records or writer.offset >= most_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        cols = list(zip(*done, strict=True)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return materialize(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


def _by_sieves(rows: DataFrame, copies: DataFrame, least: int, broadcast_digests: int) -> DataFrame:
    """Rows with ``first``, the least page_id of their digest among ``copies``; payloads of revisits are left out.

    One sieve holds the copied digests, one those with their first page.  What
    is in neither has no copy.  What is in both is most likely a first page and
    joins with its payload; there is one for each copied digest.  What is in
    the first alone is a revisit, or there by chance: such rows join without
    their payloads, and those found to have no copy are taken from the pages.
    """
    spark = rows.sparkSession
    n = copies.count()
    bits = 1 << min(_SIEVE_BITS, max(12, (16 * n).bit_length()))

    def sieve(key: Column) -> np.ndarray:
        at = F.pmod(key, F.lit(bits))
        parts = copies.select(F.floor(at / (bits >> 6)).cast("int").alias("part"), at.alias("at")).groupBy("part").agg(F.collect_set("at").alias("at"))  # a 64th of the bits each

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p, spots in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    part = np.zeros(bits >> 6, bool)
                    part[spots.values.to_numpy() % (bits >> 6)] = True
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["part", "data"])

        out = np.zeros(bits >> 3, np.uint8)
        for r in parts.mapInArrow(pack, "part int, data binary").collect():
            out[r.part * (bits >> 9) : (r.part + 1) * (bits >> 9)] = np.frombuffer(bytes(r.data), np.uint8)
        return out

    bound = spark.sparkContext.broadcast((sieve(F.xxhash64("digest")), sieve(F.xxhash64("digest", "first"))))

    @F.pandas_udf("int")
    def kind(size: pd.Series, digest: pd.Series, page: pd.Series) -> pd.Series:
        def inside(data: np.ndarray, key: pd.Series) -> np.ndarray:
            at = np.mod(key.to_numpy(np.int64), bits)
            return (data[at >> 3] >> (7 - (at & 7))) & 1 > 0

        copied = (size.to_numpy() >= least) & inside(bound.value[0], digest)
        return pd.Series(np.where(copied, np.where(inside(bound.value[1], page), 1, 2), 0))

    names = ["page_id", "url", "payload", "digest", "size"]
    told = rows.select(*names, kind("size", F.xxhash64("digest"), F.xxhash64("digest", "page_id")).alias("kind"))
    none = F.lit(None).cast("long").alias("first")
    alone = told.where("kind = 0").select(*names, none)
    firsts = told.where("kind = 1").join(copies, "digest", "left").select(*names, "first")
    asked = rows.select("page_id", "url", "digest", "size", kind("size", F.xxhash64("digest"), F.xxhash64("digest", "page_id")).alias("kind")).where("kind = 2")
    found = materialize(asked.join(copies, "digest", "left").select("page_id", "url", "digest", "size", "first"), "revisits")
    revisits = found.where("first IS NOT NULL").select("page_id", "url", F.lit(b"").alias("payload"), "digest", "size", "first")
    chance = found.where("first IS NULL").select("digest").distinct()
    few = chance.count() <= broadcast_digests
    others = told.where("kind = 2").join(F.broadcast(chance) if few else chance, "digest", "left_semi").select(*names, none)
    return alone.unionByName(firsts).unionByName(revisits).unionByName(others)


@dataclass
class Member:
    name: str
    method: int
    size: int
    begin: int  # of its local header


class Archive:
    """The directory of a ZIP file, read from the end of the file and nothing else."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.members = {m.name: m for m in self._directory()}

    def range(self, begin: int, length: int) -> bytes:
        return self.file.read_at(length, begin)

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 22 - 65_535 - 20)
        tail = self.range(tail_at, self.size - tail_at)
        at = tail.rfind(_END)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        count, length, begin = struct.unpack("<HII", tail[at + 10 : at + 20])
        if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR:
            where = struct.unpack("<Q", tail[at - 12 : at - 4])[0]
            end = self.range(where, 56)
            if end[:4] != _END64:
                raise ValueError("the ZIP64 end of central directory is not where its locator says")
            count, length, begin = struct.unpack("<QQQ", end[32:56])
        data, p = self.range(begin, length), 0
        for _ in range(count):
            if data[p : p + 4] != _CENTRAL:
                raise ValueError("the central directory is damaged")
            method, packed, size = *struct.unpack("<H", data[p + 10 : p + 12]), *struct.unpack("<II", data[p + 20 : p + 28])
            n, extra, comment = struct.unpack("<HHH", data[p + 28 : p + 34])
            local = struct.unpack("<I", data[p + 42 : p + 46])[0]
            name = data[p + 46 : p + 46 + n].decode()
            e, stop = p + 46 + n, p + 46 + n + extra
            while e + 4 <= stop:
                kind, m = struct.unpack("<HH", data[e : e + 4])
                if kind == _EXTRA64:  # only the values that did not fit, in this order
                    wide = iter(struct.unpack(f"<{m // 8}Q", data[e + 4 : e + 4 + m // 8 * 8]))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                e += 4 + m
            yield Member(name, method, packed, local)
            p += 46 + n + extra + comment

    def begin(self, name: str) -> int:
        """First byte of a stored member's data."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed: it can't be read by ranges")
        head = self.range(m.begin, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"the local header of {name} is damaged")
        return m.begin + 30 + sum(struct.unpack("<HH", head[26:30]))

    def index(self) -> list[tuple[int, int]]:
        """Offset and length of every record, from the index."""
        text = self.range(self.begin(INDEX), self.members[INDEX].size).decode()
        rows = [json.loads(line[line.index("{") :]) for line in text.split("\n") if line]
        return [(r["offset"], r["length"]) for r in rows]


def read_archives(manifest: DataFrame, with_payload: bool = True, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Rows (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of all records of the archives in ``path``.

    First the directories and indexes are read, which gives pieces of about
    ``chunk_bytes``; these are dealt out anew, so that large archives are read
    by many tasks.  Damaged archives and records raise an error.
    """
    spark = manifest.sparkSession
    bound_batches(spark, 8)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                a = Archive(path)
                base, pieces, now, size = a.begin(DATA), [], [], 0
                for offset, length in a.index():
                    if now and size + length > chunk_bytes:
                        pieces.append(now)
                        now, size = [], 0
                    now.append((offset, length))
                    size += length
                pieces += [now] if now else []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(pieces), pa.string()), pa.array(range(len(pieces)), pa.int64()), pa.array([base] * len(pieces), pa.int64()), pa.array([[x[0] for x in p] for p in pieces], pa.list_(pa.int64())), pa.array([[x[1] for x in p] for p in pieces], pa.list_(pa.int64()))], ["path", "piece", "base", "offsets", "lengths"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, offsets, lengths in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                system, where = fs.FileSystem.from_uri(path)
                with system.open_input_file(where) as f:
                    span = f.read_at(offsets[-1] + lengths[-1] - offsets[0], base + offsets[0])
                rows = [parse_record(gzip.decompress(span[o - offsets[0] : o - offsets[0] + size])) for o, size in zip(offsets, lengths, strict=True)]
                cols = [pa.array([r.page_id for r in rows], pa.int64()), pa.array([r.url for r in rows], pa.string()), pa.array([r.kind for r in rows], pa.string()), pa.array([r.size for r in rows], pa.int64()), pa.array([r.digest for r in rows], pa.string()), pa.array([r.refers_to for r in rows], pa.int64())]
                payload = [pa.array([r.payload for r in rows], pa.binary())] if with_payload else []
                yield pa.RecordBatch.from_arrays([*cols, *payload], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][: 6 + len(payload)])

    pieces = manifest.select("path").repartition(n, "path").mapInArrow(locate, "path string, piece bigint, base bigint, offsets array<bigint>, lengths array<bigint>")
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * with_payload
    return pieces.repartition(n, "path", "piece").mapInArrow(read, schema)


def archive_folder(pages: DataFrame) -> str:
    """A new folder that all executors share."""
    return new_path(pages.sparkSession, "archives")
