"""JSON lines without a schema, as a data source of Spark.

``spark.read.format("json_lines")`` cuts files into byte ranges, each a
partition of its own.  A row is a record with its file, the byte where its line
begins, and its place among the good records of its range; places and the
counts of the ranges before give ordinals without a sort.  Files are listed and
read through ``pyarrow.fs``, so their store must be one that pyarrow opens.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmark.functions import nested as N
from quillmark.session import materialize, ship
from quillmark.sources.readers import before_parts

SCHEMA = "file string, offset bigint, part int, place bigint, record string"
MODES = ("tolerant", "strict", "repair")
_READ = 1 << 20
_ROWS = 2_000
_RANGES, _LONGEST = 1024, 32 << 20  # ranges get longer than asked, up to _LONGEST, where they would be many more than _RANGES
_SINGLE = re.compile(r"'([^']+)':")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[pafs.FileInfo]:
    """Files of a folder by name, without those that begin with _ or a dot; or the one file."""
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    """Lines that begin in bytes ``start`` to ``stop`` of a file; a compressed file is one range."""

    part: int
    path: str
    start: int
    stop: int
    packed: bool


def lines(stream, start: int, stop: int | None, size: int = _READ) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin before ``stop``, from a stream that stands at ``start``; ends by \\n, \\r\\n or \\r, as Python reads text.

    Only the line at hand and one block of ``size`` bytes are held.
    """
    held, at = bytearray(), start
    scanned = 0
    while True:
        block = stream.read(size)
        held += block
        while (end := held.find(b"\n", scanned)) >= 0:
            whole, scanned = bytes(held[:end]), 0
            del held[: end + 1]
            for piece in whole.removesuffix(b"\r").split(b"\r"):
                if stop is None or at < stop:
                    yield at, piece
                at += len(piece) + 1
            at += len(whole) - len(whole.removesuffix(b"\r"))
            if stop is not None and at >= stop:
                return
        scanned = len(held)
        if not block:
            for piece in bytes(held).split(b"\r") if held else ():
                if stop is None or at < stop:
                    yield at, piece
                at += len(piece) + 1
            return


def _finite(value: object) -> object:
    """Numbers that are no JSON, which Python's reader takes, as strings: NaN, Infinity, -Infinity."""
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"
    return value


class JsonLines(DataSource):
    """Options: ``path``; ``mode``: tolerant (bad lines go), strict (a bad line ends the read, named by file and byte) or repair (single-quoted keys are quoted first, then strict); ``splitBytes`` of a range.

    A range is a task, so where there would be many more than 1,024 they are longer than asked, up to 32 MB.
    """

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return JsonLinesReader(dict(self.options))


class JsonLinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.mode, self.split = low["path"], low.get("mode", "tolerant"), int(low.get("splitbytes", 32 << 20))
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}, not {self.mode}")

    def partitions(self) -> list[Range]:
        out: list[Range] = []
        files = _files(self.path)
        split = max(self.split, min(_LONGEST, sum(f.size for f in files if not _packed(f.path)) // _RANGES))
        for f in files:
            packed = _packed(f.path)
            cuts = [0] if packed else range(0, max(f.size, 1), split)
            for start in cuts:
                out.append(Range(len(out), f.path, start, f.size if packed else min(start + split, f.size), packed))
        return out or [Range(0, "", 0, 0, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int, int, str]] = []
        if partition.path:
            for place, (offset, record) in enumerate(self._records(partition)):
                rows.append((partition.path, offset, partition.part, place, record))
                if len(rows) == _ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def _records(self, r: Range) -> Iterator[tuple[int, str]]:
        system, _ = _open(self.path)
        if r.packed:
            with system.open_input_stream(r.path, compression="detect") as stream:
                yield from self._good(r, lines(stream, 0, None))
            return
        with system.open_input_file(r.path) as stream:
            size = min(_READ, r.stop - r.start + 1024)
            if not r.start:
                found = lines(stream, 0, r.stop, size)
            else:  # the line that is cut by the edge belongs to the range before
                stream.seek(r.start - 1)
                found = lines(stream, r.start - 1, r.stop, size)
                next(found, None)
            yield from self._good(r, found)

    def _good(self, r: Range, found: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, str]]:
        for offset, line in found:
            try:
                text = line.decode("utf-8").strip()
                if not text:
                    continue
                if self.mode == "repair":
                    text = _SINGLE.sub(r'"\1":', text)
                value = json.loads(text)
            except (ValueError, RecursionError) as e:
                if self.mode == "tolerant":
                    continue
                raise ValueError(f"{r.path}, byte {offset}: {e}") from None
            yield offset, N._clean(json.dumps(_finite(value), ensure_ascii=False))


def _packed(path: str) -> bool:
    return path.endswith((".gz", ".bz2", ".zst", ".lz4"))


def _batch(rows: list[tuple[str, int, int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "offset", "part", "place", "record"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session and its workers."""
    ship(spark)
    spark.dataSource.register(JsonLines)


def read_records(spark: SparkSession, path: str, mode: str = "tolerant", ids: str = "id", split_bytes: int = 32 << 20) -> DataFrame:
    """(id, file, offset, record, value) of every good line: an ordinal from 1 in the order of files and lines, where the line stands, its JSON text and the same as VARIANT.

    The records are read once and stored; ordinals are their places after the
    counts of the ranges before, so nothing is sorted.
    """
    register(spark)
    rows = materialize(spark.read.format("json_lines").option("mode", mode).option("splitBytes", split_bytes).load(path), "records")
    before = before_parts(rows.withColumnRenamed("part", "__part"), __before=F.count("*"))
    placed = rows.join(F.broadcast(before), F.col("part") == F.col("__part"))  # a row for each range
    return placed.select((F.col("place") + F.col("__before") + 1).alias(ids), "file", "offset", "record", F.parse_json("record").alias("value"))


def read_records_all_or_nothing(spark: SparkSession, path: str, ids: str = "id", split_bytes: int = 32 << 20) -> DataFrame:
    """``read_records`` with single-quoted keys repaired; if any line is bad, no row at all."""
    try:
        return read_records(spark, path, "repair", ids, split_bytes)
    except PySparkException as e:
        if ", byte " not in str(e):
            raise
        return spark.createDataFrame([], f"{ids} bigint, file string, offset bigint, record string, value variant")


def first_bad_byte(spark: SparkSession, path: str, mode: str = "strict") -> int | None:
    """Where the bad line begins that ends a strict read; None if all lines are good."""
    register(spark)
    try:
        spark.read.format("json_lines").option("mode", mode).load(path).agg(F.count("record")).collect()  # one row
    except PySparkException as e:
        if found := re.search(r", byte (\d+): ", str(e)):
            return int(found.group(1))
        raise
    return None


def field(value: Column, name: str, kind: str = "string") -> Column:
    """A field of a VARIANT record, null where it is missing or of another type."""
    return F.try_variant_get(value, f"$.{name}", kind)
