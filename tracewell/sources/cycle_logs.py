"""Cycle logs as a data source of Spark: ``spark.read.format("cycle_logs")`` and ``spark.readStream``.

A file's header tells its columns, and a file has one of two.  The source deals files out to tasks in ranges of
``range_bytes``, small files together; a task reads the header of each of its files from the file's start, so no line is
ever joined with a header.  Fields that aren't numbers are null, as are columns that a header lacks.

Options: ``path`` (a file, a folder with all below it, or a pattern), ``min_bytes`` (smaller files are stubs and skipped),
``core`` (a pattern that finds the core in the path) and ``range_bytes``.  Files are read by ``pyarrow.fs``.

A stream takes up files in the order of their time of change and their path; files must come into the folder whole, as by a
rename, and not earlier than those that have been taken up.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "core string, cycle int, timestamp_ns long, hamming_toggles int, vccint_shunt_v double, cipher_match int, trojan_active int"
MIN_BYTES, CORE, RANGE_BYTES = 100, r"_([A-Za-z0-9]+)\.csv$", 64 << 20
WHOLE, DECIMAL = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Columns, and those that headers name; millivolts become volts.
FIELDS = {"cycle": pa.int32(), "timestamp_ns": pa.int64(), "hamming_toggles": pa.int32(), "vccint_shunt_v": pa.float64(), "vccint_shunt_mv": pa.float64(), "cipher_match": pa.int32(), "trojan_active": pa.int32()}
#: What a task reads at a time; its lines take a multiple of that in the task's process while they are parsed.
READ_BYTES = 1 << 20


@dataclass(frozen=True)
class LogFile:
    path: str
    size: int
    changed: int


@dataclass
class Ranges(InputPartition):
    """``(path, start, stop)`` in bytes; a line belongs to the range in which it starts."""

    parts: list[tuple[str, int, int]]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listed(path: str, min_bytes: int) -> list[LogFile]:
    """The files that a path stands for, in order of change; what begins with a dot or an underscore is none."""
    fs, place = opened(path)
    star = re.search(r"[*?\[]", place)
    base = place[: star.start()].rpartition("/")[0] or "/" if star else place
    about = fs.get_file_info(base)
    found = [about] if about.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(base) :].strip("/").split("/") if x)
    files = [LogFile(i.path, i.size, i.mtime_ns or 0) for i in found if i.type == pafs.FileType.File and i.size >= min_bytes and (i is about or not hidden(i.path))]
    if star:
        files = [f for f in files if fnmatch.fnmatchcase(f.path, place)]
    return sorted(files, key=lambda f: (f.changed, f.path))


def dealt(files: list[LogFile], range_bytes: int) -> list[Ranges]:
    """Files cut into ranges, and ranges put together, to about ``range_bytes``."""
    out, held = [Ranges([])], 0
    for f in files:
        for start in range(0, f.size, range_bytes):
            part = (f.path, start, min(f.size, start + range_bytes))
            if held + part[2] - part[1] > range_bytes and held:
                out.append(Ranges([]))
                held = 0
            out[-1].parts.append(part)
            held += part[2] - part[1]
    return out


def parsed(text: bytes, header: list[str], core: str) -> pa.RecordBatch:
    """Whole lines as rows; empty lines and further headers are none."""
    lines = pc.utf8_trim_whitespace(pa.array(text.decode("utf-8", "replace").split("\n")))
    lines = lines.filter(pc.invert(pc.or_(pc.equal(lines, ""), pc.starts_with(lines, "cycle,"))))
    parts = pc.split_pattern(lines, ",")
    sizes = pc.list_value_length(parts)
    column = {}
    for name, kind in FIELDS.items():
        if name in header:
            k = header.index(name)
            there = pc.greater(sizes, k)
            starts = parts.offsets.slice(0, len(parts))
            value = pc.utf8_trim_whitespace(parts.values.take(pc.if_else(there, pc.add(starts, k), pa.scalar(None, starts.type))))
            good = pc.match_substring_regex(value, DECIMAL if kind == pa.float64() else WHOLE)
            value = pc.if_else(good, value, pa.scalar(None, pa.string()))
            value = pc.cast(value, pa.float64()) if kind == pa.float64() else _whole(value, kind)
        else:
            value = pa.nulls(len(lines), kind)
        column[name] = value
    milli = column.pop("vccint_shunt_mv")
    column["vccint_shunt_v"] = pc.coalesce(column["vccint_shunt_v"], pc.divide(milli, 1000.0))
    return pa.RecordBatch.from_arrays([pa.array([core] * len(lines), pa.string()), *column.values()], names=["core", *column])


def _whole(value: pa.Array, kind: pa.DataType) -> pa.Array:
    """Whole numbers that fit; others are null."""
    digits = pc.replace_substring_regex(value, r"^\+", "")
    short = pc.less_equal(pc.utf8_length(digits), 19)
    exact = pc.cast(pc.if_else(pc.less(pc.utf8_length(digits), 19), digits, pa.scalar(None, pa.string())), pa.int64())
    if kind == pa.int64():
        long_ = [int(x) if x is not None and -(1 << 63) <= int(x) < 1 << 63 else None for x in pc.if_else(pc.and_(short, pc.is_null(exact)), digits, pa.scalar(None, pa.string())).to_pylist()] if pc.any(pc.and_(pc.is_valid(digits), pc.is_null(exact))).as_py() else None
        return pc.coalesce(exact, pa.array(long_, pa.int64())) if long_ is not None else exact
    limit = (1 << 31) - 1
    return pc.cast(pc.if_else(pc.and_(pc.less_equal(exact, limit), pc.greater_equal(exact, -limit - 1)), exact, pa.scalar(None, pa.int64())), kind)


def rows_of(path: str, start: int, stop: int, core: str, uri: str) -> Iterator[pa.RecordBatch]:
    """The rows of a range of a file."""
    fs, _ = opened(uri)
    name = re.search(core, path)
    with fs.open_input_file(path) as f:
        head = f.read(4096).split(b"\n", 1)[0].decode("utf-8", "replace").strip()
        header = [h.strip() for h in head.split(",")]
        core_name = name[1] if name else ""
        begins = _first_line(f, start)
        f.seek(begins)
        held = b""  # what has been read from the line start ``begins`` on
        while begins < stop:
            block = f.read(READ_BYTES)
            held += block
            ends = held.find(b"\n", stop - 1 - begins) + 1  # the end of the last line that starts before ``stop``
            cut = ends or held.rfind(b"\n") + 1 if block else len(held)
            if held[:cut]:
                yield parsed(held[:cut], header, core_name)
            if ends or not block:
                return
            held, begins = held[cut:], begins + cut


def _first_line(f: pa.NativeFile, start: int) -> int:
    """Where the first line starts at or behind ``start``."""
    if not start:
        return 0
    at = start - 1
    f.seek(at)
    while block := f.read(1 << 16):
        cut = block.find(b"\n") + 1
        if cut:
            return at + cut
        at += len(block)
    return at


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.core = options["path"], options.get("core", CORE)
        self.min_bytes, self.range_bytes = int(options.get("min_bytes", MIN_BYTES)), int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        return dealt(listed(self.path, self.min_bytes), self.range_bytes)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, start, stop in partition.parts:
            yield from rows_of(path, start, stop, self.core, self.path)


class LogStreamReader(DataSourceStreamReader):
    """Offsets are the time of change and the path of the last file taken up."""

    def __init__(self, options: dict) -> None:
        self.batch = LogReader(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.batch.path, self.batch.min_bytes)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        place = lambda o: (o["changed"], o["path"])
        files = [f for f in listed(self.batch.path, self.batch.min_bytes) if place(start) < (f.changed, f.path) <= place(end)]
        return dealt(files, self.batch.range_bytes)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return self.batch.read(partition)

    def commit(self, end: dict) -> None:
        pass


class CycleLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cycle_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema: StructType) -> LogStreamReader:  # noqa: N802
        return LogStreamReader(self.options)


def register_cycle_logs(spark: SparkSession) -> None:
    """Makes ``format("cycle_logs")`` known to the session."""
    spark.dataSource.register(CycleLogSource)
