"""WARC archives: indexed writing and reading by coalesced byte ranges.

``write_archives`` writes one archive file for each task and returns the index: a row for each record
with its file, offset, length, URL and payload digest.  ``read_records`` takes the index rows of the
records that are wanted, puts them in file and offset order, and reads neighbours that lie close together
with one request.  Files are reached by ``pyarrow.fs`` from their URI, so the archive folder may be any
store that it knows; a repeated task attempt writes a file of its own and only the index tells which
files count.  Each record is a gzip member of its own, as usual for such archives, so that a byte range can be
read alone.

Of records with equal payloads the one with the largest id holds the payload; the others are revisits
that refer to it.  Defined results: null payload and null URL count as empty; rows with the id of the
response and its payload are all responses; null ids sort below every other id, and of payloads that only
null ids have, all are responses; payloads of any length are written whole; other columns aren't looked at, so
none can clash; an empty table gives an index without rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._tables import new_path, written

INDEX = "record_id long, url string, record_type string, refers_to long, payload_digest string, file string, offset long, length long"
RECORDS = "record_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"
BLOCK_BYTES = 16 << 20
GAP_BYTES = 64 << 10
#: Payloads that may be joined by broadcast: those of more rows than this, and with more than this part of all rows.
HOT_ROWS, HOT_PAYLOADS = 100, 10_000
RUN_BYTES = 4 << 20
_HEAD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def render(record_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """One record; a revisit has no payload of its own."""
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:record:{'' if record_id is None else record_id}>",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head.insert(5, f"WARC-Refers-To: <urn:record:{'' if refers_to is None else refers_to}>")
        head.insert(6, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """The fields of one record as written by ``render``."""
    head, _, rest = record.partition(b"\r\n\r\n")
    found = {k.lower(): v.decode() for k, v in _HEAD.findall(head + b"\r\n")}
    size = int(found[b"content-length"])
    digest = found[b"warc-payload-digest"].removeprefix("sha1:")
    if rest[size:] != b"\r\n\r\n" or found[b"warc-type"] == "response" and payload_digest(rest[:size]) != digest:
        raise ValueError("the record doesn't agree with its index entry")
    number = lambda name: int(found[name][12:-1]) if found.get(name, "<urn:record:>")[12:-1] else None
    return {
        "record_id": number(b"warc-record-id"),
        "url": found[b"warc-target-uri"],
        "record_type": found[b"warc-type"],
        "refers_to": number(b"warc-refers-to"),
        "payload_digest": digest,
        "payload": rest[:size],
    }


def write_archives(pages: DataFrame, record_id: str, url: str, payload: str, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the archives to ``folder`` and returns the index, itself a written table."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(record_id).cast("long").alias("record_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    key = F.when(F.length("payload") >= min_revisit_bytes, F.concat_ws(":", F.sha1("payload"), F.length("payload")))
    rows = rows.withColumn("key", key)
    shared = written(rows.where("key is not null").groupBy("key").agg(F.max("record_id").alias("holder"), F.count("*").alias("n")).where("n > 1"), "shared")
    # Payloads of more than a ten-thousandth of all rows, ten thousand at most, are met by broadcast where they lie;
    # these rows, and those without a key, get a key of their own for the join of the others.
    limit = max(HOT_ROWS, rows.count() // HOT_PAYLOADS)
    hot = F.broadcast(shared.where(F.col("n") > limit).select("key", F.col("holder").alias("of_hot")))
    own = F.concat(F.lit("="), F.xxhash64("record_id", "url").cast("string"))
    rows = rows.join(hot, "key", "left").withColumn("key", F.when(F.col("of_hot").isNull(), F.coalesce("key", own)).otherwise(own))
    rows = rows.join(shared.where(F.col("n") <= limit).drop("n"), "key", "left").withColumn("holder", F.coalesce("of_hot", "holder")).select("record_id", "url", "payload", "holder", (F.col("holder").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("holder"))).alias("revisit"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        path = f"{root}/part-{task.partitionId():06d}-{task.stageId()}-{task.taskAttemptId()}.warc.gz"
        stream, offset = None, 0
        for batch in batches:
            index = []
            for r in batch.to_pylist():
                if stream is None:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(path, compression=None)
                digest = payload_digest(r["payload"])
                refers_to = r["holder"] if r["revisit"] else None
                record = gzip.compress(render(r["record_id"], r["url"], r["payload"], refers_to, r["revisit"], digest), 6, mtime=0)
                stream.write(record)
                index.append((r["record_id"], _clean(r["url"]), "revisit" if r["revisit"] else "response", refers_to, digest, path, offset, len(record)))
                offset += len(record)
            yield _batch(index, INDEX)
        if stream is not None:
            stream.close()

    index = written(rows.mapInArrow(archive, INDEX), "warc-index")
    store = folder[: len(folder) - len(pafs.FileSystem.from_uri(folder)[1])]
    return index.withColumn("file", F.concat(F.lit(store), "file"))


def read_records(index: DataFrame) -> DataFrame:
    """The records of the given index rows, read from their archives."""
    wanted = index.select("file", "offset", "length").withColumn("block", F.floor(F.col("offset") / BLOCK_BYTES))
    tasks = math.ceil((index.agg(F.sum("length")).first()[0] or 0) / BLOCK_BYTES)
    tasks = max(tasks, index.sparkSession.sparkContext.defaultParallelism)  # index rows are small, what they name isn't
    placed = wanted.repartition(tasks, "file", "block").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch[n].to_pylist() for n in ("file", "offset", "length")), strict=True))
            found, held = [], 0
            for uri, ranges in _runs(rows):
                fs, path = pafs.FileSystem.from_uri(uri)
                start, stop = ranges[0][0], max(o + n for o, n in ranges)
                with fs.open_input_file(path) as f:
                    data = f.read_at(stop - start, start)
                for o, n in ranges:
                    found.append(tuple(parse(gzip.decompress(data[o - start : o - start + n])).values()))
                    held += len(found[-1][-1])
                if held > RUN_BYTES:
                    yield _batch(found, RECORDS)
                    found, held = [], 0
            yield _batch(found, RECORDS)

    return placed.mapInArrow(read, RECORDS)


def _runs(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Sorted ranges, joined while the gap between them and their whole length stay small."""
    uri, ranges, stop = None, [], 0
    for file, offset, length in rows:
        if ranges and (file != uri or offset > stop + GAP_BYTES or offset + length > ranges[0][0] + RUN_BYTES):
            yield uri, ranges
            ranges = []
        uri, stop = file, max(offset + length, stop if ranges else 0)
        ranges.append((offset, length))
    if ranges:
        yield uri, ranges


def _clean(url: str) -> str:
    """Control characters can't stand in a header."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
