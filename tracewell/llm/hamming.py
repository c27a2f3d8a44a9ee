"""Exact top-k search of binary codes by incremental multi-index hashing.

A code of any number of bits is an array of 64-bit words.  It is cut into segments of about log2(n) bits for n
distinct codes, and indexed once for each segment, under the segment's value.  A query looks up the values within
a radius of its own, in all segments; the radius grows by rounds.  Once m segments are searched up to radius
r, every code up to distance m * (r + 1) - 1 has been seen, and a query ends with the round that covers the distance
of its k-th code.  The first round takes all radii up to one less than codes drawn at random would need, as each round
moves the index; codes that lie closer together than random ones mostly end there.

The index is dealt out into cells, by segment, the first bits of the segment's value and, where many codes share
these, a hash of the code.  In a round a query goes only to cells whose first bits lie within the radius, and only
queries that aren't done go at all.  A code that several segments find counts in the first of them alone, which the
two codes themselves tell, so nothing has to remember what was seen.  Queries that fall on one cell in great number
are dealt out to copies of it.  Each query carries the distance of its k-th code so far, which worse ones must beat.

Defined results: ties go to the smaller id; rows with a null or empty vector are neither found nor asked;
null ids are left out; missing and null elements of a vector count as 0 bits; equal codes are one entry that lists
its k smallest ids; ids that occur twice are two rows, and a query given twice is answered twice; fewer than k rows
give shorter lists; an empty table gives no rows.  Other columns aren't looked at, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm._tables import written

BITS = 64
#: Codes to a cell; queries to a copy of a cell; probes and candidates that a task holds at a time.
CELL_CODES, CELL_QUERIES = 100_000, 20_000
#: Up to so many cells their tables are broadcast (16 bytes each); beyond, Spark joins them as it sees fit.
BROADCAST_CELLS = 1_000_000
PROBES, CANDIDATES = 1 << 20, 1 << 21
MIN_WIDTH, MAX_WIDTH = 4, 24
FOUND = "query_id long, asked binary, code binary, least long, distance int"


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """``bits`` / 64 words; bit i of the code, counted through the words, is set where element i is positive."""

    def word(first: int) -> Column:
        bit = lambda i: F.when(F.get(vector, first + i) > 0, F.lit(-(1 << 63) if i == 63 else 1 << i)).otherwise(F.lit(0)).cast("long")
        code = bit(0)
        for i in range(1, min(64, bits - first)):
            code = code.bitwiseOR(bit(i))
        return code

    return F.array(*(word(first) for first in range(0, bits, 64)))


def widths(bits: int, n: int) -> list[int]:
    """The widths of the segments: about log2(n) bits each."""
    parts = max(1, math.ceil(bits / min(MAX_WIDTH, max(MIN_WIDTH, round(math.log2(n + 1))))))
    return [bits // parts + (k < bits % parts) for k in range(parts)]


def first_radius(bits: int, n: int, k: int, parts: list[int]) -> int:
    """One less than the radius that covers the k-th of ``n`` codes drawn at random, 0 at least."""
    distance, seen = 0, n / 2**bits
    while seen < k and distance < bits:
        distance += 1
        seen += n * math.comb(bits, distance) / 2**bits
    needed = math.ceil((distance + 1) / len(parts)) - 1
    return max(0, min(needed, max(parts)) - 1)


def masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits of which ``radius`` are set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


def words_of(column: pa.Array, words: int) -> np.ndarray:
    """Binary codes as rows of unsigned words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)


def segments_of(codes: np.ndarray, parts: list[int]) -> np.ndarray:
    """The value of each segment of each code, shape ``(segments, codes)``."""
    out, first = np.zeros((len(parts), len(codes)), np.int64), 0
    for s, width in enumerate(parts):
        at, shift = divmod(first, 64)
        value = codes[:, at] >> np.uint64(shift)
        if shift + width > 64:
            value = value | codes[:, at + 1] << np.uint64(64 - shift)
        out[s] = (value & np.uint64((1 << width) - 1)).astype(np.int64)
        first += width
    return out


class Cell:
    """Distinct codes of one cell, in the order of their segment's value."""

    def __init__(self, codes: np.ndarray, least: np.ndarray, parts: list[int], segment: int) -> None:
        values = segments_of(codes, parts)
        order = np.argsort(values[segment], kind="stable")
        self.codes, self.least, self.values, self.parts, self.segment = codes[order], least[order], values[:, order], parts, segment

    def search(self, asked: np.ndarray, radius: int, bound: np.ndarray, prefix: int, low: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``query, code, distance`` places: the k best of each query that this radius adds in this cell and segment.

        ``prefix`` are the cell's first bits, ``low`` is how many bits follow them.
        """
        own = segments_of(asked, self.parts)
        away = np.bitwise_count(own[self.segment] >> low ^ prefix)
        for first in np.unique(away):
            if first > radius or radius - first > low:
                continue
            wanted, near = np.flatnonzero(away == first), masks(low, radius - int(first))
            for a in range(0, len(wanted), max(1, PROBES // len(near))):
                of = wanted[a : a + max(1, PROBES // len(near))]
                probes = (prefix << low) | (own[self.segment][of] & (1 << low) - 1)[:, None] ^ near[None, :]
                start, stop = (np.searchsorted(self.values[self.segment], probes.ravel(), side) for side in ("left", "right"))
                count = stop - start
                full = np.flatnonzero(count)
                ends = np.cumsum(count[full])
                for b, c in _spans(ends, CANDIDATES):
                    some = full[b:c]
                    n = count[some]
                    place = np.arange(n.sum()) + np.repeat(start[some] - (np.cumsum(n) - n), n)
                    query = of[np.repeat(some // len(near), n)]
                    yield self.best(asked, own, query, place, radius, bound, k)

    def best(self, asked: np.ndarray, own: np.ndarray, query: np.ndarray, place: np.ndarray, radius: int, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distance = np.zeros(len(query), np.int64)
        for w in range(asked.shape[1]):
            distance += np.bitwise_count(asked[query, w] ^ self.codes[place, w])
        keep = np.flatnonzero(distance <= bound[query])
        query, place, distance = query[keep], place[keep], distance[keep]
        first = np.ones(len(query), bool)  # no other segment finds the code earlier
        for t in range(len(self.parts)):
            if t != self.segment:
                other = np.bitwise_count(own[t][query] ^ self.values[t][place])
                first &= (other > radius) | ((other == radius) & (t > self.segment))
        query, place, distance = query[first], place[first], distance[first]
        order = np.lexsort((self.least[place], distance, query))
        query, place, distance = query[order], place[order], distance[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return query[rank < k], place[rank < k], distance[rank < k]


def _spans(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Spans of elements whose sizes, given by their running sum, come to about ``limit``."""
    a = 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield a, b
        a = b


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS, cell_codes: int = CELL_CODES, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """``query_id, rank, found_id, distance`` for each row of ``queries``; both have ``id`` and ``code`` of ``bits`` bits."""
    words = -(-bits // 64)
    as_bytes = F.array_join(F.transform("code", lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")
    keyed = lambda d: d.where("id is not null and code is not null").select(F.col("id").cast("long").alias("id"), F.unhex(as_bytes).alias("code"))
    # Equal codes stay together until the k smallest ids of each are known; Spark ranks before it shuffles, too.
    first = Window.partitionBy("code").orderBy("id")
    ids = keyed(base).withColumn("at", F.row_number().over(first)).where(F.col("at") <= k)
    ids = written(ids.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = written(keyed(queries).groupBy(F.col("id").alias("query_id"), F.col("code").alias("asked")).agg(F.count("*").alias("times")), "asked")
    n = ids.count()
    parts = widths(bits, n)
    high = max(0, min(min(parts), math.ceil(math.log2(max(n / cell_codes, 4)))))  # first bits that tell cells apart
    found = nearest(ids.select("code", F.get("ids", F.lit(0)).alias("least")), asked.select("query_id", "asked"), k, n, parts, words, high, cell_codes, cell_queries)
    best = Window.partitionBy("query_id", "asked").orderBy("distance", "found_id")
    rows = found.join(ids, "code").select("query_id", "asked", "distance", F.explode("ids").alias("found_id"))
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    repeated = ranked.join(asked, ["query_id", "asked"]).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return repeated.select("query_id", "rank", "found_id", "distance")


def nearest(codes: DataFrame, asked: DataFrame, k: int, n: int, parts: list[int], words: int, high: int, cell_codes: int, cell_queries: int) -> DataFrame:
    """``FOUND``: for each query the k codes next to it, ties by their smallest id."""
    spark, m = codes.sparkSession, len(parts)
    lows = [width - high for width in parts]

    def prefixes(column: str, name: str):
        """A row for each segment of a code, with the segment's first bits."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = segments_of(_swapped(words_of(batch[column], words)), parts) >> np.array(lows)[:, None]
                rows = pa.array(np.tile(np.arange(batch.num_rows), m))
                table = batch.take(rows)
                yield pa.RecordBatch.from_arrays([*table.columns, pa.array(np.repeat(np.arange(m), batch.num_rows).astype(np.int32)), pa.array(values.ravel().astype(np.int32))], names=[*batch.schema.names, "segment", name])

        return cut

    index = codes.mapInArrow(prefixes("code", "prefix"), "code binary, least long, segment int, prefix int")
    index = written(index, "index")
    # Segments times 2 ** high cells: as many as the index has parts of cell_codes.
    cells = index.groupBy("segment", "prefix").agg(F.ceil(F.count("*") / cell_codes).cast("int").alias("subs"))
    cells = written(cells, "cells")
    small = F.broadcast if m << high <= BROADCAST_CELLS else lambda rows: rows  # of segments and first bits
    index = index.join(small(cells), ["segment", "prefix"]).withColumn("sub", F.pmod(F.xxhash64("code"), "subs").cast("int")).drop("subs")

    def search(batches: Iterator[pa.RecordBatch], radii: range) -> Iterator[pa.RecordBatch]:
        key, held, cell = None, [], None
        for batch in batches:
            columns = [batch[c].to_numpy() for c in ("segment", "prefix", "sub", "part", "kind")]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now, rows = tuple(int(c[a]) for c in columns[:4]), batch.slice(a, b - a)
                if now != key:
                    key, held, cell = now, [], None
                if columns[4][a] == 0:
                    held.append(rows)
                    continue
                if not held:
                    continue
                if cell is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    cell = Cell(_swapped(words_of(table["code"], words)), table["least"].to_numpy(), parts, key[0])
                ids, bound = rows["query_id"].to_numpy(), rows["bound"].to_numpy()
                wanted = _swapped(words_of(rows["code"], words))
                for radius in radii:
                    for query, place, distance in cell.search(wanted, radius, bound, key[1], lows[key[0]], k):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[query]), rows["code"].take(pa.array(query)), _binary(_swapped(cell.codes[place])), pa.array(cell.least[place]), pa.array(distance.astype(np.int32))],
                            names=[f.split()[0] for f in FOUND.split(", ")],
                        )

    best = Window.partitionBy("query_id", "asked").orderBy("distance", "least")
    far = sum(parts) + 1
    active = asked.withColumn("bound", F.lit(far))
    done: list[DataFrame] = []
    top: DataFrame | None = None
    start = first_radius(sum(parts), n, k, parts)
    for radius in range(start, max(parts) + 1):
        radii = range(radius + 1) if radius == start else range(radius, radius + 1)
        near = F.array(*(F.lit(x) for x in range(1 << high) if x.bit_count() <= radius))
        going = active.mapInArrow(prefixes("asked", "own"), "query_id long, asked binary, bound int, segment int, own int")
        going = going.withColumn("prefix", F.explode(F.transform(near, lambda x: x.bitwiseXOR(F.col("own"))))).join(small(cells), ["segment", "prefix"])
        going = going.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        crowds = written(going.groupBy("segment", "prefix", "sub").agg(F.ceil(F.count("*") / cell_queries).cast("int").alias("copies")), "crowds")
        crowds = small(crowds)  # a row for each cell
        going = going.join(crowds, ["segment", "prefix", "sub"]).withColumn("part", F.pmod(F.xxhash64("query_id", "asked"), "copies").cast("int"))
        copied = index.join(crowds, ["segment", "prefix", "sub"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        rows = copied.select("segment", "prefix", "sub", "part", F.lit(0).alias("kind"), "code", "least", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("int").alias("bound"))
        rows = rows.unionByName(going.select("segment", "prefix", "sub", "part", F.lit(1).alias("kind"), F.col("asked").alias("code"), F.lit(None).cast("long").alias("least"), "query_id", "bound"))
        tasks = max(spark.sparkContext.defaultParallelism, m << high)
        rows = rows.repartition(tasks, "segment", "prefix", "sub", "part").sortWithinPartitions("segment", "prefix", "sub", "part", "kind")
        new = rows.mapInArrow(lambda batches, radii=radii: search(batches, radii), FOUND)
        top = new if top is None else new.unionByName(top)
        ranked = top.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k)
        ranked = ranked.withColumn("worst", F.max("distance").over(Window.partitionBy("query_id", "asked"))).withColumn("n", F.count("*").over(Window.partitionBy("query_id", "asked")))
        covered = m * (radius + 1) - 1
        ranked = written(ranked.withColumn("done", (F.col("n") >= min(k, n)) & (F.col("worst") <= covered) | F.lit(radius == max(parts))), f"top-{radius}")
        columns = [f.split()[0] for f in FOUND.split(", ")]
        done.append(ranked.where("done").select(*columns))
        top = ranked.where("not done").select(*columns)
        # Queries without any code yet aren't in ``top``; full lists give the bound that a better code must meet.
        state = ranked.groupBy("query_id", "asked").agg(F.max("done").alias("done"), F.when(F.max("n") >= k, F.max("worst")).otherwise(far).cast("int").alias("limit"))
        active = active.join(state, ["query_id", "asked"], "left").where("done is null or not done").select("query_id", "asked", F.coalesce("limit", F.lit(far)).alias("bound"))
        active = written(active, f"active-{radius}")
        if active.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _swapped(codes: np.ndarray) -> np.ndarray:
    """Codes are stored with the most significant byte first."""
    return codes.byteswap()


def _binary(codes: np.ndarray) -> pa.Array:
    width = codes.shape[1] * 8
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())
