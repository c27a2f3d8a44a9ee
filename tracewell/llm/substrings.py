"""Substring dedup with a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document.  A word is removed if a window covers it whose
word sequence also starts in a document with a smaller id.

Pass one counts the windows of every partition in a count-min sketch of two rows; partial sketches are sent
as sorted cell numbers in stripes and added up stripe by stripe.  The merged sketch never counts too low, so
a window that occurs twice is never estimated to occur once.  Pass two emits only windows estimated to be
repeated, by a 96-bit hash of their words, and groups these exactly: within a group all occurrences outside
the smallest document are marks.  Marks travel to the documents in units of a size that one task holds, and
whatever they cover is removed.

Windows that are estimated to occur ``HOT`` times or more aren't grouped in one task: their smallest document
is found by partial minima, and these windows are given to all tasks.  Where more than ``MOST_HOT`` windows are so
frequent, the most frequent ones are, and the others, each of them at most a millionth of all windows, are grouped like all.  The sketch
has three cells a row for each window, up to ``MAX_STRIPES`` stripes of 4 million cells.  It is written to the shared
folder as 1 bit a cell, and each worker reads it there (256 MB at most, in all rows); beyond about 350 million windows it lets more single windows through to the exact pass,
which costs shuffled bytes but no result.

Defined results: a null text has no words; null ids count as larger than all others and not as smaller than
each other; rows with equal ids are one document; a document of fewer words than a window keeps all; an
empty table gives no rows.  Columns of the input are kept; ``n_words``, ``n_removed`` and ``kept`` are set; a column named
``__unit`` is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import _words
from tracewell.llm._pack import pack, unpack
from tracewell.llm._tables import new_path

WINDOW = 13
ROWS = 2
CELLS_PER_WINDOW = 3
STRIPE_BITS, MAX_STRIPES = 22, 256
#: Windows so frequent aren't grouped in a task; so many of them at most are given to all tasks (20 bytes each).
HOT, MOST_HOT = 20_000, 1_000_000
UNIT_BYTES = 16 << 20
BUCKET_WINDOWS = 500_000
NO_ID = np.iinfo(np.int64).max
SLICE = 4 << 20


def windows(rows: pa.Table, text: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of every window, shape ``(2, n)``, its row, and its first word's place in the row."""
    bounds, codes, vocabulary = _words.split_words(rows[text])
    starts, counts = _words.window_starts(bounds, width)
    hashes = _words.hash_words(vocabulary)
    both = np.stack([_words.roll(hashes[r][codes], width, _words.MULTIPLIERS[r])[starts] for r in range(ROWS)]) if len(starts) else np.empty((ROWS, 0), np.uint64)
    of = np.repeat(np.arange(len(counts)), counts)
    return both, of, starts - bounds[of]


def ids_of(rows: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(rows[name].combine_chunks().cast(pa.int64()), NO_ID).to_numpy().astype(np.int64)


class Sketch:
    """The merged sketch as a worker holds it: for each row, which cells have counted 2 or more."""

    def __init__(self, cells: int, path: str) -> None:
        self.cells = cells
        self.repeated = [np.zeros(cells >> 3, np.uint8) for _ in range(ROWS)]
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in pads.dataset(root, filesystem=fs, format="parquet").to_batches(columns=["row", "stripe", "cells"], batch_size=16):
            for r, stripe, cells in zip(*(batch[n].to_pylist() for n in ("row", "stripe", "cells")), strict=True):
                (bitmap,) = unpack(cells)
                at = stripe << STRIPE_BITS >> 3
                self.repeated[r][at : at + len(bitmap)] = bitmap

    def has_repeated(self, both: np.ndarray) -> np.ndarray:
        """Places of the windows estimated to occur twice or more."""
        places = np.arange(both.shape[1])
        for r in range(ROWS):
            cells = cells_of(both[r][places], self.cells)
            places = places[(self.repeated[r][cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
        return places


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)


_held: dict[str, Sketch] = {}


def held_sketch(cells: int, path: str) -> Sketch:
    """The sketch of this run, read once by each worker; a worker holds one at a time."""
    if path not in _held:
        _held.clear()
        _held[path] = Sketch(cells, path)
    return _held[path]


def release_sketch() -> None:
    _held.clear()


def build_sketch(docs: DataFrame, text: str, width: int, n_windows: int, hot: int) -> tuple[int, str, list[np.ndarray]]:
    """The number of cells in a row, where the sketch was written, and the cells of each row that counted ``hot`` or more."""
    n_cells = max(1, min(-(-CELLS_PER_WINDOW * n_windows >> STRIPE_BITS), MAX_STRIPES)) << STRIPE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _words.take_over("substrings", release_sketch)
        for batch in batches:
            for rows in _words.slices(batch, text, SLICE):
                both = windows(rows, text, width)[0]
                parts: list[tuple[int, int, bytes]] = []
                for r in range(ROWS):
                    cells, times = np.unique(cells_of(both[r], n_cells), return_counts=True)
                    stripes = (cells >> np.uint64(STRIPE_BITS)).astype(np.int64)
                    for a, b in _words.spans(stripes):
                        inside = (cells[a:b] & np.uint64((1 << STRIPE_BITS) - 1)).astype(np.uint32)
                        more = np.flatnonzero(times[a:b] > 1)
                        parts.append((r, int(stripes[a]), pack(np.diff(inside, prepend=np.uint32(0)), more.astype(np.uint32), times[a:b][more].astype(np.uint32))))
                yield _batch(parts, ("row", "stripe", "cells"), (pa.int32(), pa.int32(), pa.binary()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(1 << STRIPE_BITS, np.uint32)

        def close() -> pa.RecordBatch:
            often = np.flatnonzero(total >= hot)
            row = (*key, pack(np.packbits(total > 1, bitorder="little")), pack(often.astype(np.uint64) + np.uint64(key[1] << STRIPE_BITS), total[often]) if len(often) else None)
            return _batch([row], ("row", "stripe", "cells", "hot"), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))

        for batch in batches:
            for r, stripe, cells in zip(*(batch[n].to_pylist() for n in ("row", "stripe", "cells")), strict=True):
                if key is not None and key != (r, stripe):
                    yield close()
                    total[:] = 0
                key = (r, stripe)
                gaps, more, times = unpack(cells)
                inside = np.cumsum(gaps, dtype=np.uint32)
                total[inside] += np.uint32(1)
                total[inside[more]] += times - np.uint32(1)
        if key is not None:
            yield close()

    schema = "row int, stripe int, cells binary"
    partial = docs.select(text).mapInArrow(count, schema)
    merged = partial.repartition("row", "stripe").sortWithinPartitions("row", "stripe").mapInArrow(merge, schema + ", hot binary")
    path = new_path(docs.sparkSession, "sketch")
    merged.write.parquet(path)
    cells, times = [np.empty(0, np.uint64)] * ROWS, [np.empty(0, np.uint32)] * ROWS
    for r, often in docs.sparkSession.read.schema(schema + ", hot binary").parquet(path).where("hot is not null").select("row", "hot").toLocalIterator():
        more = unpack(often)
        cells[r], times[r] = np.concatenate([cells[r], more[0]]), np.concatenate([times[r], more[1]])
        if len(cells[r]) > 2 * MOST_HOT:
            most = np.argpartition(times[r], -MOST_HOT)[-MOST_HOT:]
            cells[r], times[r] = cells[r][most], times[r][most]
    return n_cells, path, [np.sort(c) for c in cells]


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space."""
    spark = docs.sparkSession
    if "__unit" in docs.columns:
        raise ValueError("__unit is the name of a column that is added")
    docs = docs.drop("n_words", "n_removed", "kept")
    n_bytes, n_windows = docs.agg(
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) - (width - 1))), F.lit(0)),
    ).first()
    units = max(-(-n_bytes // UNIT_BYTES), spark.sparkContext.defaultParallelism)
    buckets = max(-(-n_windows // BUCKET_WINDOWS), spark.sparkContext.defaultParallelism)
    # By id and text, as rows with null or equal ids may be many; marks carry the unit of their own row.
    placed = docs.withColumn("__unit", F.pmod(F.xxhash64(doc_id, F.crc32(F.col(text).cast("binary"))), F.lit(units)).cast("int"))
    n_cells, path, hot_cells = build_sketch(docs, text, width, n_windows, hot)
    smallest = spark.sparkContext.broadcast(_smallest_of_hot(docs, text, doc_id, width, n_cells, hot_cells, hot) if all(len(c) for c in hot_cells) else None)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _words.take_over("substrings", release_sketch)
        found, hottest = held_sketch(n_cells, path), smallest.value
        for batch in batches:
            for rows in _words.slices(batch, text, SLICE):
                both, of, place = windows(rows, text, width)
                some = found.has_repeated(both)
                both, of, place = both[:, some], of[some], place[some].astype(np.int32)
                ids, unit = ids_of(rows, doc_id), rows["__unit"].to_numpy().astype(np.int64)
                tags = np.fromiter((zlib.crc32(x) for x in _words.one_array(rows[text]).cast(pa.large_binary()).to_pylist()), np.uint32, rows.num_rows)
                h1, h2 = both[0], (both[1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                to = ((h1 & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                if hottest is not None:
                    known, least = _lookup(hottest, h1, h2)
                    marked = known & (ids[of] > least)
                    to[marked] = -1 - unit[of[marked]]
                    rest = ~known | marked
                    h1, h2, of, place, to = h1[rest], h2[rest], of[rest], place[rest], to[rest]
                order = np.argsort(to, kind="stable")
                to = to[order]
                parts = []
                for a, b in _words.spans(to):
                    k = order[a:b]
                    mark = (ids[of[k]], tags[of[k]], place[k])
                    parts.append((int(to[a]), pack(*mark) if to[a] < 0 else pack(h1[k], h2[k], *mark, unit[of[k]].astype(np.int32))))
                yield _batch(parts, ("bucket", "found"), (pa.int64(), pa.binary()))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            out: list[tuple[int, bytes]] = []
            for bucket, value in zip(batch["bucket"].to_pylist(), batch["found"].to_pylist(), strict=True):
                if bucket < 0:  # marks of hot windows are complete
                    out.append((-1 - bucket, value))
                    continue
                if bucket != current and held:
                    out += _marks(held)
                    held = []
                current = bucket
                held.append(unpack(value))
            yield _batch(out, ("__unit", "marks"), (pa.int32(), pa.binary()))
        if held:
            yield _batch(_marks(held), ("__unit", "marks"), (pa.int32(), pa.binary()))

    marks = placed.select(doc_id, text, "__unit").mapInArrow(candidates, "bucket long, found binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(group, "__unit int, marks binary")
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]

    def cut(_key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        release_sketch()  # workers live on; the sketch is needed no more
        if not rows.num_rows:
            return _without_rows(rows)
        marked = [unpack(m) for m in found["marks"].to_pylist()]
        ids, tags, places = (np.concatenate(c) for c in zip(*marked, strict=True)) if marked else (np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int32))
        order = np.lexsort((tags, ids))
        ids, tags, places = ids[order], tags[order], places[order]
        out = []
        for part in _words.slices(rows, text, SLICE):
            bounds, codes, vocabulary = _words.split_words(part[text])
            change = np.zeros(len(codes) + 1, np.int32)
            own_ids = ids_of(part, doc_id)
            low, high = np.searchsorted(ids, own_ids), np.searchsorted(ids, own_ids, side="right")
            raw = _words.one_array(part[text]).cast(pa.large_binary())
            for i in np.flatnonzero(high > low):
                tag = np.uint32(zlib.crc32(raw[int(i)].as_py()))
                a = low[i] + np.searchsorted(tags[low[i] : high[i]], tag)
                b = low[i] + np.searchsorted(tags[low[i] : high[i]], tag, side="right")
                np.add.at(change, bounds[i] + places[a:b], 1)
                np.add.at(change, bounds[i] + places[a:b] + width, -1)
            stays = np.cumsum(change[:-1]) == 0
            kept_bounds = np.concatenate([[0], np.cumsum(stays)])[bounds]
            words = vocabulary.cast(pa.string()).take(pa.array(codes[stays]))
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_bounds, pa.int32()), words), " ")
            n = np.diff(bounds)
            out.append(part.drop_columns(["__unit"]).append_column("n_words", pa.array(n)).append_column("n_removed", pa.array(n - np.diff(kept_bounds))).append_column("kept", kept))
        return pa.concat_tables(out)

    def _without_rows(rows: pa.Table) -> pa.Table:
        bare = rows.drop_columns(["__unit"])
        for name, kind in (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())):
            bare = bare.append_column(name, pa.array([], kind))
        return bare

    return placed.groupBy("__unit").cogroup(marks.groupBy("__unit")).applyInArrow(cut, T.StructType([*docs.schema.fields, *added]))


def _smallest_of_hot(docs: DataFrame, text: str, doc_id: str, width: int, n_cells: int, hot_cells: list[np.ndarray], hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows in hot cells, as sorted keys, and the smallest id of each."""
    cells = docs.sparkSession.sparkContext.broadcast(hot_cells)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _words.slices(batch, text, SLICE):
                both, of, _ = windows(rows, text, width)
                some = np.all([np.isin(cells_of(both[r], n_cells), cells.value[r]) for r in range(ROWS)], axis=0)
                ids = ids_of(rows, doc_id)[of[some]]
                keys, place = np.unique(_keys(both[0][some], both[1][some]), return_inverse=True)
                best = np.full(len(keys), NO_ID)
                np.minimum.at(best, place, ids)
                yield pa.RecordBatch.from_arrays([pa.array(keys["a"].astype(np.int64)), pa.array(keys["b"].astype(np.int64)), pa.array(best), pa.array(np.bincount(place, minlength=len(keys)))], names=["a", "b", "id", "n"])

    found = docs.select(doc_id, text).mapInArrow(least, "a long, b long, id long, n long").groupBy("a", "b").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    # Windows that only share a hot cell, and those beyond MOST_HOT, are grouped with all others.
    rows = found.where(F.col("n") >= hot // 2).orderBy(F.desc("n"), "a", "b").limit(MOST_HOT).select("a", "b", "id").toPandas()
    keys = _keys(rows["a"].to_numpy(np.int64).astype(np.uint64), rows["b"].to_numpy(np.int64).astype(np.uint64))
    order = np.argsort(keys)
    return keys[order], rows["id"].to_numpy(np.int64)[order]


def _keys(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.empty(len(h1), [("a", np.uint64), ("b", np.uint32)])
    out["a"], out["b"] = h1, (h2 & np.uint64(0xFFFFFFFF)).astype(np.uint32) if h2.dtype == np.uint64 else h2
    return out


def _lookup(hottest: tuple[np.ndarray, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, least = hottest
    known, out = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
    if len(keys):
        maybe = np.flatnonzero(np.isin(h1, keys["a"]))
        at = np.minimum(np.searchsorted(keys, _keys(h1[maybe], h2[maybe])), len(keys) - 1)
        same = (keys["a"][at] == h1[maybe]) & (keys["b"][at] == h2[maybe])
        known[maybe[same]], out[maybe[same]] = True, least[at[same]]
    return known, out


def _marks(held: list[list[np.ndarray]]) -> list[tuple[int, bytes]]:
    """The occurrences outside the smallest document of each window, by unit."""
    h1, h2, ids, tags, places, units = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((ids, h2, h1))
    h1, h2, ids, tags, places, units = (x[order] for x in (h1, h2, ids, tags, places, units))
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    marked = np.flatnonzero(ids > least)
    marked = marked[np.lexsort((places[marked], ids[marked], units[marked]))]
    own = units[marked]
    return [(int(own[a]), pack(ids[marked[a:b]], tags[marked[a:b]], places[marked[a:b]])) for a, b in _words.spans(own)]


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=list(names))
