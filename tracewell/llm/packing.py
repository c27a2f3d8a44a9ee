"""Packing token sequences by cutting-stock column generation.

Documents become token ids; a document longer than a sequence is cut into full pieces and a rest.  Piece
lengths are rounded up to units, short ones after they have been put together in bundles, and the histogram
over the units (a fixed number of counts, whatever the
input) defines a cutting-stock problem: cover all counts with the fewest patterns.  The linear program is
solved by column generation, where a knapsack over the units prices the columns; patterns are rounded down
and what is left is filled greedily, largest first.  Pieces are ranked within their length class, in blocks
so that no task orders a whole class, and the rank names the pattern, sequence and place of a piece.

Tokens of a text are found word by word, each distinct word of a batch once, where the tokenizer drops white space and no
rule of it reaches over white space; that is tried with all pairs of kinds of characters, and other tokenizers get whole texts.

Defined results: a null or empty text has the closing id alone; null ids are ids like others; equal rows are packed
once each; a text of any length is cut whole, in slices of one row at least; of other columns of the documents none is
kept, so that no name can clash; an empty table gives no pieces.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import _words
from tracewell.llm._tables import written
from tracewell.llm._tokenizers import parts_at_space

LENGTH = 4096
UNITS = 256
END_ID = 2
#: Words whose ids a worker remembers, and the ids that one of them has at most.
REMEMBERED, LONGEST = 400_000, 64
#: New words are encoded so many at a time, parted by the mark.
ENCODE_WORDS, MARK = 1024, "\x01"
#: Pieces below ``SHORT`` units are put together in bundles of ``BUNDLE`` units or a little more.
SHORT, BUNDLE = 4, 28
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordTokens:
    """The ids of distinct words, with a bounded memory of earlier ones.

    A remembered word is two 64-bit hashes and the place of its ids, all in arrays.  When the memory is full, words that
    weren't met again since the last time are forgotten.  New words are encoded many at a time, parted by a mark that
    the tokenizer turns into one id of its own; where the marks can't be told from the words, one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.by_word = parts_at_space(ids, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        own = [ids(x) for x in ("a", MARK, f"a {MARK} a")]
        self.mark = own[1][0] if self.by_word and len(own[1]) == 1 and own[2] == own[0] + own[1] + own[0] else None
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.starts, self.sizes, self.again = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.ids = np.empty(0, np.uint32)

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        parts = [words[k : k + ENCODE_WORDS] for k in range(0, len(words), ENCODE_WORDS)]
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for part in parts:
            joined = f" {MARK} ".join(part)
            if self.mark is not None and joined.count(MARK) == len(part) - 1:
                found = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                marks = np.flatnonzero(found == self.mark)
                if len(marks) == len(part) - 1:
                    ids.append(np.delete(found, marks))
                    sizes.append(np.diff(np.concatenate([[-1], marks, [len(found)]])) - 1)
                    continue
            single = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            ids.append(np.fromiter(itertools.chain.from_iterable(single), np.uint32))
            sizes.append(np.fromiter(map(len, single), np.int64, len(single)))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, starts, lengths)``: word ``i`` has ``ids[starts[i] : starts[i] + lengths[i]]``."""
        first, second = _words.hash_words(vocabulary)
        at = np.searchsorted(self.first, first)
        inside = np.minimum(at, max(len(self.first) - 1, 0))
        known = (self.first[inside] == first) & (self.second[inside] == second) if len(self.first) else np.zeros(len(first), bool)
        new = np.flatnonzero(~known)
        more, n = self.fresh(vocabulary.take(pa.array(new)).to_pylist())
        ids = np.concatenate([self.ids, more])
        starts, sizes = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        starts[known], sizes[known] = self.starts[inside[known]], self.sizes[inside[known]]
        starts[new], sizes[new] = len(self.ids) + np.cumsum(n) - n, n
        self.again[inside[known]] = True
        self.remember(first[new], second[new], starts[new], n, ids)
        return ids, starts, sizes

    def remember(self, first: np.ndarray, second: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        short = sizes <= LONGEST
        columns = [(self.first, first[short]), (self.second, second[short]), (self.starts, starts[short]), (self.sizes, sizes[short]), (self.again, np.zeros(short.sum(), bool))]
        first, second, starts, sizes, again = (np.concatenate(c) for c in columns)
        if len(first) > REMEMBERED:
            stays = np.flatnonzero(again)[:REMEMBERED >> 1]
            first, second, starts, sizes, again = first[stays], second[stays], starts[stays], sizes[stays], np.zeros(len(stays), bool)
        order = np.argsort(first, kind="stable")
        self.first, self.second, starts, self.sizes, self.again = (x[order] for x in (first, second, starts, sizes, again))
        ends = np.cumsum(self.sizes)
        self.ids = ids[np.repeat(starts - (ends - self.sizes), self.sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.starts = ends - self.sizes


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def token_ids(texts: pa.ChunkedArray | pa.Array, tokens: WordTokens, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """``(bounds, ids)`` of the texts, each text closed by ``end_id``."""
    bounds, codes, vocabulary = _words.split_words(texts) if tokens.by_word else _words.whole_texts(texts)
    ids, starts, lengths = tokens.encode(vocabulary)
    sizes = lengths[codes]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = ids[np.repeat(starts[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
    per_text = np.diff(ends[bounds])
    out_bounds = np.concatenate([[0], np.cumsum(per_text + 1)])
    out = np.full(out_bounds[-1], end_id, np.dtype("<u4"))
    inside = np.ones(len(out), bool)
    inside[out_bounds[1:] - 1] = False
    out[inside] = flat
    return out_bounds, out


def cut_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; ``with_ids`` adds their ids as an array."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _words.take_over("packing", _tokens.clear)
        tokens = word_tokens(tokenizer)
        for batch in batches:
            for rows in _words.slices(batch, "text"):
                bounds, ids = token_ids(rows["text"], tokens, end_id)
                sizes = np.diff(bounds)
                pieces = -(-sizes // length)
                of = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                size = np.minimum(length, sizes[of] - start)
                at = bounds[of] + start
                crc = np.fromiter((zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)), np.int64, len(at))
                columns = [rows["doc_id"].combine_chunks().take(pa.array(of)), start, size, crc, sizes[of]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                columns = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns]
                yield from pa.table(columns, names=names).combine_chunks().to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def best_pattern(widths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: how often each width is used in the most valuable pattern.  Widths ascend."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = np.searchsorted(widths, c, side="right")
        best[c] = best[c - 1]
        if n:
            found = values[:n] + best[c - widths[:n]]
            i = int(found.argmax())
            if found[i] > best[c] + 1e-12:
                best[c], chosen[c] = found[i], i
    pattern, c = np.zeros(len(widths), np.int64), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            pattern[chosen[c]] += 1
            c -= widths[chosen[c]]
    return float(best[capacity]), pattern


def inverted(basis: np.ndarray, estimate: np.ndarray) -> np.ndarray:
    """The inverse by elimination; the estimate where the basis is singular to working precision.

    Element by element on purpose: threaded linear algebra in a process that also runs a Spark driver may never end.
    """
    m = len(basis)
    a = np.concatenate([basis, np.eye(m)], axis=1)
    for c in range(m):
        p = c + int(np.abs(a[c:, c]).argmax())
        if abs(a[p, c]) < 1e-11:
            return estimate
        a[[c, p]] = a[[p, c]]
        a[c] /= a[c, c]
        factor = a[:, c].copy()
        factor[c] = 0
        a -= factor[:, None] * a[c]
    return a[:, m:]


def cutting_stock(counts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often each is used, so that together they hold ``counts[u - 1]`` pieces of ``u`` units."""
    counts = np.asarray(counts, np.int64)
    capacity, widths = len(counts), np.flatnonzero(counts) + 1
    demand, m = counts[widths - 1].astype(float), len(widths)
    if not m:
        return []
    basis = np.diag(capacity // widths).astype(float)  # a column for each pattern
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for step in range(30 * m + 100):
        value, pattern = best_pattern(widths, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        d = (inverse * pattern).sum(axis=1)
        ratio = np.where(d > 1e-10, x / np.where(d > 1e-10, d, 1), np.inf)
        r = int(ratio.argmin())
        basis[:, r] = pattern
        row = inverse[r] / d[r]
        inverse -= d[:, None] * row
        inverse[r] = row
        if step % 100 == 99:
            inverse = inverted(basis, inverse)
        x = np.maximum((inverse * demand).sum(axis=1), 0)
    left, used = counts.copy(), []

    def use(times: int, units: np.ndarray) -> None:
        if times > 0:
            used.append((int(times), units))
            left[:] -= times * units

    for k in np.argsort(-x, kind="stable"):
        units = np.zeros(capacity, np.int64)
        units[widths - 1] = np.rint(basis[:, k]).astype(np.int64)
        some = units > 0
        use(min(int(x[k] + 1e-6), int((left[some] // units[some]).min())), units)
    while left.any():
        units, room = np.zeros(capacity, np.int64), capacity
        for u in np.flatnonzero(left)[::-1] + 1:
            units[u - 1] = n = min(int(left[u - 1]), room // int(u))
            room -= n * int(u)
        some = units > 0
        use(int((left[some] // units[some]).min()), units)
    return used


class Places:
    """Where the piece of a given rank in its length class goes."""

    def __init__(self, used: list[tuple[int, np.ndarray]]) -> None:
        sequences = np.cumsum([0] + [n for n, _ in used])
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for u in {int(i) + 1 for _, units in used for i in np.flatnonzero(units)}:
            own = [(n * units[u - 1], base, units[u - 1]) for (n, units), base in zip(used, sequences[:-1], strict=True) if units[u - 1]]
            sizes, bases, each = (np.array(c, np.int64) for c in zip(*own, strict=True))
            self.of[u] = np.cumsum(sizes) - sizes, bases, each

    def sequence(self, units: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.empty(len(ranks), np.int64)
        for u in np.unique(units):
            here = units == u
            firsts, bases, each = self.of[int(u)]
            k = np.searchsorted(firsts, ranks[here], side="right") - 1
            out[here] = bases[k] + (ranks[here] - firsts[k]) // each[k]
        return out


def pack(pieces: DataFrame, length: int = LENGTH, units: int = UNITS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; no sequence is longer than ``length``."""
    unit = length // units
    if unit * units != length:
        raise ValueError("length must be a multiple of units")
    pieces = written(pieces, "pieces")
    names = pieces.columns
    place_order = [n for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens") if n in names]
    blocks = max(16, pieces.count() // 1_000_000)
    keyed = pieces.withColumn("__block", F.pmod(F.xxhash64(*place_order), F.lit(blocks)).cast("int"))

    # Short pieces become bundles, which are packed like long pieces.
    upto = Window.partitionBy("__block").orderBy(*place_order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("length").over(upto), F.lit(0))
    is_short = F.col("length") < SHORT * unit
    short = keyed.where(is_short).withColumn("__bundle", F.floor(before / (BUNDLE * unit)).cast("long"))
    bundles = short.groupBy("__block", "__bundle").agg(F.sum("length").alias("__size"))
    items = keyed.where(~is_short).withColumn("__bundle", F.lit(None).cast("long")).withColumn("__size", F.col("length"))
    items = items.unionByName(bundles, allowMissingColumns=True).withColumn("__units", F.ceil(F.col("__size") / unit).cast("int"))

    per = written(items.groupBy("__units", "__block").agg(F.count("*").alias("__n")), "classes")
    counts = np.zeros(units, np.int64)
    for u, n in per.groupBy("__units").agg(F.sum("__n")).collect():  # a row for each unit
        counts[u - 1] = n
    places = Places(cutting_stock(counts))
    first = F.sum("__n").over(Window.partitionBy("__units").orderBy("__block")) - F.col("__n")
    order = Window.partitionBy("__units", "__block").orderBy(*place_order, "__bundle")
    ranked = items.join(per.withColumn("__first", first).drop("__n"), ["__units", "__block"]).withColumn("__rank", F.row_number().over(order) - 1 + F.col("__first"))
    carried = [*names, "__block", "__bundle"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.sequence(batch["__units"].to_numpy(), batch["__rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in carried), pa.array(found)], names=[*carried, "sequence_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*carried).schema.fields) + ", sequence_id long"
    placed = written(ranked.select(*carried, "__units", "__rank").mapInArrow(place, schema), "placed")
    whole = placed.where("__bundle is null").select(*names, "sequence_id")
    bundled = short.join(placed.where("__bundle is not null").select("__block", "__bundle", "sequence_id"), ["__block", "__bundle"])
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *place_order).rowsBetween(Window.unboundedPreceding, -1)
    return whole.unionByName(bundled.select(*names, "sequence_id")).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))


def sequences(packed: DataFrame, pieces_with_ids: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``sequence_id, input_ids``: the packed ids, padded to ``length``."""
    ids = pieces_with_ids.select("doc_id", "start", "ids")
    parts = packed.select("doc_id", "start", "sequence_id", "offset").join(ids, ["doc_id", "start"])
    whole = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(length) - F.size("ids"))).alias("input_ids"))
