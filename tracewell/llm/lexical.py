"""Ranked lexical search over range-maximum tables of posting lists.

Documents are cut in blocks of some megabytes, and a block keeps the posting lists of the terms that are asked for: the
places of the documents that hold a term, in order, and how often they do.  Once the corpus counts (documents, terms,
documents with a term) are summed over all blocks, each posting has an impact, and a sparse table over the lists of
a block names the largest impact of any range of a list by two lookups.

A block is searched best-first for each item.  An interval of documents is bounded by the sum of its range maxima over the
item's terms; the interval with the highest bound is split at the document of its largest single impact, which is scored
exactly, and both rests get bounds of their own.  A search ends when no bound reaches the k-th best score that the task
has found, in this block or an earlier one.  Intervals are popped some at a time, so that lookups are vectorised.  The
best of all tasks meet in a ranking by item, which Spark cuts to k rows an item before it shuffles.

The index of the blocks is written to the shared folder.  Items are asked in groups of about ``TERMS_AT_ONCE`` distinct
terms, which is what is broadcast and what the table of document frequencies has at most, unless one item has more.

Scores are integers: a term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), its impact in a document
(10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L, and a document's score the sum of weight times impact over an
item's terms, repeats included.

Defined results: a null or empty text has no term; items without a known term find nothing; equal scores go to the smaller
id, then null ids; rows with equal ids are documents of their own, as are items with equal ids; texts of any length count
whole; empty tables give no rows.  Other columns aren't looked at, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import _words
from tracewell.llm._pack import pack, unpack
from tracewell.llm._tables import written

SLICE = 16 << 20
#: Distinct terms of a group of items, summed over the items.
TERMS_AT_ONCE = 200_000
#: Blocks that a task searches, one after the other: its first ones bound the search of the others.
BLOCKS = 4
#: Intervals that are split at a time, at first and at most.
FIRST_BATCH, BATCH = 16, 512
NO_ID = np.iinfo(np.int64).max
#: Bytes of texts to those of terms: ASCII letters and digits stay, capitals become small, other ASCII parts terms.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def split_terms(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(bounds, codes, vocabulary)`` of the terms of each text."""
    whole = _words.one_array(texts)
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    folded = FOLD[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.empty(0, np.uint8)
    return _words.split_words(pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(ends - ends[0]), pa.py_buffer(folded)))


def counted_terms(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """``id, terms, times``: the distinct terms of each text, in order, and how often each occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _words.slices(batch, "text", SLICE):
                bounds, codes, vocabulary = split_terms(some["text"])
                v = max(len(vocabulary), 1)
                pairs, times = np.unique(np.repeat(np.arange(some.num_rows), np.diff(bounds)) * v + codes, return_counts=True)
                ends = np.searchsorted(pairs, np.arange(some.num_rows + 1) * v).astype(np.int32)
                terms = vocabulary.cast(pa.string()).take(pa.array(pairs % v))
                yield pa.RecordBatch.from_arrays([some["id"].combine_chunks(), pa.ListArray.from_arrays(pa.array(ends), terms), pa.ListArray.from_arrays(pa.array(ends), pa.array(times))], names=["id", "terms", "times"])

    schema = T.StructType([T.StructField("id", rows.schema[id_].dataType), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.LongType()))])
    return rows.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(count, schema)


@dataclass
class Asked:
    """A group of items: their terms by number in ``vocabulary``, which is in order, and how often each item has them."""

    ids: list
    vocabulary: list[str]
    terms: list[np.ndarray]
    times: list[np.ndarray]


@dataclass
class Corpus:
    documents: int
    terms: int
    weights: np.ndarray  # of each term of the vocabulary; 0 for one that no document has
    blocks: int = 1


INDEX = "ids array<long>, lengths array<long>, documents long, terms long, listed binary, postings binary"


def index_blocks(docs: DataFrame, asked: Asked, doc_id: str, text: str) -> DataFrame:
    """A row for each block: ids and lengths of its documents, and the posting lists of the asked terms."""
    shared = docs.sparkSession.sparkContext.broadcast(asked.vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _words.take_over("lexical")
        wanted = pa.array(shared.value, pa.large_string())
        for batch in batches:
            for some in _words.slices(batch, "text", SLICE):
                bounds, codes, vocabulary = split_terms(some["text"])
                number = pc.fill_null(pc.index_in(vocabulary.cast(pa.large_string()), wanted), -1).to_numpy()[codes].astype(np.int64)
                n, known = np.diff(bounds), np.flatnonzero(number >= 0)
                of = np.repeat(np.arange(some.num_rows), n)
                pairs, times = np.unique(number[known] * some.num_rows + of[known], return_counts=True)
                term, place = np.divmod(pairs, some.num_rows)
                firsts = np.flatnonzero(np.diff(term, prepend=-1))
                gaps = np.diff(place, prepend=0)
                gaps[firsts] = place[firsts]
                listed = pack(np.diff(term[firsts], prepend=0).astype(np.uint32), np.diff(np.append(firsts, len(term))).astype(np.uint32))
                whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [whole(some["id"].combine_chunks()), whole(pa.array(n)), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), pa.array([listed], pa.binary()), pa.array([pack(gaps.astype(np.uint32), times.astype(np.uint32))], pa.binary())],
                    names=[f.split()[0] for f in INDEX.split(", ")],
                )

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(build, INDEX)


def corpus_counts(index: DataFrame, asked: Asked) -> Corpus:
    """The counts of all blocks; the driver gets a row for each asked term."""
    n_terms = len(asked.vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for listed in batch["listed"].to_pylist():
                gaps, sizes = unpack(listed)
                total[np.cumsum(gaps, dtype=np.int64)] += sizes
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    n, length, blocks = index.agg(F.sum("documents"), F.sum("terms"), F.count("*")).first()
    weights = np.zeros(n_terms, np.int64)
    for term, df in index.select("listed").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    return Corpus(n or 0, length or 0, weights, blocks)


class Block:
    """The posting lists of a block, one after the other, with impacts and a table of range maxima over all of them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, listed: bytes, postings: bytes, corpus: Corpus) -> None:
        gaps, sizes = (x.astype(np.int64) for x in unpack(listed))
        steps, tf = (x.astype(np.int64) for x in unpack(postings))
        self.ids, self.terms = ids, np.cumsum(gaps)
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        upto = np.cumsum(steps)
        self.place = upto - np.repeat(upto[self.starts] - steps[self.starts], sizes) if len(sizes) else upto
        if 25 * int(lengths.max(initial=0)) * corpus.documents < 1 << 63:
            share = 25 * lengths * corpus.documents // max(corpus.terms, 1)
        else:
            share = np.array([25 * int(x) * corpus.documents // corpus.terms for x in lengths], np.int64)
        self.impact = (1_000_000_000 * tf // (1000 * tf + 12 * (75 + share[self.place]))).astype(np.int32)
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * len(ids) + self.place
        self.maxima = self.tables(int(sizes.max(initial=0)))

    def tables(self, longest: int) -> list[np.ndarray]:
        """Level l has at i the place of the largest impact of 2^l postings from i on, of equal ones the first."""
        at, value = np.arange(len(self.impact), dtype=np.int32), self.impact
        out = [at]
        for level in range(1, max(longest, 1).bit_length()):
            half = 1 << (level - 1)
            later = value[half:] > value[:-half]
            at, value = np.where(later, at[half:], at[:-half]), np.where(later, value[half:], value[:-half])
            out.append(at)
        # One array for all levels: a level ends before the lists do, and nothing is looked up beyond its end.
        self.bases = np.cumsum([0, *(len(x) for x in out[:-1])])
        self.flat = np.concatenate(out)
        return out

    def range_maxima(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the largest impacts of ranges of postings; 0 for an empty one."""
        size = hi - lo
        full = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        base = self.bases[level]
        a = self.flat[np.where(full, base + lo, 0)]
        b = self.flat[np.where(full, base + hi - (1 << level), 0)]
        at = np.where(self.impact[b] > self.impact[a], b, a)
        return at, np.where(full, self.impact[at], 0)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Adds to ``best`` whatever belongs there; returns how many documents were scored."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        own = np.flatnonzero((self.terms[at] == terms) & (weights > 0)) if len(self.terms) else np.empty(0, np.int64)
        if not len(own):
            return 0
        lists, weights = at[own], weights[own]
        lo, hi = self.starts[lists][None, :], self.stops[lists][None, :]
        top, value = self.range_maxima(lo, hi)
        bound = (value * weights).sum(axis=1)
        scored, batch, used = 0, FIRST_BATCH, 1
        while True:
            open_ = np.flatnonzero(bound[:used] >= best.least)
            if not len(open_):
                return scored
            if len(open_) > batch:
                open_ = open_[np.argpartition(-bound[open_], batch)[:batch]]
            batch = min(2 * batch, BATCH)
            of = top[open_]
            first = (self.impact[of] * weights * (hi[open_] > lo[open_])).argmax(axis=1)
            doc = self.place[of[np.arange(len(of)), first]]
            cut = np.searchsorted(self.keys, lists * len(self.ids) + doc[:, None])
            there = np.minimum(cut, len(self.keys) - 1)
            inside = (cut < hi[open_]) & (self.place[there] == doc[:, None])
            best.add((np.where(inside, self.impact[there], 0) * weights).sum(axis=1), self.ids[doc])
            scored += len(doc)
            low, high = np.concatenate([lo[open_], cut + inside]), np.concatenate([cut, hi[open_]])
            new_top, value = self.range_maxima(low, high)
            new_bound = (value * weights).sum(axis=1)
            bound[open_] = -1
            keep = np.flatnonzero(new_bound >= best.least)
            # Split intervals' places are taken by the rests, then new places.
            slots = np.concatenate([open_, np.arange(used, used + len(open_))])[: len(keep)]
            used = max(used, int(slots.max(initial=-1)) + 1)
            if used > len(bound):
                grow = lambda x, n=2 * used: np.concatenate([x, np.zeros((n - len(x), *x.shape[1:]), x.dtype)])
                lo, hi, top, bound = grow(lo), grow(hi), grow(top), grow(bound)
                bound[used:] = -1
            lo[slots], hi[slots], top[slots], bound[slots] = low[keep], high[keep], new_top[keep], new_bound[keep]


class Best:
    """The k best documents of an item so far; ``least`` is the score that another one must reach."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.flatnonzero(scores >= self.least)
        scores, ids = np.concatenate([self.scores, scores[some]]), np.concatenate([self.ids, ids[some]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def best_of_blocks(index: DataFrame, asked: Asked, corpus: Corpus, k: int, kind: T.DataType) -> DataFrame:
    """``item, item_id, doc_id, score``: the k best documents of each item in the blocks of each task."""
    shared = index.sparkSession.sparkContext.broadcast((asked, corpus))
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, corpus = shared.value
        best = [Best(k) for _ in asked.ids]
        for batch in batches:
            for r in range(batch.num_rows):
                ids = pc.fill_null(batch["ids"][r].values, NO_ID).to_numpy()
                block = Block(ids, batch["lengths"][r].values.to_numpy(), batch["listed"][r].as_py(), batch["postings"][r].as_py(), corpus)
                for terms, times, found in zip(asked.terms, asked.times, best, strict=True):
                    block.search(terms, corpus.weights[terms] * times, found)
        item = np.repeat(np.arange(len(best)), [len(b.ids) for b in best]).astype(np.int32)
        ids = np.concatenate([np.empty(0, np.int64), *(b.ids for b in best)])
        scores = np.concatenate([np.empty(0, np.int64), *(b.scores for b in best)])
        names = pa.array(asked.ids, batch_type).take(pa.array(item))
        yield pa.RecordBatch.from_arrays([pa.array(item), names, pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(kind)
    # Blocks are alike in size, while files of the index hold as many as their task has made.
    return index.select("ids", "lengths", "listed", "postings").repartition(max(1, -(-corpus.blocks // BLOCKS))).mapInArrow(search, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` the ``k`` best rows of ``docs`` with a score above 0."""
    wanted = written(counted_terms(items, item_id, text), "asked")
    total = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = max(1, -(-total // terms_at_once))
    kind = items.schema[item_id].dataType
    out = None
    for g in range(groups):
        rows = wanted.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("id", "terms"), F.lit(groups)) == g)).collect()  # about terms_at_once terms
        if not rows:
            continue
        vocabulary = sorted({t for r in rows for t in r.terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        asked = Asked([r.id for r in rows], vocabulary, [np.array([number[t] for t in r.terms], np.int64) for r in rows], [np.array(r.times, np.int64) for r in rows])
        index = written(index_blocks(docs, asked, doc_id, text), f"lexical-{g}")
        found = best_of_blocks(index, asked, corpus_counts(index, asked), k, kind)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    return out
