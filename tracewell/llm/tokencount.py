"""Token counts of documents without token ids.

A tokenizer turns a text into pre-tokens and each of these, on its own, into pieces.  So the pieces of a text are
counted by its pre-tokens: documents are cut in slices of some megabytes, a slice becomes a list of its distinct
pre-tokens and the frequencies of these in each of its documents; equal pre-tokens of all slices meet, the pieces of each
are counted once, and the counts go back to the slices, where they are multiplied by the frequencies and summed.

Pre-tokens meet by a hash, in parts for each slice, so that a frequent one comes once from a slice and not once from a
document; a task remembers the pieces of up to ``REMEMBERED`` pre-tokens at a time and counts forgotten ones again.
The slices are written to the shared folder first, so that frequencies and pre-tokens stay those of one cut, whatever is
computed again after the loss of an executor.

The cut is the tokenizer's own: its special strings are taken out and count one each, then its normalizer and its
pre-tokenizer are applied.  Where no rule of these reaches over white space, which is tried with all pairs of kinds of
characters, the distinct words of a slice are cut instead of its texts.

Defined results: a null or empty text has 0 bytes and 0 tokens; null ids, repeated rows and texts of any length are rows
like others; an empty table gives no rows.  Other columns aren't looked at, so none can clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import _words
from tracewell.llm._pack import pack, unpack
from tracewell.llm._tables import written
from tracewell.llm._tokenizers import parts_at_space

SLICE = 16 << 20
#: Bytes of text to a bucket of pre-tokens; buckets at least and at most.
BUCKET_BYTES, FEW, MANY = 8 << 20, 64, 16_384
REMEMBERED = 500_000
#: Words that are cut at a time.
WORDS_AT_ONCE = 4096


class Cutter:
    """Cuts texts into the pre-tokens of a tokenizer and counts the pieces of a pre-token."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.pre_tokenizer is None:
            raise ValueError("the tokenizer has no pre-tokens")
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("special strings that take their surroundings with them aren't supported")
        specials = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.by_word = parts_at_space(self.plain, specials)

    def normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer is not None else text

    def plain(self, text: str) -> list[str]:
        """The pre-tokens of a text in which no special string counts."""
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.normal(text))] if text else []

    def units(self, texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """``(bounds, codes, vocabulary)`` of what is cut at once: words, or whole texts."""
        return _words.split_words(texts) if self.by_word else _words.whole_texts(texts)

    def cut(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pre-tokens of all units, one after the other, and of each unit how many, and its number of special strings."""
        found: list[str] = []
        sizes, specials = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        for first in range(0, len(units), WORDS_AT_ONCE):
            part = units[first : first + WORDS_AT_ONCE]
            joined = "\n".join(part)
            if not self.by_word or self.special is not None and self.special.search(joined) or not self.cut_joined(joined, part, first, found, sizes):
                for k, unit in enumerate(part, first):
                    pieces = self.special.split(unit) if self.special is not None else [unit]
                    specials[k] = len(pieces) - 1
                    own = [p for piece in pieces for p in self.plain(piece)]
                    sizes[k] = len(own)
                    found += own
        return found, sizes, specials

    def cut_joined(self, joined: str, part: list[str], first: int, found: list[str], sizes: np.ndarray) -> bool:
        """Cuts many words at once; False where their borders can't be told in the normalized text."""
        normal = self.normal(joined)
        points = np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), "<u4")
        borders = np.flatnonzero((points == ord(" ")) | (points == ord("\n")))
        if len(borders) != len(part) - 1:
            return False
        own = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        starts = np.fromiter((at for _, (at, _) in own), np.int64, len(own))
        sizes[first : first + len(part)] = np.bincount(np.searchsorted(borders, starts), minlength=len(part))
        found += [p for p, _ in own]
        return True

    def pieces(self, token: str) -> int:
        return len(self.tokenizer.model.tokenize(token))


_held: dict[str, Cutter] = {}


def cutter(path: str) -> Cutter:
    _words.take_over("tokencount", _held.clear)
    if path not in _held:
        _held[path] = Cutter(path)
    return _held[path]


def frequencies(found: Cutter, texts: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct pre-tokens of a slice, each text's special strings, and how many pre-tokens each text has, which and how often."""
    bounds, codes, vocabulary = found.units(texts)
    tokens, sizes, specials = found.cut(vocabulary.to_pylist())
    encoded = pa.array(tokens, pa.large_string()).dictionary_encode()
    own, distinct = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    extra = np.bincount(of, weights=specials[codes], minlength=len(bounds) - 1).astype(np.int64)
    n = sizes[codes]
    place = np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[codes] - (np.cumsum(n) - n), n)
    pairs, times = np.unique(np.repeat(of, n) * max(len(distinct), 1) + own[place], return_counts=True)
    rows, which = np.divmod(pairs, max(len(distinct), 1))
    return distinct, extra, (np.bincount(rows, minlength=len(bounds) - 1), which, times)


def strings_of(joined: np.ndarray, lengths: np.ndarray) -> list[str]:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(joined)).to_pylist()


def token_counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row of ``docs``, by the tokenizer in the file ``path``, special tokens not added."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(max(n_bytes // BUCKET_BYTES, FEW), MANY)
    id_field = T.StructField("doc_id", rows.schema["doc_id"].dataType)
    longs = T.ArrayType(T.LongType())
    part = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("tokens", T.BinaryType())])
    cut = T.StructType([T.StructField("slice", T.LongType()), T.StructField("ids", T.ArrayType(id_field.dataType)), T.StructField("n_bytes", longs), T.StructField("extra", longs), T.StructField("often", T.BinaryType()), T.StructField("n_distinct", T.LongType()), T.StructField("parts", T.ArrayType(part))])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, number = cutter(path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in _words.slices(batch, "text", SLICE):
                distinct, extra, (n, which, times) = frequencies(found, some["text"])
                sizes = pc.fill_null(pc.binary_length(some["text"]), 0).to_numpy().astype(np.int64)
                firsts = np.zeros(len(which), np.int64)  # gaps to the pre-token before, from 0 in each text
                firsts[1:] = which[:-1]
                firsts[(np.cumsum(n) - n)[n > 0]] = 0
                often = pack(n.astype(np.uint32), (which - firsts).astype(np.uint32), times.astype(np.uint32))
                to = ((_words.hash_words(distinct)[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) if len(distinct) else np.empty(0, np.int64)
                order = np.argsort(to, kind="stable")
                sorted_ = distinct.take(pa.array(order))
                ends, joined = np.frombuffer(sorted_.buffers()[1], np.int64)[: len(order) + 1], np.frombuffer(sorted_.buffers()[2] or b"", np.uint8)
                parts = []
                for a, b in _words.spans(to[order]):
                    parts.append({"bucket": int(to[order[a]]), "tokens": pack(np.diff(order[a:b], prepend=0).astype(np.uint32), np.diff(ends[a : b + 1]).astype(np.uint32), joined[ends[a] : ends[b]])})
                ids = some["doc_id"].combine_chunks()
                whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), whole(ids), whole(pa.array(sizes)), whole(pa.array(extra)), pa.array([often], pa.binary()), pa.array([len(distinct)]), pa.array([parts], pa.list_(pa.struct([("bucket", pa.int32()), ("tokens", pa.binary())])))],
                    names=cut.names,
                )
                number += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known, current = cutter(path), {}, None
        for batch in batches:
            out: list[tuple[int, bytes]] = []
            for bucket, number, tokens in zip(*(batch[c].to_pylist() for c in ("bucket", "slice", "tokens")), strict=True):
                if bucket != current or len(known) > REMEMBERED:
                    current, known = bucket, {}
                gaps, lengths, joined = unpack(tokens)
                own = strings_of(joined, lengths)
                for t in own:
                    if t not in known:
                        known[t] = found.pieces(t)
                out.append((number, pack(gaps, np.fromiter((known[t] for t in own), np.uint32, len(own)))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["slice", "pieces"])

    def summed(key: tuple, own: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        for r in range(own.num_rows):
            row = {c: own[c][r] for c in ("ids", "n_bytes", "extra", "often")}
            pieces = np.zeros(own["n_distinct"][r].as_py(), np.int64)
            for value in counts["pieces"].to_pylist():
                gaps, n = unpack(value)
                pieces[np.cumsum(gaps, dtype=np.int64)] = n
            n, gaps, times = (x.astype(np.int64) for x in unpack(row["often"].as_py()))
            ends = np.cumsum(n)
            upto = np.concatenate([[0], np.cumsum(gaps)])
            which = upto[1:] - np.repeat(upto[ends - n], n)
            total = np.concatenate([[0], np.cumsum(pieces[which] * times)])
            tokens = total[ends] - total[ends - n] + row["extra"].values.to_numpy()
            out.append(pa.table([row["ids"].values, row["n_bytes"].values, pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"]))
        return pa.concat_tables(out)

    known = written(rows.mapInArrow(slices, cut), "token-slices")
    tokens = known.select("slice", F.explode("parts").alias("p")).select("slice", "p.bucket", "p.tokens")
    counts = tokens.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "slice long, pieces binary")
    result = T.StructType([id_field, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return known.drop("parts").groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(summed, result)
