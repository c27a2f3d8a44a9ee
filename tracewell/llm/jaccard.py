"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles.  A set is embedded as ``POSITIONS`` minhash values; two sets agree at a
position with the probability of their Jaccard similarity.  A run of the join splits all sets recursively: a
node of its tree samples positions, each with probability 1 / (``threshold`` x ``POSITIONS``), and sends a set
down one branch for every sampled position, named by the set's value there.  A bucket of ``LEAF`` sets or
fewer is searched by brute force; a larger one is split again, down to a depth that grows with the logarithm of
the number of sets, so that unrelated sets part before.  What is still together there is searched by brute force
in pairs of chunks.  Runs repeat until the chance to miss a pair at the threshold is below 1 - ``recall``, summed
over the positions in which such a pair may agree.

Brute force over minhash values only has to connect: it keeps a spanning forest of the pairs that agree well
enough, and its components are candidate groups.  Within each candidate group the shingle sets themselves are
compared, every pair of them, chunk against chunk: that counts each document's links exactly and connects the
final classes.  Each set is hashed once and sent to the chunk pairs of its group as numbers; a chunk holds as many
sets as a task can compare.  Documents with equal sets are one representative throughout, so copies cost nothing.

No task gets all rows of a frequent path, group or node: keys with more than a ten-thousandth of all rows, of which
there are ten thousand at most, are joined by broadcast, wherever their rows lie.

Defined results: a text of fewer than ``WIDTH`` words has the one shingle of all its words; texts without words
and null texts are linked to nothing; ids that occur twice with equal sets count as two documents; a null id
is an id, first in order; texts of any length are taken whole; other columns aren't looked at, so none can clash; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import _words
from tracewell.llm._tables import written

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.999
POSITIONS, LEAF = 128, 48
#: The chance that unrelated sets agree at a position, from which the depth follows.
BACKGROUND = 0.05
#: Sets to a chunk of minhash values; sets to a chunk of a small group; shingles to a chunk at most.
LEAF_CHUNK, CHUNK, CHUNK_SHINGLES = 8192, 256, 1 << 20
#: Keys that may be joined by broadcast: those with more than this part of all rows.
HOT_KEYS = 10_000
#: Standard errors of the minhash estimate that a pair at the threshold may fall below it.
SLACK = 4.0
SLICE = 8 << 20
SETS = "doc_id long, text_key long, node long, n_shingles int, values binary"
#: Stands for a null id: smaller than all others.
NO_ID = -(1 << 63)


def shingle_sets(texts: pa.ChunkedArray | pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(bounds, hashes)``: the distinct shingle hashes of each text in ascending order."""
    bounds, codes, vocabulary = _words.split_words(texts)
    hashes = _words.hash_words(vocabulary)[0][codes]
    starts, counts = _words.window_starts(bounds, width)
    rolled = _words.roll(hashes, width, _words.MULTIPLIERS[0])[starts] if len(starts) else np.empty(0, np.uint64)
    of = np.repeat(np.arange(len(counts)), counts)
    sizes = np.diff(bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    whole = np.array([_words.roll(hashes[bounds[i] : bounds[i + 1]], int(sizes[i]), _words.MULTIPLIERS[1])[0] for i in short], np.uint64)
    of, values = np.concatenate([of, short]), np.concatenate([rolled, whole])
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
    of, values = of[new], values[new]
    return np.searchsorted(of, np.arange(len(sizes) + 1)), values


def minhash(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minhash values of each non-empty set, shape ``(sets, POSITIONS)``; ``bounds`` of non-empty sets only."""
    seeds = _words.mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * _words.MULTIPLIERS[0]) | np.uint64(1)
    out = np.empty((len(bounds) - 1, POSITIONS), np.uint32)
    for p, seed in enumerate(seeds):
        x = values * seed
        x ^= x >> np.uint64(29)
        x *= _words.MULTIPLIERS[1]
        out[:, p] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), bounds[:-1])
    return out


def depth_for(n_sets: int) -> int:
    """The depth at which a bucket holds about ``LEAF`` unrelated sets."""
    return max(2, math.ceil(math.log(max(n_sets, 1) / LEAF, 1 / BACKGROUND))) if n_sets > LEAF else 2


def runs_for(recall: float, depth: int, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold has been found with probability ``recall``.

    All runs look at the same minhash values, so the chance is summed over the number of positions in which the
    pair agrees; pairs that agree in too few of them to pass the comparison count as missed.
    """
    agree = np.arange(POSITIONS + 1)
    chance = np.array([math.comb(POSITIONS, x) * threshold**x * (1 - threshold) ** (POSITIONS - x) for x in agree])
    chance[agree < least_agreement(threshold) * POSITIONS] = 0
    found = np.ones(POSITIONS + 1)
    for _ in range(depth):
        found = 1 - (1 - found / (threshold * POSITIONS)) ** agree
    if chance.sum() <= recall:
        raise ValueError("so high a recall needs more positions")
    n = 1
    while (chance * (1 - (1 - found) ** n)).sum() < recall:
        n += 1
    return n


def least_agreement(threshold: float) -> float:
    """The share of equal positions from which on a pair is compared."""
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / POSITIONS)


def skew_join(rows: DataFrame, per_key: DataFrame, key: str, total: int) -> DataFrame:
    """``rows``, of which there are ``total``, with the one row that ``per_key`` has for their key; others go.

    ``per_key`` has ``n``, how many rows have the key.  Keys with more than ``total`` / ``HOT_KEYS`` rows, ``HOT_KEYS``
    of them at most, are broadcast; so no task of the shuffled join gets more rows of a key than that.
    """
    limit = max(LEAF, total // HOT_KEYS)
    hot = F.broadcast(per_key.where(F.col("n") > limit))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key.where(F.col("n") <= limit), key)
    return rest.unionByName(rows.join(hot, key))


def sampled(paths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each node the positions that it samples, as pairs of node and position."""
    draws = _words.mix(paths[:, None] ^ _words.mix(np.arange(POSITIONS, dtype=np.uint64) + np.uint64(0x51ED27)))
    return np.nonzero(draws < np.uint64(int(2.0**64 / (threshold * POSITIONS))))


def branches(paths: np.ndarray, of: np.ndarray, values: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes ``paths`` that the sets in rows ``of`` of ``values`` go to: ``(index into paths, child)``."""
    distinct, inverse = np.unique(paths, return_inverse=True)
    node, position = sampled(distinct, threshold)
    first = np.searchsorted(node, np.arange(len(distinct) + 1))
    n = np.diff(first)[inverse]
    index = np.repeat(np.arange(len(paths)), n)
    chosen = position[np.arange(n.sum()) + np.repeat(first[:-1][inverse] - (np.cumsum(n) - n), n)]
    value = values[of[index], chosen].astype(np.uint64)
    return index, _words.mix(paths[index] ^ _words.mix(value * _words.MULTIPLIERS[0] + chosen.astype(np.uint64)))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the pairs ``a, b`` that form a spanning forest over ``n`` nodes."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Sorted rows as tables of whole groups, with the bounds of the groups."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for key in keys:
            column = table[key].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        edges = np.flatnonzero(new).tolist()
        if len(edges) > 1:
            yield table.slice(0, edges[-1]).combine_chunks(), list(zip(edges[:-1], edges[1:], strict=True))
        held = table.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), [(0, held.num_rows)]


def _long_batch(columns: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in flat], names=list(columns))


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """``SETS`` of every document: its shingle set's hash and, if that has shingles, its minhash values."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _words.take_over("jaccard")
        for batch in batches:
            for rows in _words.slices(batch, "text", SLICE):
                bounds, values = shingle_sets(rows["text"], width)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                signatures = minhash(values, np.append(bounds[full], bounds[-1])) if len(full) else np.empty((0, POSITIONS), np.uint32)
                binary = np.full(len(sizes), None, object)
                binary[full] = [s.tobytes() for s in signatures]
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"].combine_chunks(), rows["text_key"].combine_chunks(), pa.array(set_hashes(bounds, values)), pa.array(sizes.astype(np.int32)), pa.array(binary.tolist(), pa.binary())],
                    names=[f.split()[0] for f in SETS.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(embed, SETS)


def order_id() -> F.Column:
    """The id as a key to join and order by, never null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def text_key() -> F.Column:
    """A hash of the text, which tells rows of one id apart."""
    return F.xxhash64("text")


def set_hashes(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for empty ones."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    if len(full):
        a, b = (np.add.reduceat(_words.mix(values ^ m), bounds[full]) for m in _words.MULTIPLIERS)
        out[full] = _words.mix(a ^ _words.mix(b + sizes[full].astype(np.uint64)))
    return out.astype(np.int64)


def candidate_edges(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``a, b``: pairs of representatives that connect all candidate groups.  ``reps`` has ``rep`` and ``values``."""
    max_depth = depth_for(reps.count())
    n_runs, least = runs_for(recall, max_depth, threshold), least_agreement(threshold)
    roots = _words.mix(np.arange(n_runs, dtype=np.uint64) + np.uint64(0xC0FFEE))

    def descend(from_root: bool):
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                values = np.frombuffer(b"".join(batch["values"].to_pylist()), np.uint32).reshape(n, POSITIONS)
                of = np.repeat(np.arange(n), n_runs) if from_root else np.arange(n)
                paths = np.tile(roots, n) if from_root else batch["path"].to_numpy().astype(np.uint64)
                index, child = branches(paths, of, values, threshold)
                yield pa.RecordBatch.from_arrays([batch["rep"].take(pa.array(of[index])), pa.array(child.astype(np.int64))], names=["rep", "path"])

        return split

    level = reps.select("rep", "values").mapInArrow(descend(True), "rep long, path long")
    buckets: DataFrame | None = None
    for depth in range(1, max_depth + 1):
        level = written(level, f"paths-{depth}")
        sizes = written(level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), f"sizes-{depth}")
        tagged = skew_join(level, sizes, "path", level.count())
        small = tagged.where(F.col("n") <= LEAF).groupBy("path").agg(F.sort_array(F.collect_set("rep")).alias("members"))
        small = small.select("members").distinct()  # runs meet the same groups again
        small = small.select(F.xxhash64("members").alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), F.explode("members").alias("rep"))
        buckets = small if buckets is None else buckets.unionByName(small)
        large = tagged.where(F.col("n") > LEAF)
        if depth < max_depth:
            level = large.select("rep", "path").join(reps.select("rep", "values"), "rep").mapInArrow(descend(False), "rep long, path long")
        else:
            large = large.withColumn("chunks", F.ceil(F.col("n") / LEAF_CHUNK).cast("int"))
            buckets = buckets.unionByName(in_chunks(large, F.col("path").alias("bucket")))

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in runs(batches, ("bucket", "i", "j")):
            rep, own, i, j = (table[n].to_numpy() for n in ("rep", "own", "i", "j"))
            values = np.frombuffer(b"".join(table["values"].to_pylist()), np.uint32).reshape(len(rep), POSITIONS)
            found: dict[str, list[np.ndarray]] = {"a": [], "b": []}
            for start, stop in groups:
                left = np.arange(start, stop)[own[start:stop] == i[start]]
                right = np.arange(start, stop)[own[start:stop] == j[start]]
                a, b = [], []
                for k in range(0, len(left), 64):
                    block = left[k : k + 64]
                    near = np.stack([(values[right] == values[x]).mean(axis=1) >= least for x in block])
                    x, y = np.nonzero(near & (rep[block][:, None] < rep[right][None, :])) if i[start] == j[start] else np.nonzero(near)
                    a.append(block[x])
                    b.append(right[y])
                a, b = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (a, b))
                kept = forest(stop - start, a - start, b - start)
                found["a"].append(rep[a[kept]])
                found["b"].append(rep[b[kept]])
            yield _long_batch(found)

    rows = buckets.join(reps.select("rep", "values"), "rep").select("bucket", "i", "j", "own", "rep", "values")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(connect, "a long, b long").distinct()


def in_chunks(rows: DataFrame, key: F.Column, *more: str) -> DataFrame:
    """``rows`` (with ``rep`` and ``chunks``, how many their group has) once for every pair of chunks ``i <= j`` of their group."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", *more)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each node's component, by alternating star contraction."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    count = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state = count(edges)
    while True:
        # Large star: every neighbour that is larger than a node is linked to the node's smallest neighbour.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).withColumn("low", F.least("a", "low"))
        low = written(low, "low")
        large = written(skew_join(both.where("b > a"), low, "a", 2 * state[0]).select(F.col("low").alias("a"), "b").where("a <> b").distinct(), "large")
        # Small star: the smaller neighbours of a node, and the node, are linked to the smallest of them.
        low = written(large.groupBy("b").agg(F.min("a").alias("low"), F.count("*").alias("n")), "low")
        small = skew_join(large, low, "b", 2 * state[0]).select(F.col("low").alias("x"), F.col("a").alias("y")).unionByName(low.select(F.col("low").alias("x"), F.col("b").alias("y")))
        edges = written(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        before, state = state, count(edges)
        if state == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def member_sets(members: DataFrame, width: int) -> DataFrame:
    """``grp, rep, times, size, shingles`` of ``grp, rep, times, text``: the sets themselves, as sorted 64-bit hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _words.slices(batch, "text", SLICE):
                bounds, values = shingle_sets(rows["text"], width)
                rep = rows["rep"].to_numpy()
                # A text_key may stand for other texts by accident; repeated rows stand side by side after the join.
                real = set_hashes(bounds, values) == rep
                real[1:] &= rep[1:] != rep[:-1]
                raw = [values[bounds[k] : bounds[k + 1]].tobytes() for k in np.flatnonzero(real)]
                kept = rows.filter(pa.array(real)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(_one(kept[c]) for c in ("grp", "rep", "times")), pa.array(np.diff(bounds)[real].astype(np.int64)), pa.array(raw, pa.binary())], names=["grp", "rep", "times", "size", "shingles"])

    return members.select("grp", "rep", "times", "text").mapInArrow(hashed, "grp long, rep long, times long, size long, shingles binary")


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def exact_links(members: DataFrame, threshold: float, width: int) -> DataFrame:
    """``a, b, n``: connecting links (``n`` 0) and each representative's number of linked documents (``b`` is ``a``).

    ``members`` has ``grp, rep``, ``times`` (documents with the set) and ``text``.
    """
    sets = written(member_sets(members, width), "members")
    groups = sets.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("shingles_in"))
    # Chunks grow with the square root of the group: so do the copies of a set, and the tasks of a group.
    chunks = F.ceil(F.greatest(F.col("n") / F.greatest(F.lit(float(CHUNK)), 4 * F.sqrt("n")), F.col("shingles_in") / CHUNK_SHINGLES)).cast("int")
    groups = written(groups.select("grp", "n", chunks.alias("chunks")), "group-sizes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in runs(batches, ("grp", "i", "j")):
            all_own, i, j = (table[n].to_numpy() for n in ("own", "i", "j"))
            found: dict[str, list[np.ndarray]] = {"a": [], "b": [], "n": []}
            for start, stop in groups:
                rows = table.slice(start, stop - start)
                rep, times, own = rows["rep"].to_numpy(), rows["times"].to_numpy(), all_own[start:stop]
                raw = rows["shingles"].to_pylist()
                sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
                bounds, values = np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(raw), np.uint64)
                once = np.zeros(len(rep), bool)  # repeated rows count once
                once[np.unique(rep, return_index=True)[1]] = True
                left, right = np.flatnonzero(once & (own == i[start])), np.flatnonzero(once & (own == j[start]))
                shared = _shared(bounds, values, left, right)
                union = sizes[left][:, None] + sizes[right][None, :] - shared
                linked = shared >= threshold * union - 1e-9
                counts = np.zeros(len(rep), np.int64)
                if i[start] == j[start]:
                    np.fill_diagonal(linked, False)
                else:
                    np.add.at(counts, right, linked.T @ times[left])
                np.add.at(counts, left, linked @ times[right])
                a, b = np.nonzero(linked)
                kept = forest(len(rep), left[a], right[b])
                every = np.union1d(left, right)
                found["a"] += [rep[left[a[kept]]], rep[every]]
                found["b"] += [rep[right[b[kept]]], rep[every]]
                found["n"] += [np.zeros(len(kept), np.int64), counts[every]]
            yield _long_batch(found)

    rows = in_chunks(skew_join(sets, groups, "grp", sets.count()), F.col("grp"), "times", "shingles")
    return rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(compare, "a long, b long, n long")


def _shared(bounds: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray, tile: int = 4096) -> np.ndarray:
    """How many values the sets ``left`` and ``right`` have in common, pair by pair."""
    used = np.union1d(left, right)
    of = np.repeat(np.arange(len(used)), np.diff(bounds)[used])
    flat = np.concatenate([values[bounds[k] : bounds[k + 1]] for k in used]) if len(used) else values[:0]
    _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times[token] > 1
    of, token = of[common], np.unique(token[common], return_inverse=True)[1]
    place = np.full(len(bounds), -1)
    place[used] = np.arange(len(used))
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(token, kind="stable")
    of, token = of[order], token[order]
    last = int(token[-1]) + 1 if len(token) else 0
    for start in range(0, last, tile):
        a, b = np.searchsorted(token, [start, start + tile])
        grid = np.zeros((len(used), min(tile, last - start)), np.float32)
        grid[of[a:b], token[a:b] - start] = 1
        out += grid[place[left]] @ grid[place[right]].T
    return np.rint(out).astype(np.int64)


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """``doc_id, text_key, root, class_id, n_links`` for each row of ``docs`` (``doc_id``, ``text``).

    ``root`` is the class itself, the hash of one of its sets, whatever ids its rows have; null for texts
    without words.  ``text_key`` tells which text of an id the row is about.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(document_sets(docs, width), "sets")
    full = sets.where("n_shingles > 0").withColumn("id", order_id())
    reps = full.groupBy(F.col("node").alias("rep")).agg(F.min(F.struct("id", "text_key")).alias("least"), F.count("*").alias("times"), F.first("values").alias("values"))
    reps = written(reps.select("rep", "least.id", "least.text_key", "times", "values"), "reps")

    groups = written(components(candidate_edges(reps, threshold, recall)), "groups")
    members = groups.join(reps.select(F.col("rep").alias("node"), "id", "text_key", "times"), "node")
    members = members.select(F.col("root").alias("grp"), F.col("node").alias("rep"), "times", "id", "text_key")
    texts = docs.select(order_id().alias("id"), text_key().alias("text_key"), "text")
    links = written(exact_links(members.join(texts, ["id", "text_key"]), threshold, width), "links")

    classes = components(links.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    counts = links.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    of_rep = reps.drop("values", "text_key").join(counts, "rep", "left").join(classes, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    of_rep = written(of_rep.select("rep", "root", "id", (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).alias("n_links")), "classes")
    firsts = of_rep.groupBy("root").agg(F.min("id").alias("first"))
    of_rep = of_rep.join(firsts, "root").select(F.col("rep").alias("node"), "root", "first", "n_links")
    found = sets.select("doc_id", "text_key", "n_shingles", "node").join(of_rep, "node", "left")
    class_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.nullif("first", F.lit(NO_ID)))
    n_links = F.when(F.col("n_shingles") == 0, 0).otherwise(F.col("n_links")).cast("long")
    return found.select("doc_id", "text_key", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"), class_id.alias("class_id"), n_links.alias("n_links"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """``doc_id, class_id, n_links`` for each row of ``docs`` (``doc_id``, ``text``).

    ``class_id`` is the smallest ``doc_id`` of the class; ``n_links`` the number of other documents whose
    similarity to this one is ``threshold`` or more.
    """
    return similarity_classes(docs, threshold, recall, width).select("doc_id", "class_id", "n_links")
