"""Centroid clustering of integer vectors with ns-bounds.

Lloyd's rounds, exact in integers: every vector goes to the nearest centroid, then a centroid becomes the floor of its
vectors' mean.  What a round needs not compute again it knows from bounds.  A vector keeps its last evaluated distance to
each centroid and the round of that evaluation.  All centroids of earlier rounds are kept, so such a distance is loosened
by the norm of the centroid's total displacement since its own evaluation (ns: norm of the sum), which is never more than
the sum of its drifts from round to round (sn) and much less where a centroid moves to and fro.  A vector whose loosened
distance to its own centroid is below all others stays.  For the others the own distance is evaluated exactly, then those
to the centroids that its bounds still allow, and these alone; equal distances go to the smaller number.

The state of a round (vector, cluster, distances as floats rounded down, rounds of evaluation) is written to the shared
folder, so that a lost executor costs the round alone.  Sums leave a task as a row for each cluster.  What the driver and
the tasks hold is the history: at most ``HISTORY_BYTES``; distances that were evaluated before its oldest round are put at
the present round with what their loosening leaves.

Defined results: rows with a null vector, another number of components, a null or a non-finite one are left out; null ids
and repeated rows are vectors like others; a centroid without vectors stays; fewer vectors than centroids give as many
centroids as vectors; an empty table gives no rows.  Components of 2^27 or more are an error, as squared distances would
not fit 64 bits.  Of other columns none is kept, so no name can clash; vectors have the same number of components, which
is known, so there are no long ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm._tables import written

#: What centroids of earlier rounds may take in a task.
HISTORY_BYTES = 64 << 20
#: Components of this size are refused.
LARGEST = 1 << 27
#: Vectors that a task works on at a time.
ROWS = 8192
#: Bounds are compared with this much to spare, far above what doubles lose.
SLACK = 1e-9


def whole_vectors(rows: DataFrame, vector: str, dims: int, scale: float) -> DataFrame:
    """The rows with ``dims`` finite components, which become the floor of ``scale`` times the component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) == dims)).where(finite)
    return kept.withColumn(vector, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def first_by_hash(rows: DataFrame, key: Column, vector: str, k: int) -> np.ndarray:
    """The vectors of the ``k`` rows with the smallest hash of ``key``; of equal ones the smaller vector is first."""
    found = rows.select(F.sha2(key.cast("binary"), 256).alias("__hash"), F.col(vector).alias("v")).orderBy(F.col("__hash").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def squared(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows; ``centres`` may be one row for all."""
    gap = q - centres
    return np.einsum("ij,ij->i", gap, gap)


def below(d2: np.ndarray) -> np.ndarray:
    """The distance as a float that isn't above it."""
    d = np.sqrt(d2.astype(np.float64))
    out = d.astype(np.float32)
    return np.where(out > d, np.nextafter(out, np.float32(-np.inf)), out).astype(np.float32)


@dataclass
class State:
    """Of each vector: its cluster, the evaluated distances (rounded down) and the rounds of their evaluation."""

    cluster: np.ndarray
    lower: np.ndarray
    at: np.ndarray
    evaluated: np.ndarray  # distances computed in the last pass


def evaluate_all(q: np.ndarray, centres: np.ndarray, now: int) -> State:
    d2 = np.stack([squared(q, c) for c in centres], axis=1)
    return State(d2.argmin(axis=1).astype(np.int32), below(d2), np.full(d2.shape, now, np.int32), np.full(len(q), len(centres), np.int32))


def reassign(q: np.ndarray, state: State, history: np.ndarray, first: int, expires: int) -> State:
    """The next assignment; ``history`` has the centroids of the rounds from ``first`` on, the last of them the present ones.

    Distances of rounds up to ``expires`` can't be loosened any more in the next pass and are put at this round.
    """
    now, centres = first + len(history) - 1, history[-1]
    k, every = len(centres), np.arange(len(q))
    moved = np.sqrt(((centres[None] - history).astype(np.float64) ** 2).sum(axis=2))  # (rounds, k)
    lower, at, own = state.lower.copy(), state.at.copy(), state.cluster.copy()
    loosened = lower.astype(np.float64) - moved[at - first, np.arange(k)]
    mine = np.nextafter(lower[every, own], np.float32(np.inf)).astype(np.float64) + moved[at[every, own] - first, own]
    spare = SLACK * (1.0 + mine + moved.max())
    rivals = loosened.copy()
    rivals[every, own] = np.inf
    failed = np.flatnonzero((rivals.min(axis=1) <= mine + spare) | (at[every, own] <= expires))
    evaluated = np.zeros(len(q), np.int32)
    if len(failed):
        best = squared(q[failed], centres[own[failed]])
        lower[failed, own[failed]], at[failed, own[failed]] = below(best), now
        loosened[failed, own[failed]] = lower[failed, own[failed]]
        evaluated[failed] = 1
        row, j = np.nonzero(rivals[failed] <= (np.sqrt(best.astype(np.float64)) + spare[failed])[:, None])
        d2 = squared(q[failed[row]], centres[j])
        lower[failed[row], j], at[failed[row], j] = below(d2), now
        np.add.at(evaluated, failed[row], 1)
        # The least of each row's pairs, of equal ones the smaller number; then it meets the own centroid.
        order = np.lexsort((j, d2, row))
        row, j, d2 = row[order], j[order], d2[order]
        head = np.flatnonzero(np.diff(row, prepend=-1))
        row, j, d2 = row[head], j[head], d2[head]
        closer = (d2 < best[row]) | ((d2 == best[row]) & (j < own[failed[row]]))
        own[failed[row[closer]]] = j[closer]
    old = at <= expires
    if old.any():
        rest = np.maximum(loosened - spare[:, None], 0.0)
        lower[old] = below(np.maximum(rest[old], 0.0) ** 2)
        at[old] = now
    return State(own, lower, at, evaluated)


@dataclass
class Clustering:
    """``assigned`` has ``id, cluster, distance, evaluated`` (squared distance; distances computed in the last pass)."""

    assigned: DataFrame
    centroids: np.ndarray
    evaluated: list[int]  # distances computed in each pass

    def hashes(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.centroids]


def cluster(rows: DataFrame, start: np.ndarray, rounds: int, vector: str = "q", id_: str = "id", history_bytes: int = HISTORY_BYTES) -> Clustering:
    """``rounds`` rounds of assignment and update from the centroids ``start``, then one more assignment.

    ``rows`` has ``id_`` and ``vector``, arrays of longs as ``whole_vectors`` makes them.
    """
    spark, (k, dims) = rows.sparkSession, start.shape
    keep = max(2, history_bytes // (8 * k * dims))
    kind = rows.schema[id_].dataType
    known = T.StructType([T.StructField("id", kind), T.StructField("q", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType()), T.StructField("lower", T.ArrayType(T.FloatType())), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("evaluated", T.IntegerType())])
    last = T.StructType([*known.fields[:1], known["cluster"], T.StructField("distance", T.LongType()), known["evaluated"]])
    state = rows.select(F.col(id_).alias("id"), F.col(vector).alias("q"))
    history, evaluated = [np.asarray(start, np.int64)], []
    for now in range(rounds + 1):
        first = max(0, now - keep + 1)
        shared = spark.sparkContext.broadcast((np.stack(history[first:]), first))
        expires = now - keep + 1

        def step(batches: Iterator[pa.RecordBatch], shared=shared, now=now, expires=expires) -> Iterator[pa.RecordBatch]:
            past, first = shared.value
            for whole in batches:
                for a in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(a, ROWS)
                    q = batch["q"].flatten().to_numpy().astype(np.int64).reshape(-1, dims)
                    if np.abs(q).max(initial=0) >= LARGEST:
                        raise ValueError(f"a component is {LARGEST} or more")
                    if now == 0:
                        found = evaluate_all(q, past[-1], 0)
                    else:
                        before = State(batch["cluster"].to_numpy().copy(), _matrix(batch["lower"], k, np.float32), _matrix(batch["at"], k, np.int32), np.empty(0))
                        found = reassign(q, before, past, first, expires)
                    own = [batch["id"], pa.array(found.cluster)]
                    if now == rounds:
                        yield pa.RecordBatch.from_arrays([*own, pa.array(squared(q, past[-1][found.cluster])), pa.array(found.evaluated)], names=last.names)
                    else:
                        yield pa.RecordBatch.from_arrays([own[0], _lists(q.astype(np.int32)), own[1], _lists(found.lower), _lists(found.at), pa.array(found.evaluated)], names=known.names)

        state = written(state.mapInArrow(step, last if now == rounds else known), f"clusters-{now}")
        if now < rounds:
            new, computed = _means(state, history[-1])
            history.append(new)
        else:
            computed = int(state.agg(F.coalesce(F.sum("evaluated"), F.lit(0))).first()[0])
        evaluated.append(computed)
        shared.unpersist()
    return Clustering(state, history[-1], evaluated)


def _means(state: DataFrame, before: np.ndarray) -> tuple[np.ndarray, int]:
    """The floors of the clusters' means, and how many distances the pass has computed."""
    k, dims = before.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, computed = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for batch in batches:
            own, q = batch["cluster"].to_numpy(), _matrix(batch["q"], dims, np.int64)
            n += np.bincount(own, minlength=k)
            computed += int(batch["evaluated"].to_numpy().sum())
            for j in np.unique(own):
                total[j] += q[own == j].sum(axis=0)
        evaluated = np.zeros(k, np.int64)
        evaluated[0] = computed
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(evaluated), _lists(total)], names=["cluster", "n", "evaluated", "total"])

    parts = state.select("cluster", "q", "evaluated").mapInArrow(sums, "cluster int, n long, evaluated long, total array<long>")
    places = [F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(dims)]
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("evaluated").alias("evaluated"), *places).collect()  # a row for each centroid
    out = before.copy()
    for r in found:
        if r.n:
            out[r.cluster] = [r[f"t{i}"] // r.n for i in range(dims)]
    return out, sum(r.evaluated for r in found)


def with_inertia(found: Clustering) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = found.assigned.sparkSession
    sums = {r.cluster: r.s for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    rows = [(j, int(s), int(sum(sums.values())), found.hashes()[j]) for j, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind).reshape(-1, width)


def _lists(rows: np.ndarray | Sequence) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
