"""Fuzzy c-means on feature vectors, grouped fits, and the labelling of clusters by energy."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import _kernels

ALL = "all"


def start_memberships(chip: Column, c: int, seed: int = 42) -> Column:
    """First memberships from a hash of the chip: the same on any partitioning and in any engine."""
    word = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws("|", chip.cast("string"), *map(F.lit, parts)).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    if c == 2:
        u = word(str(seed))
        return F.array(u, 1 - u)
    parts = [-F.log(1 - word(str(seed), str(j))) for j in range(c)]
    total = sum(parts[1:], parts[0])
    return F.array(*(p / total for p in parts))


@dataclass
class FcmModel:
    """Centres by group, ``(c, D)`` each, the round that a group stopped in, and the objective of every round."""

    m: float
    centers: dict[str, np.ndarray]
    rounds: dict[str, int] = field(default_factory=dict)
    history: list[tuple[str, int, float, float]] = field(default_factory=list)
    collapsed: dict[str, bool] = field(default_factory=dict)


def _keys(df: DataFrame, by: Sequence[str]) -> Column:
    """A group's name: its values with bars between, of which none is in a value; a null isn't the text of any value."""
    if not by:
        return F.lit(ALL)
    safe = lambda c: F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
    return F.concat_ws("|", *(F.coalesce(safe(F.col(b)), F.lit("\\N")) for b in by))


def key_of(*values: object) -> str:
    """The name that ``_keys`` gives the group of these values (texts and whole numbers)."""
    return "|".join("\\N" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\p") for v in values)


def fcm_fit(chips: DataFrame, c: int = 2, m: float = 2.0, tol: float = 1e-6, max_iter: int = 1000, stop: str = "membership", by: Sequence[str] = (), chip: str = "chip", ev: str = "ev", seed: int = 42) -> FcmModel:
    """Fits all groups of ``by`` at once; a group that has stopped leaves the later rounds.

    Each round is one pass: tasks get the centres of this and the last round and return weighted sums, a row
    for each group, cluster and dimension.  No memberships are kept: those of the last round follow from its
    centres.  ``stop`` is ``membership`` (largest change of a membership) or ``objective`` (change of the sum
    of weighted squared distances, before memberships move).  Rows with a null vector are left out; a group
    whose centres coincide is marked as collapsed and stops.  ``chips`` should be persisted by the caller.
    """
    if c < 2 or m <= 1 or stop not in ("membership", "objective"):
        raise ValueError("c must be 2 or more, m above 1, stop membership or objective")
    rows = chips.where(F.col(ev).isNotNull()).select(_keys(chips, by).alias("grp"), start_memberships(F.col(chip), c, seed).alias("u0"), F.col(ev).cast("array<double>").alias("ev"))
    spark = chips.sparkSession
    model = FcmModel(m, {})
    before: dict[str, np.ndarray] = {}
    objective: dict[str, float] = {}
    active: set[str] | None = None
    for n in range(max_iter + 1):
        shared = spark.sparkContext.broadcast((model.centers, before, active))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared, first=n == 0) -> Iterator[pa.RecordBatch]:
            now, last, wanted = shared.value
            total: dict[str, np.ndarray] = {}
            worst: dict[str, float] = {}
            for batch in batches:
                for grp, x, u0 in _kernels.grouped_vectors(batch, "grp", "ev", "u0"):
                    if wanted is not None and grp not in wanted:
                        continue
                    if first:
                        u, j, moved = u0, 0.0, math.inf
                    else:
                        u, squared = _kernels.memberships(x, now[grp], m)
                        old = _kernels.memberships(x, last[grp], m)[0] if grp in last else u0
                        moved = float(np.abs(u - old).max())
                        j = float((old**m * squared).sum()) if stop == "objective" else float((u**m * squared).sum())
                    w = u**m
                    block = np.concatenate([w.T @ x, w.sum(axis=0)[:, None], np.full((c, 1), j / c)], axis=1)
                    total[grp] = total.get(grp, 0.0) + block
                    worst[grp] = max(worst.get(grp, 0.0), moved)
            for grp, block in total.items():
                size = block.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * size, pa.string()), pa.array(np.repeat(np.arange(c, dtype=np.int32), block.shape[1])), pa.array(np.tile(np.arange(block.shape[1], dtype=np.int32), c)), pa.array(block.ravel()), pa.array(np.full(size, worst[grp]))],
                    names=["grp", "cluster", "pos", "value", "moved"],
                )

        parts = rows.mapInArrow(sums, "grp string, cluster int, pos int, value double, moved double")
        # Groups x clusters x (dimensions + 2) rows, whatever the number of chips.
        found = parts.groupBy("grp", "cluster", "pos").agg(F.sum("value").alias("value"), F.max("moved").alias("moved")).toPandas().sort_values(["grp", "cluster", "pos"])
        before, centers = dict(model.centers), {}
        for grp, part in found.groupby("grp"):
            block = part["value"].to_numpy().reshape(c, -1)
            new, j, moved = block[:, :-2] / (block[:, -2:-1] + 1e-12), float(block[:, -1].sum()), float(part["moved"].max())
            done = False
            if n:
                model.history.append((grp, n, j, moved))
                done = moved < tol if stop == "membership" else abs(j - objective.get(grp, math.inf)) < tol
                objective[grp] = j
            if not done and n < max_iter:
                spread = float(np.abs(new - new[:1]).max())
                model.collapsed[grp] = spread < 1e-9
                centers[grp] = new
            if done or n == max_iter or model.collapsed.get(grp):
                model.rounds[grp] = n
        model.centers = {**before, **centers}
        active = {g for g in found["grp"].unique() if g not in model.rounds}
        shared.unpersist()
        if not active:
            break
    return model


def memberships_of(grp: pd.Series, values: np.ndarray, centers: dict[str, np.ndarray], m: float) -> np.ndarray:
    """Memberships of a batch's vectors; none for a null vector or a group without centres."""
    out = np.full(len(values), None, object)
    for name, full in _kernels.full_places(grp, values):
        if name in centers:
            _kernels.placed(_kernels.memberships(np.stack(values[full]), centers[name], m)[0], full, out)
    return out


def with_memberships(chips: DataFrame, model: FcmModel, by: Sequence[str] = (), ev: str = "ev") -> DataFrame:
    """``chips`` with ``grp`` and ``u``, the memberships by the model's centres."""
    shared = chips.sparkSession.sparkContext.broadcast((model.centers, model.m))

    def assign(grp: pd.Series, vectors: pd.Series) -> pd.Series:
        return pd.Series(memberships_of(grp, vectors.to_numpy(), *shared.value))

    return chips.withColumn("grp", _keys(chips, by)).withColumn("u", F.pandas_udf(assign, "array<double>")("grp", F.col(ev)))


def hard_assign(u: Column) -> Column:
    """The cluster of the largest membership; of equal ones the first."""
    return (F.array_position(u, F.array_max(u)) - 1).cast("int")


def center_distance(chips: DataFrame, centers: DataFrame, ev: str = "ev") -> DataFrame:
    """Each chip with each centre and their distance; the centres (a row for each cluster) are broadcast."""
    gap = F.aggregate(F.zip_with(F.col(ev), F.col("center"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return chips.crossJoin(F.broadcast(centers)).withColumn("distance", F.sqrt(gap))


def semi_by_cluster(chips: DataFrame, assigned: DataFrame, cluster: int, chip: str = "chip") -> DataFrame:
    """The chips assigned to a cluster."""
    return chips.join(assigned.where(F.col("cluster") == cluster).select(chip), chip, "left_semi")


def energy_label(assigned: DataFrame, rule: str = "weighted_raw", by: Sequence[str] = ("grp",), m: float = 2.0) -> DataFrame:
    """``by, cluster, energy, modified``: the cluster of more energy is the modified one; of equal ones the first.

    Rules: ``weighted_raw`` (raw energies weighted by memberships to the power m), ``hard_total`` (squared
    features summed over hard members: a larger cluster weighs more) or ``center`` (squared centre from the
    weighted mean; on unit vectors it tells how tight a cluster is).  ``assigned`` has ``u``, ``ev`` and
    ``raw_energy``.
    """
    square = F.aggregate("ev", F.lit(0.0), lambda s, x: s + x * x)
    if rule == "center":
        long_ = assigned.select(*by, F.posexplode("u").alias("cluster", "w"), "ev").select(*by, "cluster", F.pow("w", F.lit(m)).alias("w"), F.posexplode("ev").alias("k", "x"))
        parts = long_.groupBy(*by, "cluster", "k").agg((F.sum(F.col("w") * F.col("x")) / (F.sum("w") + 1e-12)).alias("v"))
        energies = parts.groupBy(*by, "cluster").agg(F.sum(F.col("v") * F.col("v")).alias("energy"))
    elif rule == "hard_total":
        energies = assigned.withColumn("cluster", hard_assign(F.col("u"))).groupBy(*by, "cluster").agg(F.sum(square).alias("energy"))
    elif rule == "weighted_raw":
        long_ = assigned.select(*by, "raw_energy", F.posexplode("u").alias("cluster", "w")).withColumn("w", F.pow("w", F.lit(m)))
        energies = long_.groupBy(*by, "cluster").agg(F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("raw_energy")), F.sum("w")), F.lit(0.0)).alias("energy"))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    first = Window.partitionBy(*by).orderBy(F.desc("energy"), "cluster")
    return energies.withColumn("modified", F.row_number().over(first) == 1)


def cluster_accuracy(assigned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy in percent and the sizes of both kinds; ``assigned`` has ``predicted`` and ``label`` of 0 or 1."""
    right = F.avg(F.when(F.col("predicted") == F.col("label"), 100.0).otherwise(0.0)).alias("accuracy_pct")
    return assigned.groupBy(*by).agg(right, F.sum(F.when(F.col("predicted") == 0, 1).otherwise(0)).alias("n_golden"), F.sum("predicted").alias("n_modified"))


def convergence(history: DataFrame, by: Sequence[str] = ("grp",)) -> DataFrame:
    """``history`` (``round``, ``objective``) with ``delta``, the size of the change since the round before."""
    last = F.lag("objective").over(Window.partitionBy(*by).orderBy("round"))
    return history.withColumn("delta", F.abs(F.col("objective") - last))
