"""Means, covariances and principal components of feature vectors, also for many groups at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell import _kernels
from tracewell.operators.cluster import _keys


def feature_means(chips: DataFrame, by: Sequence[str] = (), ev: str = "ev") -> DataFrame:
    """``by, k, mean_v`` for each place ``k`` (from 0) of the vectors."""
    return chips.select(*by, F.posexplode(F.col(ev)).alias("k", "v")).groupBy(*by, "k").agg(F.avg(F.col("v").cast("double")).alias("mean_v"))


def covariance_pairs(vectors: DataFrame, by: Sequence[str] = (), ev: str = "ev", ridge: float = 0.0) -> DataFrame:
    """``by, i, j, cov`` by the sample covariance of every pair of places; for few dimensions only.

    Null for a group of one vector; ``ridge`` is added where ``i`` equals ``j``.
    """
    first = vectors.select(*by, F.col(ev).alias("__v"), F.posexplode(F.col(ev)).alias("i", "x"))
    pairs = first.select(*by, "i", "x", F.posexplode("__v").alias("j", "y"))
    cov = F.when(F.count("*") > 1, F.covar_samp(F.col("x").cast("double"), F.col("y").cast("double"))) + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)
    return pairs.groupBy(*by, "i", "j").agg(cov.alias("cov"))


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray  # divided by n - 1


Block = tuple[int, np.ndarray, np.ndarray]
PARTIAL = "grp string, n long, mean array<double>, block array<double>"


def _gathered(rows: DataFrame, of: Callable[[np.ndarray], Block], merged: Callable[[Block, Block], Block], salts: int, means: int = 1) -> DataFrame:
    """A block for each group: of the vectors that a task meets, then of the tasks in salted groups, then of these.

    ``means`` is how many rows the mean is made of.
    """

    def batch_of(found: dict[str, Block]) -> pa.RecordBatch:
        lists = lambda place: pa.array([found[g][place].ravel() for g in found], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([b[0] for b in found.values()], pa.int64()), lists(1), lists(2)], names=["grp", "n", "mean", "block"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Block] = {}
        for batch in batches:
            for grp, x in _kernels.grouped_vectors(batch, "grp", "ev"):
                own = of(x)
                found[grp] = merged(found[grp], own) if grp in found else own
        yield batch_of(found)

    def together(table: pa.Table) -> pa.Table:
        total: Block | None = None
        for n, mean, block in zip(table["n"].to_pylist(), table["mean"], table["block"], strict=True):
            mean, block = (x.values.to_numpy() for x in (mean, block))
            own = (n, mean.reshape(means, -1), block.reshape(-1, len(mean) // means))
            total = own if total is None else merged(total, own)
        return pa.Table.from_batches([batch_of({table["grp"][0].as_py(): total})])

    blocks = rows.mapInArrow(partial, PARTIAL).withColumn("salt", F.spark_partition_id() % salts)
    return blocks.groupBy("grp", "salt").applyInArrow(together, PARTIAL).groupBy("grp").applyInArrow(together, PARTIAL)


def _grouped(vectors: DataFrame, by: Sequence[str], ev: str) -> DataFrame:
    return vectors.where(F.col(ev).isNotNull()).select(_keys(vectors, by).alias("grp"), F.col(ev).cast("array<double>").alias("ev"))


def _co_moments(x: np.ndarray) -> Block:
    """The mean is the first vector and the mean gap to it, which keeps the digits that a large offset would take."""
    gaps = x - x[0]
    mean = gaps.mean(axis=0)
    return len(x), np.stack([x[0], mean]), (gaps - mean).T @ (gaps - mean)


def _merged_moments(a: Block, b: Block) -> Block:
    """Counts, means and co-moments of two parts, of which each is centred at its own mean."""
    n, gap = a[0] + b[0], (b[1][0] - a[1][0]) + (b[1][1] - a[1][1])
    return n, np.stack([a[1][0], a[1][1] + gap * (b[0] / n)]), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def moments(vectors: DataFrame, by: Sequence[str] = (), ev: str = "ev", salts: int = 32) -> dict[str, Moments]:
    """Count, mean and sample covariance of each group, in one pass.

    Each task sends one block for each group: co-moments around the mean of what it has met, so that nothing cancels,
    however far the vectors lie from 0.  Blocks are merged in pairs, in salted groups first.  What the driver gets grows
    with the groups and dimensions, not with the vectors.
    """
    out = {}
    for r in _gathered(_grouped(vectors, by, ev), _co_moments, _merged_moments, salts, means=2).toLocalIterator():
        d = len(r.mean) // 2
        out[r.grp] = Moments(r.n, np.array(r.mean[:d]) + np.array(r.mean[d:]), np.array(r.block).reshape(d, d) / max(r.n - 1, 1))
    return out


@dataclass
class Triangle:
    """Count, mean and the R factor of the centred vectors: R'R is their scatter, without ever being squared."""

    n: int
    mean: np.ndarray
    r: np.ndarray


def _triangle(x: np.ndarray) -> Block:
    """Of the vectors with a one before each: the first row of R is the scaled mean, and what is below belongs to the centred ones."""
    r = np.linalg.qr(np.column_stack([np.ones(len(x)), x]), mode="r")
    return len(x), r[:1], r


def _merged_triangles(a: Block, b: Block) -> Block:
    r = np.linalg.qr(np.concatenate([a[2], b[2]]), mode="r")
    return a[0] + b[0], r[:1], r


def triangles(vectors: DataFrame, by: Sequence[str] = (), ev: str = "ev", salts: int = 32) -> dict[str, Triangle]:
    """Tall-skinny QR of each group, in one pass: R factors of batches, of tasks and of salted groups in a tree.

    Small singular values keep their digits, which are lost in a covariance below about 1e-8 of the largest one.
    """
    out = {}
    for row in _gathered(_grouped(vectors, by, ev), _triangle, _merged_triangles, salts).toLocalIterator():
        d = len(row.mean) - 1
        r = np.array(row.block).reshape(-1, d + 1)
        r = np.concatenate([r, np.zeros((max(0, d + 1 - len(r)), d + 1))])
        out[row.grp] = Triangle(row.n, r[0, 1:] / r[0, 0], r[1:, 1:])
    return out


@dataclass
class PcaModel:
    mean: np.ndarray
    coeff: np.ndarray  # (D, k)
    explained: np.ndarray  # shares of the variance, all D of them, largest first


def _components(mean: np.ndarray, n: int, values: np.ndarray, vectors: np.ndarray, k: int) -> PcaModel:
    """``values`` are variances, largest first, ``vectors`` columns; of each column the first largest coefficient is positive."""
    values = np.maximum(values, 0.0)
    k = min(k, n - 1, len(values)) if n > 1 else 1
    coeff = vectors[:, :k]
    top = np.abs(coeff).argmax(axis=0)
    coeff = coeff * np.where(coeff[top, np.arange(k)] < 0, -1.0, 1.0)
    total = values.sum()
    return PcaModel(mean, coeff, values / total if total > 0 else values)


def pca_of(m: Moments, k: int = 10) -> PcaModel:
    """The first components of a covariance."""
    values, vectors = np.linalg.eigh(m.cov)
    return _components(m.mean, m.n, values[::-1], vectors[:, ::-1], k)


def pca_of_triangle(t: Triangle, k: int = 10) -> PcaModel:
    """The first components by singular values of the centred vectors, which those of R are."""
    _, singular, vectors = np.linalg.svd(t.r)
    return _components(t.mean, t.n, singular**2 / max(t.n - 1, 1), vectors.T, k)


def pca_fit(chips: DataFrame, k: int = 10, by: Sequence[str] = (), ev: str = "ev", form: str = "covariance") -> dict[str, PcaModel]:
    """Components of each group, from its ``covariance`` or by singular values (``svd``) of a tall-skinny QR.

    Tasks solve them, a group each: their linear algebra has one thread, while a threaded solve of a hundred
    features or more may never end in the process of a Spark driver.
    """
    if form not in ("covariance", "svd"):
        raise ValueError(f"unknown form {form!r}")
    spark = chips.sparkSession
    found = moments(chips, by, ev) if form == "covariance" else triangles(chips, by, ev)
    if not found:
        return {}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                matrix = np.array(r.matrix).reshape(len(r.mean), -1)
                p = pca_of(Moments(r.n, np.array(r.mean), matrix), k) if form == "covariance" else pca_of_triangle(Triangle(r.n, np.array(r.mean), matrix), k)
                yield pd.DataFrame({"grp": [r.grp], "coeff": [p.coeff.ravel()], "explained": [p.explained]})

    rows = spark.createDataFrame([(grp, m.n, m.mean.tolist(), (m.cov if form == "covariance" else m.r).ravel().tolist()) for grp, m in found.items()], "grp string, n long, mean array<double>, matrix array<double>")
    solved = rows.repartition(min(len(found), spark.sparkContext.defaultParallelism)).mapInPandas(solve, "grp string, coeff array<double>, explained array<double>").collect()  # a row for each group
    return {r.grp: PcaModel(found[r.grp].mean, np.array(r.coeff).reshape(len(found[r.grp].mean), -1), np.array(r.explained)) for r in solved}


def projected(grp: pd.Series, values: np.ndarray, models: dict[str, PcaModel]) -> np.ndarray:
    """A batch's vectors in the components of their groups; none for a null vector or a group without a model."""
    out = np.full(len(values), None, object)
    for g, full in _kernels.full_places(grp, values):
        model = models.get(g)
        if model is not None:
            _kernels.placed((np.stack(values[full]) - model.mean) @ model.coeff, full, out)
    return out


def pca_project(chips: DataFrame, models: dict[str, PcaModel], by: Sequence[str] = (), ev: str = "ev", name: str = "pc") -> DataFrame:
    """``chips`` with ``name``, the centred vectors in the components of their group."""
    shared = chips.sparkSession.sparkContext.broadcast(models)

    def project(grp: pd.Series, vectors: pd.Series) -> pd.Series:
        return pd.Series(projected(grp, vectors.to_numpy(), shared.value))

    return chips.withColumn(name, F.pandas_udf(project, "array<double>")(_keys(chips, by), F.col(ev)))


def explained_variance(values: DataFrame, by: Sequence[str] = (), value: str = "variance") -> DataFrame:
    """``values`` with their ``rank`` by size and the cumulative share in percent."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), *[c for c in values.columns if c not in (*by, value)])
    total = F.sum(value).over(Window.partitionBy(*by))
    upto = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("rank", F.row_number().over(w)).withColumn("cum_pct", F.try_divide(100 * upto, total))
