"""The detector: fused Euclidean and Mahalanobis distances to a golden and a modified centre."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import _kernels
from tracewell.operators.cluster import FcmModel, _keys, energy_label, fcm_fit, hard_assign, key_of, memberships_of
from tracewell.operators.subspace import PcaModel, moments, pca_fit, projected

RIDGE = 1e-6
SCORES = ("ed_g", "ed_t", "md_g", "md_t", "fd_g", "fd_t", "r_fd")


def entropy_weights(distances: DataFrame, by: Sequence[str] = (), ridge: float = 1e-6) -> DataFrame:
    """``by, a1, a2`` from the population variances of ``ed`` and ``md``, by the entropy of their shares."""
    v = distances.groupBy(*by).agg((F.var_pop("ed") + ridge).alias("v1"), (F.var_pop("md") + ridge).alias("v2"))
    h = lambda a, b: -(F.col(a) / (F.col(a) + F.col(b))) * F.log2(F.col(a) / (F.col(a) + F.col(b)))
    return v.select(*by, h("v1", "v2").alias("h1"), h("v2", "v1").alias("h2")).select(*by, (F.col("h1") / (F.col("h1") + F.col("h2"))).alias("a1"), (F.col("h2") / (F.col("h1") + F.col("h2"))).alias("a2"))


@dataclass
class Detector:
    """A group's frozen model: centres in feature and component space, inverse covariances, fusion weights."""

    golden: np.ndarray
    modified: np.ndarray
    pca: PcaModel
    golden_pc: np.ndarray
    modified_pc: np.ndarray
    inverse_g: np.ndarray
    inverse_t: np.ndarray
    a1: float = 0.5
    a2: float = 0.5
    rounds: int = 0
    energy_higher: bool = True

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        pc = (x - self.pca.mean) @ self.pca.coeff
        ed = [np.sqrt(((x - c) ** 2).sum(axis=1)) for c in (self.golden, self.modified)]
        return *ed, _kernels.mahalanobis(pc, self.golden_pc, self.inverse_g), _kernels.mahalanobis(pc, self.modified_pc, self.inverse_t)


def _placed(train: DataFrame, model: FcmModel, pca: dict[str, PcaModel], by: Sequence[str], ev: str) -> DataFrame:
    """``train`` with ``grp``, ``u`` and ``pc``: what ``with_memberships`` and ``pca_project`` add, by one function.

    Each Python function of a stage has a process for each task, with its own copy of the libraries.
    """
    shared = train.sparkSession.sparkContext.broadcast((model.centers, model.m, pca))

    def both(grp: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        centers, m, models = shared.value
        values = vectors.to_numpy()
        return pd.DataFrame({"u": memberships_of(grp, values, centers, m), "pc": projected(grp, values, models)})

    found = train.withColumn("grp", _keys(train, by)).withColumn("__place", F.pandas_udf(both, "u array<double>, pc array<double>")("grp", F.col(ev)))
    return found.withColumn("u", F.col("__place.u")).withColumn("pc", F.col("__place.pc")).drop("__place")


def fit_detector(train: DataFrame, by: Sequence[str] = (), components: int = 10, ridge: float = RIDGE, classes: str = "cluster", rule: str = "weighted_raw", centers: str = "fcm", tol: float = 1e-6, max_iter: int = 1000, ev: str = "ev") -> dict[str, Detector]:
    """A detector for each group of ``by``, from ``chip``, ``ev``, ``raw_energy`` and (for ``classes='label'``) ``label``.

    ``classes`` tells which chips a class's covariance and the weights come from: those of the ``cluster`` or
    of the true ``label``.  ``centers='scores'`` measures Mahalanobis distances from the classes' mean scores
    instead of the projected cluster centres.  A class without chips has the ridge alone as covariance.
    """
    train = train.persist()
    model: FcmModel = fcm_fit(train, by=by, tol=tol, max_iter=max_iter, ev=ev)
    pca = pca_fit(train, components, by, ev)
    scores = _placed(train, model, pca, by, ev).persist()
    labelled = energy_label(scores.withColumnRenamed(ev, "ev") if ev != "ev" else scores, rule, ("grp",), model.m)
    roles = {(r.grp, r.cluster): (r.modified, r.energy) for r in labelled.toLocalIterator()}  # groups x clusters rows
    modified = {g: c for (g, c), (is_modified, _) in roles.items() if is_modified}
    placed = scores
    if classes == "cluster":
        flags = F.create_map(*(F.lit(x) for pair in modified.items() for x in pair))
        scores = scores.withColumn("cls", (hard_assign(F.col("u")) == flags[F.col("grp")]).cast("int"))
    else:
        scores = scores.withColumn("cls", F.col("label").cast("int"))
    class_moments = moments(scores, ["grp", "cls"], "pc")
    out: dict[str, Detector] = {}
    for grp, v in model.centers.items():
        t = modified[grp]
        g = next(c for c in range(len(v)) if c != t)
        p, inverse, centre = pca[grp], [], []
        for cls, row in ((0, v[g]), (1, v[t])):
            m = class_moments.get(key_of(grp, cls))
            k = p.coeff.shape[1]
            inverse.append(np.linalg.pinv((m.cov if m is not None and m.n > 1 else np.zeros((k, k))) + ridge * np.eye(k)))
            centre.append(m.mean if centers == "scores" and m is not None else (row - p.mean) @ p.coeff)
        out[grp] = Detector(v[g], v[t], p, *centre, *inverse, rounds=model.rounds[grp], energy_higher=roles[grp, t][1] > roles[grp, g][1])
    shared = train.sparkSession.sparkContext.broadcast(out)

    def golden_distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for grp, part in pdf.groupby("grp", sort=False):
                d, x = shared.value[grp], np.stack(part["pc"].to_numpy())
                yield pd.DataFrame({"grp": grp, "ed": np.sqrt(((x - d.golden_pc) ** 2).sum(axis=1)), "md": _kernels.mahalanobis(x, d.golden_pc, d.inverse_g)})

    golden = scores.where("cls = 0 and pc is not null").select("grp", "pc").mapInPandas(golden_distances, "grp string, ed double, md double")
    for r in entropy_weights(golden, ["grp"]).toLocalIterator():
        out[r.grp].a1, out[r.grp].a2 = r.a1, r.a2
    placed.unpersist()
    train.unpersist()
    return out


def score(df: DataFrame, detectors: dict[str, Detector], by: Sequence[str] = (), weights: str | tuple[float, float] = "entropy", ev: str = "ev") -> DataFrame:
    """``df`` without its vector, with all distances, the ratio ``r_fd`` and ``predicted`` (1 where the ratio is 1 or more).

    Works on batch and streaming frames alike.  Rows with a null vector or of a group without a detector have
    null scores.  Columns of those names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(detectors)
    df = df.drop(*SCORES, "predicted").withColumn("__grp", _keys(df, by))
    kept = [f for f in df.schema.fields if f.name not in (ev, "__grp")]
    schema = T.StructType([*kept, *(T.StructField(n, T.DoubleType()) for n in SCORES), T.StructField("predicted", T.IntegerType())])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[f.name for f in kept]].copy()
            found = np.full((len(pdf), len(SCORES)), np.nan)
            vectors = pdf[ev].to_numpy()
            for grp, full in _kernels.full_places(pdf["__grp"], vectors):
                d = shared.value.get(grp)
                if d is None:
                    continue
                a1, a2 = (d.a1, d.a2) if weights == "entropy" else weights
                ed_g, ed_t, md_g, md_t = d.distances(np.stack(vectors[full]))
                fd_g, fd_t = a1 * ed_g + a2 * md_g, a1 * ed_t + a2 * md_t
                found[full] = np.stack([ed_g, ed_t, md_g, md_t, fd_g, fd_t, fd_g / (fd_t + 1e-12)], axis=1)
            none = np.isnan(found)
            for k, name in enumerate(SCORES):
                out[name] = pd.arrays.FloatingArray(found[:, k].copy(), none[:, k].copy())
            out["predicted"] = pd.arrays.IntegerArray((found[:, -1] >= 1.0).astype(np.int32), none[:, -1].copy())
            yield out

    return df.select(*[f.name for f in kept], ev, "__grp").mapInPandas(judge, schema)


EMPTY = {"precision_pct": 100.0, "recall_pct": 100.0, "fpr_pct": 0.0, "fnr_pct": 0.0, "tpr_pct": 0.0, "tnr_pct": 0.0}


def _counts(predicted: str, truth: str) -> list[Column]:
    count = lambda p, t: F.sum(F.when((F.col(predicted) == p) & (F.col(truth) == t), 1).otherwise(0)).cast("long")
    return [count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 0).alias("tn"), count(0, 1).alias("fn")]


def _rates(empty: dict[str, float]) -> list[Column]:
    tp, fp, tn, fn = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tp", "fp", "tn", "fn"))
    rate = lambda a, b, name: F.coalesce(F.try_divide(100.0 * a, b), F.lit(empty[name])).alias(name)
    return [
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), F.try_divide(100.0 * (tp + tn), tp + fp + tn + fn).alias("accuracy_pct"),
        rate(tp, tp + fp, "precision_pct"), rate(tp, tp + fn, "recall_pct"), rate(fp, fp + tn, "fpr_pct"), rate(fn, fn + tp, "fnr_pct"), rate(tp, tp + fn, "tpr_pct"), rate(tn, tn + fp, "tnr_pct"),
    ]


def _ratios(ratio: str, truth: str) -> list[Column]:
    of = lambda f, cls: f(F.when(F.col(truth) == cls, F.col(ratio)))
    return [
        F.coalesce(of(F.avg, 0), F.lit(1.0)).alias("mean_golden"), F.coalesce(of(F.avg, 1), F.lit(1.0)).alias("mean_modified"),
        of(F.min, 0).alias("min_golden"), of(F.max, 0).alias("max_golden"), of(F.min, 1).alias("min_modified"), of(F.max, 1).alias("max_modified"),
    ]


def _margin() -> Column:
    return F.col("mean_modified") / (F.col("mean_golden") + 1e-12)


def evaluate(predictions: DataFrame, by: Sequence[str] = (), predicted: str = "predicted", truth: str = "label", empty: dict[str, float] | None = None) -> DataFrame:
    """Confusion counts and rates in percent; a rate without cases has the default in ``empty``."""
    return predictions.groupBy(*by).agg(*_counts(predicted, truth)).select(*by, *_rates(EMPTY | (empty or {})))


def separation(predictions: DataFrame, by: Sequence[str] = (), ratio: str = "r_fd", truth: str = "label") -> DataFrame:
    """Mean, least and largest ratio of each class (mean 1 for an empty class) and the margin between the means."""
    return predictions.groupBy(*by).agg(*_ratios(ratio, truth)).withColumn("margin", _margin())


def evaluate_all(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What ``evaluate`` and ``separation`` return, in one pass over the verdicts."""
    ratios = ["mean_golden", "mean_modified", "min_golden", "max_golden", "min_modified", "max_modified"]
    return predictions.groupBy(*by).agg(*_counts("predicted", "label"), *_ratios("r_fd", "label")).select(*by, *_rates(EMPTY), *ratios, _margin().alias("margin"))
