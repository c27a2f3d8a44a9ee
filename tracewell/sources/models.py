"""Models as small tables of arrays."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewell.operators.cluster import FcmModel
from tracewell.operators.detect import Detector
from tracewell.operators.subspace import PcaModel

FCM = "grp STRING, cluster INT, center ARRAY<DOUBLE>, n_iter INT, m DOUBLE"
PCA = "grp STRING, mean ARRAY<DOUBLE>, explained ARRAY<DOUBLE>, coeff ARRAY<ARRAY<DOUBLE>>"
DETECTOR = "grp STRING, golden ARRAY<DOUBLE>, modified ARRAY<DOUBLE>, golden_pc ARRAY<DOUBLE>, modified_pc ARRAY<DOUBLE>, mean ARRAY<DOUBLE>, explained ARRAY<DOUBLE>, coeff ARRAY<ARRAY<DOUBLE>>, inverse_g ARRAY<ARRAY<DOUBLE>>, inverse_t ARRAY<ARRAY<DOUBLE>>, a1 DOUBLE, a2 DOUBLE, n_iter INT, energy_higher BOOLEAN"


def save_fcm(spark: SparkSession, model: FcmModel, path: str) -> None:
    rows = [(grp, j, v.tolist(), model.rounds.get(grp, 0), model.m) for grp, centers in model.centers.items() for j, v in enumerate(centers)]
    spark.createDataFrame(rows, FCM).coalesce(1).write.mode("overwrite").parquet(path)


def load_fcm(spark: SparkSession, path: str) -> FcmModel:
    rows = sorted(spark.read.schema(FCM).parquet(path).collect(), key=lambda r: (r.grp, r.cluster))
    model = FcmModel(rows[0].m if rows else 2.0, {})
    for grp in dict.fromkeys(r.grp for r in rows):
        own = [r for r in rows if r.grp == grp]
        model.centers[grp], model.rounds[grp] = np.array([r.center for r in own]), own[0].n_iter
    return model


def save_pca(spark: SparkSession, models: dict[str, PcaModel], path: str) -> None:
    spark.createDataFrame([(grp, m.mean.tolist(), m.explained.tolist(), m.coeff.tolist()) for grp, m in models.items()], PCA).coalesce(1).write.mode("overwrite").parquet(path)


def load_pca(spark: SparkSession, path: str) -> dict[str, PcaModel]:
    return {r.grp: PcaModel(np.array(r.mean), np.array(r.coeff), np.array(r.explained)) for r in spark.read.schema(PCA).parquet(path).collect()}


def save_detectors(spark: SparkSession, detectors: dict[str, Detector], path: str) -> None:
    rows = [
        (grp, *(x.tolist() for x in (d.golden, d.modified, d.golden_pc, d.modified_pc, d.pca.mean, d.pca.explained, d.pca.coeff, d.inverse_g, d.inverse_t)), float(d.a1), float(d.a2), d.rounds, bool(d.energy_higher))
        for grp, d in detectors.items()
    ]
    spark.createDataFrame(rows, DETECTOR).coalesce(1).write.mode("overwrite").parquet(path)


def load_detectors(spark: SparkSession, path: str) -> dict[str, Detector]:
    out = {}
    for r in spark.read.schema(DETECTOR).parquet(path).collect():
        pca = PcaModel(np.array(r.mean), np.array(r.coeff), np.array(r.explained))
        out[r.grp] = Detector(*(np.array(x) for x in (r.golden, r.modified)), pca, *(np.array(x) for x in (r.golden_pc, r.modified_pc, r.inverse_g, r.inverse_t)), r.a1, r.a2, r.n_iter, r.energy_higher)
    return out


def latest_version(spark: SparkSession, path: str) -> int:
    """The highest version in a store of detectors; 0 for a store without one."""
    try:
        versions = spark.read.parquet(path)
    except AnalysisException:  # nothing is there yet
        return 0
    return int(versions.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]) if "version" in versions.columns else 0


def publish_detectors(spark: SparkSession, detectors: dict[str, Detector], path: str) -> int:
    """Adds a version to a store and returns its number.  One file makes a version, so it is there whole or not at all."""
    version = latest_version(spark, path) + 1
    save_detectors(spark, detectors, f"{path}/version={version}")
    return version


def load_version(spark: SparkSession, path: str, version: int) -> dict[str, Detector]:
    return load_detectors(spark, f"{path}/version={version}")
