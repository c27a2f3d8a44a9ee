from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators.cluster import ALL, cluster_accuracy, energy_label, fcm_fit, hard_assign, key_of, with_memberships
from tracewell.operators.detect import evaluate, fit_detector, score, separation
from tracewell.operators.spectral import features
from tracewell.operators.subspace import moments, pca_fit, pca_project, triangles
from tracewell.operators.traces import drift_resample, hamming_toggles, toggle_summary
from tracewell.plans import fixture
from tracewell.plans.sweep import threat_benchmark
from tracewell.sources import load_detectors, load_fcm, load_pca, save_detectors, save_fcm, save_pca


def vectors(spark, n=60, d=6, seed=0, parts=3):
    rng = np.random.default_rng(seed)
    rows = [(i, i % 2, "train" if i % 3 else "validation", (rng.normal(size=d) * 0.2 + (i % 2) * 2 + 1).tolist(), float(1 + i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "chip long, label int, split string, ev array<double>, raw_energy double").repartition(parts)


def numpy_fcm(x, u, m, tol, limit):
    for n in range(1, limit + 1):
        old, w = u, u**m
        v = (w.T @ x) / (w.sum(axis=0)[:, None] + 1e-12)
        d = np.maximum(np.sqrt(((x[:, None] - v[None]) ** 2).sum(axis=2)), 1e-12)
        u = 1 / (((d[:, :, None] / d[:, None, :]) ** (2 / (m - 1))).sum(axis=2) + 1e-12)
        if np.abs(u - old).max() < tol:
            break
    return v, u, n


@pytest.mark.parametrize(("c", "m"), [(2, 2.0), (3, 1.5)])
def test_fcm_equals_numpy_on_any_partitioning(spark, c, m):
    from tracewell.operators.cluster import start_memberships

    base = vectors(spark)
    start = {r.chip: r.u for r in base.select("chip", start_memberships(F.col("chip"), c).alias("u")).collect()}
    rows = sorted(base.collect(), key=lambda r: r.chip)
    v, u, n = numpy_fcm(np.array([r.ev for r in rows]), np.array([start[r.chip] for r in rows]), m, 1e-6, 500)
    for parts in (1, 5):
        model = fcm_fit(base.repartition(parts), c, m, 1e-6, 500)
        assert np.allclose(model.centers[ALL], v, atol=1e-8) and model.rounds[ALL] == n
    got = {r.chip: r.u for r in with_memberships(base, model).select("chip", "u").collect()}
    assert np.allclose([got[r.chip] for r in rows], u, atol=1e-6) and np.allclose([sum(x) for x in got.values()], 1)
    objective = [j for _, _, j, _ in model.history]
    assert all(b <= a + 1e-9 for a, b in zip(objective, objective[1:], strict=False))


def test_fcm_stops_when_centres_coincide(spark):
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(10)], "chip long, ev array<double>")
    model = fcm_fit(same, max_iter=1000)
    assert model.collapsed[ALL] and model.rounds[ALL] <= 2


def test_grouped_fit_equals_single_fits(spark):
    a, b = vectors(spark, seed=1).withColumn("g", F.lit("a")), vectors(spark, seed=2).withColumn("g", F.lit("b"))
    both = fcm_fit(a.unionByName(b), by=["g"])
    assert np.allclose(both.centers["a"], fcm_fit(a).centers[ALL]) and np.allclose(both.centers["b"], fcm_fit(b).centers[ALL])


def test_groups_of_nulls_and_bars(spark):
    """Groups stay apart where values are null, hold a bar or a backslash, or are the text that stands for a null."""
    names = [("a", None), (None, "a"), ("a|b", "c"), ("a", "b|c"), ("\\", "|"), ("\\|", ""), ("\\N", "x"), (None, "x"), ("", None), (None, None)]
    rows = [(x, y, i, [float(100 * k), float(i)]) for k, (x, y) in enumerate(names) for i in range(4)]
    df = spark.createDataFrame(rows, "x string, y string, chip int, ev array<double>").repartition(3)
    found = moments(df, by=["x", "y"])
    assert {key: (m.n, m.mean[0]) for key, m in found.items()} == {key_of(*name): (4, 100.0 * k) for k, name in enumerate(names)}
    model = fcm_fit(df, by=["x", "y"])
    assert set(model.centers) == set(found)
    split = df.withColumn("split", F.when(F.col("chip") % 2 == 0, "train").otherwise("validation")).withColumn("label", F.col("chip") % 2).withColumn("raw_energy", F.lit(1.0))
    detectors = fit_detector(split, by=["x", "y"], components=1)
    assert all(r.r_fd is not None for r in score(split, detectors, ["x", "y"]).collect())
    rows = threat_benchmark(split.drop("y").withColumnRenamed("x", "threat").where("threat is null or threat = 'a|b'")).collect()
    assert {r.threat for r in rows} == {None, "a|b"}


def test_ties_and_labels(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.2, 0.8],)], "u array<double>")
    assert [r.c for r in df.select(hard_assign(F.col("u")).alias("c")).collect()] == [0, 1]
    tie = spark.createDataFrame([("g", [0.5, 0.5], 3.0, [1.0])], "grp string, u array<double>, raw_energy double, ev array<double>")
    for rule in ("weighted_raw", "center"):
        assert {r.cluster: r.modified for r in energy_label(tie, rule).collect()} == {0: True, 1: False}
    assert [r.cluster for r in energy_label(tie, "hard_total").collect()] == [0]
    acc = cluster_accuracy(spark.createDataFrame([(0, 0), (1, 0)], "predicted int, label int")).first()
    assert (acc.accuracy_pct, acc.n_golden, acc.n_modified) == (50.0, 1, 1)


def test_moments_and_pca(spark):
    df = vectors(spark, d=5, parts=7)
    x = np.array([r.ev for r in df.collect()])
    m = moments(df)[ALL]
    assert m.n == len(x) and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.cov, np.cov(x, rowvar=False))
    model = pca_fit(df, 3)
    values, vecs = np.linalg.eigh(np.cov(x, rowvar=False))
    top = vecs[:, np.argsort(values)[::-1][:3]]
    coeff = model[ALL].coeff
    assert np.allclose(coeff @ coeff.T, top @ top.T, atol=1e-8)
    pcs = np.array([r.pc for r in pca_project(df, model).select("pc").collect()])
    assert np.allclose(pcs.mean(axis=0), 0, atol=1e-9) and np.allclose(np.cov(pcs, rowvar=False), np.diag(np.diag(np.cov(pcs, rowvar=False))), atol=1e-9)


def test_moments_far_from_zero(spark):
    """One pass, one scan, and nothing cancels beside an offset of 1e9."""
    rng = np.random.default_rng(4)
    x = 1e9 + np.round(rng.normal(size=(400, 3)) * 64) / 64  # whole 64ths have an exact place beside the offset
    df = spark.createDataFrame([(v.tolist(),) for v in x], "ev array<double>").repartition(7)
    exact = np.cov((x - 1e9), rowvar=False)
    assert np.allclose(moments(df)[ALL].cov, exact, rtol=1e-9, atol=1e-12)
    t = triangles(df)[ALL]
    assert t.n == 400 and np.allclose(t.mean - 1e9, (x - 1e9).mean(axis=0), atol=1e-5)


def test_one_scan_for_moments(spark, tmp_path, monkeypatch):
    vectors(spark).select("ev").write.parquet(str(tmp_path / "v"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("moments", "moments")
    try:
        moments(spark.read.schema("ev array<double>").parquet(str(tmp_path / "v")))
        stages = {s for j in jobs.getJobIdsForGroup("moments") for s in jobs.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) <= 6  # tasks, salted groups, groups: no pass for the means before them


@pytest.mark.parametrize("parts", [1, 6])
def test_svd_form_keeps_small_components(spark, parts):
    """Components of 1e-9 of the first, which a covariance in doubles doesn't have any more."""
    rng = np.random.default_rng(9)
    left, right = np.linalg.qr(rng.normal(size=(300, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = (left - left.mean(axis=0)) * 10.0 ** -np.arange(0, 12, 2.0) @ right.T + 3.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chip int, ev array<double>").repartition(parts)
    model = pca_fit(df, 6, form="svd")[ALL]
    _, singular, rows = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.sqrt(model.explained), singular / np.linalg.norm(singular), rtol=1e-3, atol=1e-14)
    small = slice(0, 4)
    assert np.allclose(np.abs(np.sum(model.coeff[:, small] * rows[small].T, axis=0)), 1.0, atol=1e-10)
    loose = np.linalg.eigvalsh(np.cov(x, rowvar=False))[::-1]
    assert abs(np.sqrt(max(loose[-1], 0)) * np.sqrt(299) / singular[-1] - 1) > 0.1  # what the covariance form would give
    with pytest.raises(ValueError, match="form"):
        pca_fit(df, form="other")


def test_few_vectors_in_svd_form(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [1.0, 0.0, 0.0]), ("b", [3.0, 0.0, 0.0]), ("c", None)], "g string, ev array<double>")
    found = triangles(df, ["g"])
    assert found["a"].n == 1 and np.allclose(found["a"].r, 0) and np.allclose(found["a"].mean, [1, 2, 3])
    assert set(found) == {"a", "b"} and np.allclose(found["b"].r.T @ found["b"].r, np.diag([2.0, 0, 0]))
    assert pca_fit(df, by=["g"], form="svd")["b"].coeff[:, 0].tolist() == [1.0, 0.0, 0.0]


def test_class_covariance_of_all_places(spark, sf_dir):
    from tracewell.queries import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "embedding").collect()
    got = {(r.label, r.i, r.j): r["cov"] for r in QUERIES["class_cov_partial"](spark, sf_dir).collect()}
    labels = {r.label for r in rows}
    assert len(got) == len(labels) * 64 * 64
    for label in labels:
        own = np.cov(np.array([r.embedding for r in rows if r.label == label], float), rowvar=False) + 1e-6 * np.eye(64)
        assert np.allclose([[got[label, i, j] for j in range(64)] for i in range(64)], own, atol=1e-6)


def test_detector_round_trip(spark, tmp_path):
    df = vectors(spark)
    found = fit_detector(df.where("split = 'train'"), components=3)
    assert abs(found[ALL].a1 + found[ALL].a2 - 1) < 1e-12
    val = df.where("split = 'validation'").withColumn("r_fd", F.lit("clash"))
    first = {r.chip: (r.predicted, r.r_fd) for r in score(val, found).collect()}
    assert all(p == chip % 2 for chip, (p, _) in first.items())
    save_detectors(spark, found, str(tmp_path / "d"))
    again = score(val, load_detectors(spark, str(tmp_path / "d")))
    assert {r.chip: (r.predicted, r.r_fd) for r in again.collect()} == first
    save_pca(spark, {ALL: found[ALL].pca}, str(tmp_path / "p"))
    assert np.allclose(load_pca(spark, str(tmp_path / "p"))[ALL].coeff, found[ALL].pca.coeff)
    model = fcm_fit(df)
    save_fcm(spark, model, str(tmp_path / "f"))
    assert np.allclose(load_fcm(spark, str(tmp_path / "f")).centers[ALL], model.centers[ALL])
    nothing = score(spark.createDataFrame([(1, None)], "chip long, ev array<double>"), found).first()
    assert nothing.predicted is None and nothing.r_fd is None
    for classes, centers in (("label", "scores"), ("cluster", "scores")):
        assert fit_detector(df, components=2, classes=classes, centers=centers)[ALL].pca.coeff.shape == (6, 2)


def test_rates_without_cases(spark):
    row = evaluate(spark.createDataFrame([(0, 0)], "predicted int, label int")).first()
    assert (row.precision_pct, row.recall_pct, row.fpr_pct, row.fnr_pct, row.tpr_pct, row.accuracy_pct) == (100.0, 100.0, 0.0, 0.0, 0.0, 100.0)
    sep = separation(spark.createDataFrame([(2.0, 1)], "r_fd double, label int")).first()
    assert sep.mean_golden == 1.0 and sep.mean_modified == 2.0 and sep.min_golden is None


def test_features_of_odd_traces(spark):
    rows = spark.createDataFrame([(1, [float(np.sin(2 * np.pi * 40 * i / 720)) for i in range(720)]), (2, None), (3, [0.0] * 720)], "chip int, samples array<double>")
    got = {r.chip: r for r in features(rows, fixture.LO, fixture.HI, fixture.BINS).collect()}
    assert got[2].ev_band is None and got[2].raw_energy is None and set(got[3].ev_bin) == {0.0}
    assert abs(np.linalg.norm(got[1].ev_band) - 1) < 1e-9 and int(np.argmax(got[1].ev_bin)) == fixture.BINS.index(40) and abs(got[1].raw_energy - 360.0**2) < 1e-6


@pytest.mark.parametrize("pct", [-60.0, -50.0, -3.0, -0.1, 0.0, 0.5, 1.5, 3.0, 100.0, 250.0])
def test_drift_equals_interpolation(spark, pct):
    rng = np.random.default_rng(7)
    x = rng.normal(size=333)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, d double").withColumn("chip", F.lit("a"))
    got = {r.i: r.d for r in drift_resample(df, pct, 333).collect()}
    assert sorted(got) == list(range(333))
    assert np.allclose([got[i] for i in range(333)], np.interp(np.minimum(332, np.arange(333) * (1 + pct / 100)), np.arange(333), x), atol=1e-9)


def test_wide_states_and_drift(spark):
    log = spark.createDataFrame([("a", 1, 7, 1), ("a", 2, 7, None), ("a", 3, -1, 0)], "core string, cycle int, hi long, lo long")
    assert [r.toggles for r in hamming_toggles(log, ["core"], ["cycle"], ["hi", "lo"]).orderBy("cycle").collect()] == [4, 1, 61]
    only = toggle_summary(hamming_toggles(log, ["core"], ["cycle"], ["hi"]), F.lit(False)).first()
    assert only.mean_modified is None and only.delta_pct is None
    ramp = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "chip string, i int, d double")
    assert [round(r.d, 9) for r in drift_resample(ramp, 10.0, 10).orderBy("i").collect()] == [min(9.0, round(i * 1.1, 9)) for i in range(10)]
