"""The flagship queries against plain numpy twins that share no code with them but the noise's generator."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_models import numpy_fcm

from tracewell import _kernels
from tracewell.operators.cluster import start_memberships
from tracewell.operators.detect import SCORES, evaluate_all
from tracewell.operators.subspace import moments, pca_fit
from tracewell.plans import fixture
from tracewell.plans.sweep import condition_grid
from tracewell.queries import QUERIES
from tracewell.queries_models import threats, verdicts


def twin(train: list[dict], others: list[dict], classes: str, tol: float = 1e-6, limit: int = 1000) -> dict:
    """Fits on ``train`` and scores ``others``: rows of ``chip, label, ev, raw_energy, u0``."""
    x, u0 = np.array([r["ev"] for r in train]), np.array([r["u0"] for r in train])
    v, u, n = numpy_fcm(x, u0, 2.0, tol, limit)
    energy = (u**2 * np.array([r["raw_energy"] for r in train])[:, None]).sum(axis=0) / (u**2).sum(axis=0)
    t = int(energy.argmax())
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    k = min(10, len(x) - 1)
    axes, mean = vectors[:, ::-1][:, :k], x.mean(axis=0)
    pc = (x - mean) @ axes
    cls = (u.argmax(axis=1) == t).astype(int) if classes == "cluster" else np.array([r["label"] for r in train])
    centre = [(v[1 - t] - mean) @ axes, (v[t] - mean) @ axes]
    inverse = [np.linalg.pinv((np.cov(pc[cls == c], rowvar=False) if (cls == c).sum() > 1 else np.zeros((k, k))) + 1e-6 * np.eye(k)) for c in (0, 1)]
    far = lambda d, s: np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, s, d), 0))
    golden = pc[cls == 0] - centre[0]
    va, vb = np.sqrt((golden**2).sum(axis=1)).var() + 1e-6, far(golden, inverse[0]).var() + 1e-6
    ha, hb = (-(p / (va + vb)) * np.log2(p / (va + vb)) for p in (va, vb))
    a1, a2 = ha / (ha + hb), hb / (ha + hb)
    y = np.array([r["ev"] for r in others])
    q = (y - mean) @ axes
    ed = [np.sqrt(((y - v[c]) ** 2).sum(axis=1)) for c in (1 - t, t)]
    md = [far(q - centre[c], inverse[c]) for c in (0, 1)]
    fd = [a1 * ed[c] + a2 * md[c] for c in (0, 1)]
    r = fd[0] / (fd[1] + 1e-12)
    return {"scores": np.stack([*ed, *md, *fd, r], axis=1), "predicted": (r >= 1).astype(int), "rounds": n, "explained_pct": 100 * values[::-1][:k].sum() / values.sum(), "energy_higher": energy[t] > energy[1 - t]}


def metrics(found: dict, others: list[dict]) -> dict:
    p, t, r = found["predicted"], np.array([x["label"] for x in others]), found["scores"][:, -1]
    tp, fp, tn, fn = (int(((p == a) & (t == b)).sum()) for a, b in ((1, 1), (1, 0), (0, 0), (0, 1)))
    rate = lambda a, b, empty: 100 * a / b if b else empty
    mean_g, mean_t = (r[t == c].mean() if (t == c).any() else 1.0 for c in (0, 1))
    return {
        "tp": tp, "fp": fp, "tn": tn, "fn": fn, "accuracy_pct": 100 * (tp + tn) / len(t), "precision_pct": rate(tp, tp + fp, 100), "recall_pct": rate(tp, tp + fn, 100),
        "fpr_pct": rate(fp, fp + tn, 0), "fnr_pct": rate(fn, fn + tp, 0), "mean_golden": mean_g, "mean_modified": mean_t, "margin": mean_t / (mean_g + 1e-12),
    }


def agrees(row, wanted: dict, rtol: float) -> None:
    for name, value in wanted.items():
        assert np.isclose(row[name], value, rtol=rtol), (name, row[name], value)


@pytest.fixture(scope="module")
def chips(spark, sf_dir):
    rows = fixture.chip_vectors(spark, sf_dir).withColumn("u0", start_memberships(F.col("chip"), 2)).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["chip"])


def split(rows):
    return [r for r in rows if r["split"] == "train"], [r for r in rows if r["split"] == "validation"]


def test_verdicts_and_metrics(spark, sf_dir, chips):
    train, others = split(chips)
    found = twin(train, others, "cluster")
    got = {r.chip: r for r in verdicts(spark, sf_dir).collect()}
    assert len(got) == len(others)
    for r, scores, predicted in zip(others, found["scores"], found["predicted"], strict=True):
        assert got[r["chip"]].predicted == predicted and np.allclose([got[r["chip"]][s] for s in SCORES], scores, rtol=1e-5)
    agrees(evaluate_all(verdicts(spark, sf_dir)).first(), metrics(found, others), 1e-5)


def test_reconstruction(spark, sf_dir, chips):
    x = np.array([r["ev"] for r in chips])
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    centred, axes = x - x.mean(axis=0), vectors[:, ::-1][:, :10]
    error = (centred**2).sum(axis=1) - ((centred @ axes) ** 2).sum(axis=1)
    got = {r.chip: r for r in QUERIES["pca_reconstruct"](spark, sf_dir).collect()}
    assert np.allclose([got[r["chip"]].squared_error for r in chips], error, atol=2e-6)
    assert np.allclose(got[chips[0]["chip"]].explained_pct, 100 * values[::-1][:10].sum() / values.sum(), atol=1e-5)


def test_threat_classes(spark, sf_dir, chips):
    got = {r.threat: r for r in threats(spark, sf_dir).collect()}
    names = ("T100", "T400", "T800")
    seen = 0
    for name, row in got.items():
        train, others = split([r for r in chips if names[r["chip"] // 6 % 3] == name])
        found = twin(train, others, "label", limit=60)
        assert row.n_iter == found["rounds"] and row.energy_higher == found["energy_higher"]
        agrees(row, metrics(found, others) | {"explained_pct": found["explained_pct"]}, 1e-4)
        seen += 1
    assert seen >= 2


def test_sweep(spark, sf_dir):
    """Every condition and method: stress, transform, fit, score and evaluate, one trace after the other."""
    grid = condition_grid(fixture.traces(spark, sf_dir)).withColumn("key", F.xxhash64("chip", "experiment", "snr_db", "drift_pct", F.lit(42)))
    by: dict[tuple, list[dict]] = {}
    for r in grid.withColumn("u0", start_memberships(F.col("chip"), 2)).collect():
        d = np.array(r.samples)
        d = np.interp(np.arange(len(d)) * (1 + r.drift_pct / 100), np.arange(len(d)), d)
        d = d + np.sqrt(np.mean(d**2) / 10 ** (r.snr_db / 10)) * _kernels.keyed_normals(r.key, len(d))
        mag = np.abs(np.fft.fft(d))[: len(d) // 2]
        band = np.array([np.sqrt(np.mean(mag[a:b] ** 2)) for a, b in zip(fixture.LO, fixture.HI, strict=True)])
        for method, ev in (("band", band), ("bin", mag[fixture.BINS])):
            row = {"chip": r.chip, "label": r.label, "split": r.split, "u0": r.u0, "ev": ev / (np.linalg.norm(ev) + 1e-12), "raw_energy": (mag**2).sum()}
            by.setdefault((r.experiment, r.snr_db, r.drift_pct, method), []).append(row)
    got = {(r.experiment, r.snr_db, r.drift_pct, r.method): r for r in QUERIES["robustness_sweep"](spark, sf_dir).collect()}
    assert set(got) == set(by) and len(by) == 26
    for key, rows in by.items():
        train, others = split(sorted(rows, key=lambda r: r["chip"]))
        agrees(got[key], metrics(twin(train, others, "label", 1e-5, 60), others), 1e-3)


def test_components_of_many_features_end_beside_a_session(spark):
    x = np.random.default_rng(0).normal(size=(300, 129))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chip long, ev array<double>")
    model, m = pca_fit(df, 10)["all"], moments(df)["all"]
    assert model.coeff.shape == (129, 10) and np.allclose(np.einsum("ij,jk->ik", m.cov, model.coeff), model.coeff * model.explained[:10] * np.trace(m.cov), atol=1e-8)
