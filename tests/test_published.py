"""Figures of the published experiment: distances of some validation devices, weights, ratios and means."""

from __future__ import annotations

import numpy as np

from tracewell.operators.cluster import ALL
from tracewell.operators.detect import Detector, entropy_weights, evaluate_all, score
from tracewell.operators.subspace import PcaModel

#: Fixed values, as published: the weights, and device, label, both Euclidean and both Mahalanobis distances, both fused ones and their ratio.
A1, A2 = 0.8310807532764934, 0.16891924672350658
DEVICES = (
    ("G_val_1", 0, 0.0001216912969864735, 0.20277896023138534, 0.06125017904215838, 202.76530392945338, 0.010447469400248016, 34.41948809244386, 0.00030353354972008584),
    ("G_val_2", 0, 0.000116992032764956, 0.20276120783129228, 0.05556222928825943, 202.74755310834632, 0.009482759744369186, 34.41647488343569, 0.00027552966352555964),
    ("G_val_3", 0, 9.770989094142061e-05, 0.20278850104293814, 0.048172901008842035, 202.7748527127141, 0.008218534960665807, 34.42110899490424, 0.00023876438617600188),
    ("T_val_10", 1, 0.20277353242851603, 0.00011267730970953045, 202.7632180149976, 0.04096223054095217, 34.419131230402755, 0.007012953070522821, 4907.93691036761),
    ("T_val_11", 1, 0.20276250427838727, 8.419826657708888e-05, 202.7522035275122, 0.023371590484809017, 34.417261506190364, 0.0040178870182356755, 8566.010278889717),
    ("T_val_12", 1, 0.20276276175322877, 0.00013968414032883823, 202.75244311460258, 0.08519794759150863, 34.41730219104358, 0.014507661930111701, 2372.353474630921),
)


def one_axis_detector(ed_g: float, ed_t: float, md_g: float, md_t: float) -> Detector:
    """A model for which the origin has the given distances."""
    centre = lambda d: np.array([d, 0.0])
    pca = PcaModel(np.zeros(2), np.eye(2)[:, :1], np.ones(2))
    inverse = lambda ed, md: np.array([[(md / ed) ** 2]])
    return Detector(centre(ed_g), centre(ed_t), pca, centre(ed_g)[:1], centre(ed_t)[:1], inverse(ed_g, md_g), inverse(ed_t, md_t), A1, A2)


def test_published_ratios(spark):
    """Fused distances, their ratio and the verdict follow from the published distances and weights."""
    for device, label, ed_g, ed_t, md_g, md_t, fd_g, fd_t, ratio in DEVICES[::2]:
        row = score(spark.createDataFrame([(device, [0.0, 0.0])], "chip string, ev array<double>"), {ALL: one_axis_detector(ed_g, ed_t, md_g, md_t)}).first()
        assert np.allclose([row.ed_g, row.ed_t, row.md_g, row.md_t, row.fd_g, row.fd_t], [ed_g, ed_t, md_g, md_t, fd_g, fd_t], rtol=1e-9)
        assert np.isclose(row.r_fd, ratio, rtol=1e-8) and row.predicted == label


def test_published_metrics(spark):
    rows = spark.createDataFrame([(d[0], d[1], d[1], d[8]) for d in DEVICES], "chip string, label int, predicted int, r_fd double")
    found = evaluate_all(rows).first()
    golden, modified = ([d[8] for d in DEVICES if d[1] == k] for k in (0, 1))
    assert (found.accuracy_pct, found.precision_pct, found.recall_pct, found.fpr_pct) == (100.0, 100.0, 100.0, 0.0)
    assert np.isclose(found.mean_golden, np.mean(golden)) and np.isclose(found.margin, np.mean(modified) / np.mean(golden), rtol=1e-6)
    # The published ranges hold these devices: 0.000226 to 0.000329, and 2372.35 to 8566.01.
    assert 0.000226 <= found.min_golden <= found.max_golden <= 0.000329 and round(found.min_modified, 2) == 2372.35 and round(found.max_modified, 2) == 8566.01


def test_published_weights(spark):
    """Weights add up to one, and the published ones come from shares of the variances whose entropies have their ratio."""
    assert abs(A1 + A2 - 1) < 1e-12
    low, high = 0.5, 1 - 1e-12  # the share of the larger variance for which the entropies give A2
    entropy = lambda p: -p * np.log2(p)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(middle) / (entropy(middle) + entropy(1 - middle)) > A2 else (low, middle)
    share = 1 - low
    md = [0.0, 2.0 * np.sqrt(low)]
    ed = [0.0, 2.0 * np.sqrt(share)]
    row = entropy_weights(spark.createDataFrame(list(zip(map(float, ed), map(float, md), strict=True)), "ed double, md double"), ridge=0.0).first()
    assert np.isclose(row.a1, A1, rtol=1e-6) and np.isclose(row.a2, A2, rtol=1e-6)
