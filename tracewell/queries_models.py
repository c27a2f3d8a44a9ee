"""Queries on clustering, subspaces, detectors, their evaluation and sweeps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import sql, sql_models
from tracewell.functions import hash_uniform
from tracewell.operators.cluster import ALL, center_distance, cluster_accuracy, convergence, energy_label, fcm_fit, hard_assign, key_of, with_memberships
from tracewell.operators.detect import Detector, entropy_weights, evaluate, evaluate_all, fit_detector, score, separation
from tracewell.operators.subspace import PcaModel, covariance_pairs, explained_variance, feature_means, moments, pca_fit, pca_project, triangles
from tracewell.plans import fixture
from tracewell.plans.sweep import robustness_sweep, threat_benchmark
from tracewell.queries_frequency import r6, table
from tracewell.sources.shared import written


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("ev"))


def q_feature_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_means(_vectors(spark, sf_dir)).select(F.col("k").cast("int").alias("k"), r6("mean_v").alias("mean_v"))


def q_feature_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = covariance_pairs(_vectors(spark, sf_dir))
    return cov.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r6("cov").alias("cov"))


def q_feature_cov_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full covariance from partial sums; a row for each pair of places."""
    m = moments(_vectors(spark, sf_dir))[ALL]
    d = len(m.mean)
    return spark.createDataFrame([(i, j, float(round(m.cov[i, j], 6)) + 0.0) for i in range(d) for j in range(d)], "i int, j int, cov double")


def q_scatter_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance of each label as R'R of its tall-skinny QR, a row for each pair of places; null for a label of one vector."""
    vectors = _vectors(spark, sf_dir)
    found = triangles(vectors, ["label"])
    rows = []
    for r in vectors.where("ev is not null").select("label").distinct().collect():  # a row for each label
        t = found[key_of(r.label)]
        scatter = t.r.T @ t.r / max(t.n - 1, 1)
        rows += [(r.label, i, j, float(round(scatter[i, j], 6)) + 0.0 if t.n > 1 else None) for i in range(len(t.mean)) for j in range(len(t.mean))]
    return spark.createDataFrame(rows, f"label {vectors.schema['label'].dataType.simpleString()}, i int, j int, cov double")


def q_class_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = covariance_pairs(_vectors(spark, sf_dir), ["label"], ridge=1e-6)
    return cov.select("label", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r6("cov").alias("cov"))


def q_class_cov_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full covariance of each label with the ridge, from partial sums; null for a label of one vector, as in ``class_cov``."""
    vectors = _vectors(spark, sf_dir)
    found = moments(vectors, ["label"])
    keys = [(r.label, key_of(r.label)) for r in vectors.where("ev is not null").select("label").distinct().collect()]  # a row for each label
    value = lambda m, i, j: float(round(m.cov[i, j] + (1e-6 if i == j else 0.0), 6)) + 0.0 if m.n > 1 else None
    rows = [(label, i, j, value(found[key], i, j)) for label, key in keys for i in range(len(found[key].mean)) for j in range(len(found[key].mean))]
    return spark.createDataFrame(rows, f"label {vectors.schema['label'].dataType.simpleString()}, i int, j int, cov double")


def q_cum_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    variances = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("variance"))
    return explained_variance(variances).select("p_brand", "variance", F.col("rank").cast("int").alias("rank"), r6("cum_pct").alias("cum_pct"))


def q_center_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    means = feature_means(vectors, ["label"])
    centers = means.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "mean_v"))), lambda x: x["mean_v"]).alias("center"))
    return center_distance(vectors.select("vec_id", "ev"), centers).select("vec_id", "cluster", r6("distance").alias("distance"))


def q_hard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, 1.0).otherwise(0.0))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array(count("A"), count("N"), count("R")).alias("u"))
    return rows.select("l_orderkey", hard_assign(F.col("u")).alias("cluster"))


def q_convergence_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("round")).agg(F.sum("o_totalprice").alias("objective"))
    return convergence(rounds).select("grp", "round", F.round("delta", 2).alias("delta"))


def q_fcm_iter3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships after three rounds; each round is checked in SQL."""
    chips = written(fixture.chip_vectors(spark, sf_dir), "chips")
    model = fcm_fit(chips, tol=0.0, max_iter=3)
    return with_memberships(chips, model).select("chip", r6(F.get("u", F.lit(0))).alias("u0"))


def q_fcm_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full fit: a row for each cluster and feature."""
    model = fcm_fit(written(fixture.chip_vectors(spark, sf_dir), "chips"))
    rows = [(grp, j, k, float(round(x, 6)), model.rounds[grp]) for grp, v in model.centers.items() for j, row in enumerate(v) for k, x in enumerate(row, 1)]
    return spark.createDataFrame(rows, "grp string, cluster int, k int, center double, n_iter int")


def q_fcm_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objective of every round of the full fit, and how much it changed."""
    model = fcm_fit(written(fixture.chip_vectors(spark, sf_dir), "chips"))
    history = spark.createDataFrame([(grp, n, j) for grp, n, j, _ in model.history], "grp string, round int, objective double")
    return convergence(history).select("grp", "round", r6("objective").alias("objective"), r6("delta").alias("delta"))


def _energies(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    u = hash_uniform(F.col("vec_id"))
    rows = _vectors(spark, sf_dir).select(F.col("label").cast("string").alias("grp"), F.array(u, 1 - u).alias("u"), (F.col("vec_id") % 97).cast("double").alias("raw_energy"), "ev")
    return energy_label(rows, rule).select("grp", "cluster", r6("energy").alias("energy"), "modified")


def q_energy_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _energies(spark, sf_dir, "weighted_raw")


def q_energy_label_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters labelled by the energy of their weighted centres."""
    return _energies(spark, sf_dir, "center")


def q_energy_label_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters labelled by the summed energy of their hard members."""
    return _energies(spark, sf_dir, "hard_total")


def q_entropy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = lambda first: F.sqrt(F.aggregate(F.slice("ev", first, 32), F.lit(0.0), lambda s, x: s + x * x))
    rows = _vectors(spark, sf_dir).select("label", norm(1).alias("ed"), (3 * norm(33)).alias("md"))
    return entropy_weights(rows, ["label"]).select("label", r6("a1").alias("a1"), r6("a2").alias("a2"))


def fixed_detector(vectors: DataFrame) -> dict[str, Detector]:
    """A model that is no fit: the mean vectors of both labels as centres, two features as components."""
    centre = {label: np.zeros(24) for label in (0, 1)}
    for r in feature_means(vectors, ["label"]).where("label in (0, 1)").collect():  # 2 x 24 rows
        centre[r.label][r.k] = r.mean_v
    axes = np.zeros((24, 2))
    axes[8, 0] = axes[9, 1] = 1.0  # the clock's bin and the first leak's
    pca = PcaModel(np.zeros(24), axes, np.zeros(24))
    inverse_g, inverse_t = np.array([[4.0, 0.5], [0.5, 2.0]]), np.array([[3.0, -0.25], [-0.25, 5.0]])
    return {ALL: Detector(centre[0], centre[1], pca, centre[0][[8, 9]], centre[1][[8, 9]], inverse_g, inverse_t, 0.7, 0.3)}


def rounded_scores(found: DataFrame, *more: str) -> DataFrame:
    return found.select("chip", "label", *(F.round(c, 4).alias(c) for c in ("ed_g", "ed_t", "md_g", "md_t", "fd_g", "fd_t")), *(F.round(c, 3).alias(c) for c in more), "predicted")


def q_fusion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against a fixed model."""
    vectors = fixture.chip_vectors(spark, sf_dir)
    return rounded_scores(score(vectors.drop("ev_bin"), fixed_detector(vectors)))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("predicted"), F.col("toxic").alias("label"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


def q_confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate(_predictions(spark, sf_dir), ["source"])
    return found.select("source", "tp", "fp", "tn", "fn", *(r6(c).alias(c) for c in found.columns[5:]))


def q_cluster_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_accuracy(_predictions(spark, sf_dir), ["lang"])
    return found.select("lang", r6("accuracy_pct").alias("accuracy_pct"), F.col("n_golden").cast("long").alias("n_golden"), F.col("n_modified").cast("long").alias("n_modified"))


def q_separation_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", (F.abs("c_acctbal") / 1000).alias("r_fd"), (F.col("c_custkey") % 2).cast("int").alias("label"))
    found = separation(rows, ["c_mktsegment"])
    return found.select("c_mktsegment", *(r6(c).alias(c) for c in found.columns[1:]))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(fixture.chip_vectors(spark, sf_dir), "chips")
    detectors = fit_detector(vectors.where("split = 'train'"))
    return score(vectors.where("split = 'validation'").drop("ev_bin"), detectors)


def q_detector_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a detector fitted on the training chips, its verdict on every validation chip."""
    return rounded_scores(verdicts(spark, sf_dir), "r_fd")


RATIOS = ["mean_golden", "mean_modified", "min_golden", "max_golden", "min_modified", "max_modified"]


def _rounded_metrics(found: DataFrame, *others: str) -> DataFrame:
    rates = [c for c in found.columns if c.endswith("_pct")]
    return found.select(*others, "tp", "fp", "tn", "fn", *(r6(c).alias(c) for c in rates), *(F.round(c, 3).alias(c) for c in RATIOS), F.round(F.log10("margin"), 6).alias("log_margin"))


def q_detector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(evaluate_all(verdicts(spark, sf_dir)))


def q_pca_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of each chip's vector rebuilt from ten components, and the variance they explain."""
    vectors = written(fixture.chip_vectors(spark, sf_dir), "chips")
    model = pca_fit(vectors)
    pca = model[ALL]
    scores = pca_project(vectors, model)
    length = F.aggregate("pc", F.lit(0.0), lambda s, x: s + x * x)
    centred = F.aggregate(F.zip_with("ev", F.array(*(F.lit(float(x)) for x in pca.mean)), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x)
    return scores.select("chip", r6(centred - length).alias("squared_error"), F.lit(round(float(100 * pca.explained[:10].sum()), 6)).alias("explained_pct"))


def q_robustness_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness_sweep(fixture.traces(spark, sf_dir), fixture.LO, fixture.HI, fixture.BINS)


def threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three threat classes: chips of each, by number, with their own detector."""
    vectors = fixture.chip_vectors(spark, sf_dir).drop("ev_bin")
    classes = F.array(F.lit("T100"), F.lit("T400"), F.lit("T800"))
    return threat_benchmark(vectors.withColumn("threat", F.get(classes, (F.floor(F.col("chip") / 6) % 3).cast("int"))))


def q_threat_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(threats(spark, sf_dir), "threat", "energy_higher", "n_iter")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}


def _round(n: int, first: str) -> str:
    """One round of fuzzy c-means: centres from memberships ``first``, then memberships ``m{n}``."""
    return f"""
c{n} AS (SELECT k, sum(u * u * v) / (sum(u * u) + 1e-12) AS v0, sum((1 - u) * (1 - u) * v) / (sum((1 - u) * (1 - u)) + 1e-12) AS v1 FROM ft JOIN {first} ON ft.chip = {first}.chip GROUP BY k),
d{n} AS (SELECT chip, greatest(sqrt(sum((v - v0) * (v - v0))), 1e-12) AS d0, greatest(sqrt(sum((v - v1) * (v - v1))), 1e-12) AS d1 FROM ft JOIN c{n} ON ft.k = c{n}.k GROUP BY chip),
m{n} AS (SELECT chip, 1e0 / (1e0 + pow(d0 / d1, 2) + 1e-12) AS u FROM d{n})"""


#: More rounds than the full fit takes on the fixture; the SQL finds the one that it ends with.
ROUNDS = 15


def _full_fit(features: str = sql.FEATURES.replace("ft AS (SELECT", "ft AS MATERIALIZED (SELECT")) -> str:
    rounds = ",".join(_round(n, f"m{n - 1}") for n in range(1, ROUNDS + 1)).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")
    moved = " UNION ALL ".join(f"SELECT {n} AS n, max(abs(a.u - b.u)) AS moved FROM m{n} a JOIN m{n - 1} b ON a.chip = b.chip" for n in range(1, ROUNDS + 1))
    centres = " UNION ALL ".join(f"SELECT {n} AS n, k, v0, v1 FROM c{n}" for n in range(1, ROUNDS + 1))
    return f"""WITH {features},
m0 AS MATERIALIZED (SELECT chip, CAST(CAST('0x' || substr(md5(CAST(chip AS VARCHAR) || '|42'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 AS u FROM (SELECT DISTINCT chip FROM ft) z),{rounds},
st AS (SELECT min(n) AS n FROM ({moved}) x WHERE moved < 1e-6), ce AS (SELECT c.*, st.n AS n_iter FROM ({centres}) c JOIN st ON c.n = st.n)
SELECT 'all' AS grp, 0 AS cluster, CAST(k AS INTEGER) AS k, round(v0, 6) + 0e0 AS center, CAST(n_iter AS INTEGER) AS n_iter FROM ce
UNION ALL SELECT 'all', 1, CAST(k AS INTEGER), round(v1, 6) + 0e0, CAST(n_iter AS INTEGER) FROM ce"""


def _history() -> str:
    """The objective of each round up to the one that the fit ends with."""
    fit = _full_fit()
    steps = " UNION ALL ".join(f"SELECT {n} AS n, sum(u * u * d0 * d0 + (1 - u) * (1 - u) * d1 * d1) AS j FROM m{n} JOIN d{n} ON m{n}.chip = d{n}.chip" for n in range(1, ROUNDS + 1))
    return fit[: fit.index("SELECT 'all' AS grp")].rstrip() + f""", jn AS (SELECT x.n AS n, j FROM ({steps}) x JOIN st ON x.n <= st.n)
SELECT 'all' AS grp, CAST(n AS INTEGER) AS round, round(j, 6) + 0e0 AS objective, round(abs(j - lag(j) OVER (ORDER BY n)), 6) + 0e0 AS delta FROM jn"""


def _detector(classes: str = "cluster", chips: str = "true") -> str:
    """The whole detector of some chips: the fit runs over the training chips, which it knows as ``ft``."""
    whole = sql.FEATURES.replace("ft AS (SELECT", "fa AS MATERIALIZED (SELECT") + f",\nft AS MATERIALIZED (SELECT * FROM fa WHERE (chip // 2) % 3 <> 2 AND {chips})"
    fit = _full_fit(whole)
    fit = fit[: fit.index("SELECT 'all' AS grp")].rstrip()
    last = " UNION ALL ".join(f"SELECT {n} AS n, chip, u FROM m{n}" for n in range(1, ROUNDS + 1))
    more = f"""{fit},
me AS MATERIALIZED (SELECT chip, u FROM ({last}) x JOIN st ON x.n = st.n),
bz AS (SELECT range AS bin FROM range(360)),
en AS MATERIALIZED (SELECT chip, sum(re * re + im * im) AS e FROM (SELECT tr.chip AS chip, bin, sum(d * cos{sql.angle("bin")}) AS re, sum(d * sin{sql.angle("bin")}) AS im FROM tr CROSS JOIN bz WHERE EXISTS (SELECT 1 FROM me WHERE me.chip = tr.chip) GROUP BY tr.chip, bin) z GROUP BY chip),
tf AS (SELECT chip, k, v FROM ft)"""
    return sql_models.detector(more, classes).replace("FROM ft GROUP BY chip", f"FROM fa WHERE {chips} GROUP BY chip")


def _metrics(detector: str, others: str = "") -> str:
    ratio = "coalesce(avg(CASE WHEN label = {} THEN r_fd END), 1e0)"
    return f"""{detector},
cf AS (SELECT CAST(sum(CASE WHEN predicted = 1 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN predicted = 1 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN predicted = 0 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN predicted = 0 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, {ratio.format(0)} AS g, {ratio.format(1)} AS t, min(CASE WHEN label = 0 THEN r_fd END) AS g0, max(CASE WHEN label = 0 THEN r_fd END) AS g1, min(CASE WHEN label = 1 THEN r_fd END) AS t0, max(CASE WHEN label = 1 THEN r_fd END) AS t1 FROM vd HAVING count(*) > 0)
SELECT {others}tp, fp, tn, fn, round(100e0 * (tp + tn) / (tp + fp + tn + fn), 6) AS accuracy_pct, round(CASE WHEN tp + fp > 0 THEN 100e0 * tp / (tp + fp) ELSE 100e0 END, 6) AS precision_pct, round(CASE WHEN tp + fn > 0 THEN 100e0 * tp / (tp + fn) ELSE 100e0 END, 6) AS recall_pct,
  round(CASE WHEN fp + tn > 0 THEN 100e0 * fp / (fp + tn) ELSE 0e0 END, 6) AS fpr_pct, round(CASE WHEN fn + tp > 0 THEN 100e0 * fn / (fn + tp) ELSE 0e0 END, 6) AS fnr_pct, round(CASE WHEN tp + fn > 0 THEN 100e0 * tp / (tp + fn) ELSE 0e0 END, 6) AS tpr_pct,
  round(CASE WHEN tn + fp > 0 THEN 100e0 * tn / (tn + fp) ELSE 0e0 END, 6) AS tnr_pct, round(g, 3) AS mean_golden, round(t, 3) AS mean_modified, round(g0, 3) AS min_golden, round(g1, 3) AS max_golden, round(t0, 3) AS min_modified, round(t1, 3) AS max_modified, round(log10(t / (g + 1e-12)), 6) AS log_margin FROM cf"""


_EXPLAINED = "round((SELECT 100e0 * sum(l) FROM co) / (SELECT sum(v) FROM cx WHERE i = j), 6) + 0e0 AS explained_pct"
_THREATS = " UNION ALL ".join(
    "SELECT * FROM (" + _metrics(_detector("label", f"(chip // 6) % 3 = {k}"), f"'{threat}' AS threat, (SELECT CASE WHEN t = 1 THEN e1 > e0 ELSE e0 > e1 END FROM eg CROSS JOIN ro) AS energy_higher, (SELECT CAST(n AS INTEGER) FROM st) AS n_iter, {_EXPLAINED}, ") + f") q{k}"
    for k, threat in enumerate(("T100", "T400", "T800"))
)


_MEMBERS = f"w AS (SELECT vec_id, CAST(label AS VARCHAR) AS grp, {sql.uniform('CAST(vec_id AS VARCHAR)')} AS u FROM embeddings)"
_LABELLED = "SELECT grp, cluster, round(energy, 6) + 0e0 AS energy, row_number() OVER (PARTITION BY grp ORDER BY energy DESC, cluster) = 1 AS modified FROM g"
ORACLE_SQL = {
    "pca_reconstruct": f"""WITH {sql.FEATURES.replace("ft AS (SELECT", "ft AS MATERIALIZED (SELECT")}, {sql_models.components("ft")}, {sql_models.projected("pc", "cl")}
SELECT cl.chip AS chip, round(list_dot_product(x, x) - list_dot_product(y, y), 6) + 0e0 AS squared_error, {_EXPLAINED} FROM cl JOIN pc ON cl.chip = pc.chip""",
    "detector_verdicts": f"{_detector()} SELECT chip, label, {', '.join(f'round({c}, 4) AS {c}' for c in ('ed_g', 'ed_t', 'md_g', 'md_t', 'fd_g', 'fd_t'))}, round(r_fd, 3) AS r_fd, predicted FROM vd",
    "detector_metrics": _metrics(_detector()),
    "threat_benchmark": _THREATS,
    "fcm_history": _history(),
    "energy_label_center": f"""WITH {sql.EMBEDDED}, {_MEMBERS},
c AS (SELECT grp, cluster, k, sum(q * q * x) / (sum(q * q) + 1e-12) AS v FROM (SELECT grp, 0 AS cluster, k, u AS q, x FROM w JOIN em ON w.vec_id = em.vec_id UNION ALL SELECT grp, 1, k, 1 - u, x FROM w JOIN em ON w.vec_id = em.vec_id) z GROUP BY 1, 2, 3),
g AS (SELECT grp, cluster, sum(v * v) AS energy FROM c GROUP BY 1, 2) {_LABELLED}""",
    "energy_label_total": f"""WITH {sql.EMBEDDED}, {_MEMBERS},
g AS (SELECT grp, CAST(CASE WHEN u >= 1 - u THEN 0 ELSE 1 END AS INTEGER) AS cluster, sum(x * x) AS energy FROM w JOIN em ON w.vec_id = em.vec_id GROUP BY 1, 2) {_LABELLED}""",
    "fcm_model": _full_fit(),
    "feature_means": f"WITH {sql.EMBEDDED} SELECT k, round(avg(x), 6) + 0e0 AS mean_v FROM em GROUP BY k",
    "feature_cov": f"WITH {sql.EMBEDDED} SELECT a.k AS i, b.k AS j, round(covar_samp(a.x, b.x), 6) + 0e0 AS cov FROM em a JOIN em b ON a.vec_id = b.vec_id GROUP BY 1, 2",
    "feature_cov_partial": f"WITH {sql.EMBEDDED} SELECT a.k AS i, b.k AS j, round(covar_samp(a.x, b.x), 6) + 0e0 AS cov FROM em a JOIN em b ON a.vec_id = b.vec_id GROUP BY 1, 2",
    "scatter_qr": f"WITH {sql.EMBEDDED} SELECT a.label AS label, a.k AS i, b.k AS j, round(covar_samp(a.x, b.x), 6) + 0e0 AS cov FROM em a JOIN em b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3",
    "class_cov": f"WITH {sql.EMBEDDED} SELECT a.label AS label, a.k AS i, b.k AS j, round(covar_samp(a.x, b.x) + CASE WHEN a.k = b.k THEN 1e-6 ELSE 0e0 END, 6) + 0e0 AS cov FROM em a JOIN em b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3",
    "class_cov_partial": f"WITH {sql.EMBEDDED} SELECT a.label AS label, a.k AS i, b.k AS j, round(covar_samp(a.x, b.x) + CASE WHEN a.k = b.k THEN 1e-6 ELSE 0e0 END, 6) + 0e0 AS cov FROM em a JOIN em b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3",
    "cum_explained": """WITH v AS (SELECT p_brand, CAST(sum(p_size) AS DOUBLE) AS variance FROM part GROUP BY 1)
SELECT p_brand, variance, CAST(row_number() OVER (ORDER BY variance DESC, p_brand) AS INTEGER) AS rank,
  round(100e0 * sum(variance) OVER (ORDER BY variance DESC, p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(variance) OVER (), 6) + 0e0 AS cum_pct FROM v""",
    "center_distance": f"""WITH {sql.EMBEDDED}, ce AS (SELECT label AS cluster, k, avg(x) AS c FROM em GROUP BY 1, 2)
SELECT vec_id, cluster, round(sqrt(sum((x - c) * (x - c))), 6) + 0e0 AS distance FROM em JOIN ce ON em.k = ce.k GROUP BY 1, 2""",
    "hard_assign": """WITH u AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(CASE WHEN a >= n AND a >= r THEN 0 WHEN n >= r THEN 1 ELSE 2 END AS INTEGER) AS cluster FROM u""",
    "convergence_delta": """WITH o AS (SELECT o_orderpriority AS grp, CAST(year(o_orderdate) AS INTEGER) AS round, sum(o_totalprice) AS objective FROM orders GROUP BY 1, 2)
SELECT grp, round, round(abs(objective - lag(objective) OVER (PARTITION BY grp ORDER BY round)), 2) AS delta FROM o""",
    "fcm_iter3": f"""WITH {sql.FEATURES}, m0 AS (SELECT chip, CAST(CAST('0x' || substr(md5(CAST(chip AS VARCHAR) || '|42'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 AS u FROM (SELECT DISTINCT chip FROM ft) z),
{_round(1, "m0")}, {_round(2, "m1")}, {_round(3, "m2")} SELECT chip, round(u, 6) + 0e0 AS u0 FROM m3""",
    "energy_label": f"""WITH w AS (SELECT CAST(label AS VARCHAR) AS grp, {sql.uniform("CAST(vec_id AS VARCHAR)")} AS u, CAST(vec_id % 97 AS DOUBLE) AS e FROM embeddings),
g AS (SELECT grp, 0 AS cluster, sum(u * u * e) / sum(u * u) AS energy FROM w GROUP BY grp UNION ALL SELECT grp, 1, sum((1 - u) * (1 - u) * e) / sum((1 - u) * (1 - u)) FROM w GROUP BY grp)
SELECT grp, cluster, round(energy, 6) + 0e0 AS energy, row_number() OVER (PARTITION BY grp ORDER BY energy DESC, cluster) = 1 AS modified FROM g""",
    "entropy_weights": f"""WITH {sql.EMBEDDED}, n AS (SELECT vec_id, label, sqrt(sum(CASE WHEN k < 32 THEN x * x ELSE 0e0 END)) AS ed, 3e0 * sqrt(sum(CASE WHEN k >= 32 THEN x * x ELSE 0e0 END)) AS md FROM em GROUP BY 1, 2),
v AS (SELECT label, var_pop(ed) + 1e-6 AS a, var_pop(md) + 1e-6 AS b FROM n GROUP BY label),
h AS (SELECT label, -(a / (a + b)) * log2(a / (a + b)) AS h1, -(b / (a + b)) * log2(b / (a + b)) AS h2 FROM v)
SELECT label, round(h1 / (h1 + h2), 6) + 0e0 AS a1, round(h2 / (h1 + h2), 6) + 0e0 AS a2 FROM h""",
    "fusion_score": f"""WITH {sql.FEATURES}, ce AS (SELECT k, avg(CASE WHEN label = 0 THEN v END) AS g, avg(CASE WHEN label = 1 THEN v END) AS t FROM ft GROUP BY k),
s AS (SELECT chip, label, sqrt(sum((v - g) * (v - g))) AS ed_g, sqrt(sum((v - t) * (v - t))) AS ed_t,
  sum(CASE WHEN ft.k = 9 THEN v - g ELSE 0e0 END) AS g1, sum(CASE WHEN ft.k = 10 THEN v - g ELSE 0e0 END) AS g2,
  sum(CASE WHEN ft.k = 9 THEN v - t ELSE 0e0 END) AS t1, sum(CASE WHEN ft.k = 10 THEN v - t ELSE 0e0 END) AS t2 FROM ft JOIN ce ON ft.k = ce.k GROUP BY chip, label),
m AS (SELECT *, sqrt(greatest(0e0, 4e0 * g1 * g1 + 1e0 * g1 * g2 + 2e0 * g2 * g2)) AS md_g, sqrt(greatest(0e0, 3e0 * t1 * t1 - 0.5e0 * t1 * t2 + 5e0 * t2 * t2)) AS md_t FROM s),
f AS (SELECT *, 0.7e0 * ed_g + 0.3e0 * md_g AS fd_g, 0.7e0 * ed_t + 0.3e0 * md_t AS fd_t FROM m)
SELECT chip, label, round(ed_g, 4) AS ed_g, round(ed_t, 4) AS ed_t, round(md_g, 4) AS md_g, round(md_t, 4) AS md_t, round(fd_g, 4) AS fd_g, round(fd_t, 4) AS fd_t,
  CASE WHEN fd_g / (fd_t + 1e-12) >= 1 THEN 1 ELSE 0 END AS predicted FROM f""",
    "confusion_metrics": """WITH p AS (SELECT source, quality AS p, toxic AS t FROM labels JOIN documents ON labels.doc_id = documents.doc_id),
c AS (SELECT source, CAST(sum(CASE WHEN p = 1 AND t = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN p = 1 AND t = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN p = 0 AND t = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN p = 0 AND t = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM p GROUP BY source)
SELECT source, tp, fp, tn, fn, round(100e0 * (tp + tn) / (tp + fp + tn + fn), 6) + 0e0 AS accuracy_pct,
  round(CASE WHEN tp + fp > 0 THEN 100e0 * tp / (tp + fp) ELSE 100e0 END, 6) + 0e0 AS precision_pct, round(CASE WHEN tp + fn > 0 THEN 100e0 * tp / (tp + fn) ELSE 100e0 END, 6) + 0e0 AS recall_pct,
  round(CASE WHEN fp + tn > 0 THEN 100e0 * fp / (fp + tn) ELSE 0e0 END, 6) + 0e0 AS fpr_pct, round(CASE WHEN fn + tp > 0 THEN 100e0 * fn / (fn + tp) ELSE 0e0 END, 6) + 0e0 AS fnr_pct,
  round(CASE WHEN tp + fn > 0 THEN 100e0 * tp / (tp + fn) ELSE 0e0 END, 6) + 0e0 AS tpr_pct, round(CASE WHEN tn + fp > 0 THEN 100e0 * tn / (tn + fp) ELSE 0e0 END, 6) + 0e0 AS tnr_pct FROM c""",
    "cluster_accuracy": "SELECT lang, round(avg(CASE WHEN quality = toxic THEN 100e0 ELSE 0e0 END), 6) + 0e0 AS accuracy_pct, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_golden, CAST(sum(quality) AS BIGINT) AS n_modified FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY lang",
    "separation_margin": """WITH r AS (SELECT c_mktsegment, abs(c_acctbal) / 1000e0 AS r, c_custkey % 2 AS t FROM customer),
m AS (SELECT c_mktsegment, coalesce(avg(CASE WHEN t = 0 THEN r END), 1e0) AS g, coalesce(avg(CASE WHEN t = 1 THEN r END), 1e0) AS d, min(CASE WHEN t = 0 THEN r END) AS a, max(CASE WHEN t = 0 THEN r END) AS b, min(CASE WHEN t = 1 THEN r END) AS x, max(CASE WHEN t = 1 THEN r END) AS y FROM r GROUP BY 1)
SELECT c_mktsegment, round(g, 6) + 0e0 AS mean_golden, round(d, 6) + 0e0 AS mean_modified, round(a, 6) + 0e0 AS min_golden, round(b, 6) + 0e0 AS max_golden, round(x, 6) + 0e0 AS min_modified, round(y, 6) + 0e0 AS max_modified, round(d / (g + 1e-12), 6) + 0e0 AS margin FROM m""",
}
