from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import frame, random_rows
from gaugeworks.operators import anomaly, attribution, evaluation, features, fourier, moments, supervised
from gaugeworks.operators.forest import (
    IsolationForest, average_path, fit_forest, fit_forest_nodes, raw_scores, tree_samples,
)
from gaugeworks.operators.pca import PcaEmbedding, fit_pca
from gaugeworks.operators.series import SeriesLayout
from gaugeworks.operators.store import settle
from gaugeworks.plans import fingerprint as plans
from gaugeworks.schema import METRICS, STAT_COLUMNS, WindowSpec


def table(spark, points):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id bigint, v array<double>")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    cloud = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 5
    cloud[:5] += 40
    return cloud


def test_pca_equals_numpy(spark, points):
    df = table(spark, points)
    model = fit_pca(df, "v", 3)
    found = model.transform(df, "v").withColumn("error", model.reconstruction_error("v")).orderBy("id").collect()
    centred = points - points.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    z = centred @ vt[:3].T
    mine = np.array([r["embedding"] for r in found])
    np.testing.assert_allclose(np.abs(mine), np.abs(z), atol=1e-8)
    np.testing.assert_allclose(model.explained, (s**2 / (s**2).sum())[:3], rtol=1e-9)
    error = ((centred - z @ vt[:3]) ** 2).mean(axis=1)
    np.testing.assert_allclose([r["error"] for r in found], error, atol=1e-8)


def test_pca_save_and_load(spark, points, tmp_path):
    df = table(spark, points)
    model = fit_pca(df, "v", 2)
    model.save(spark, str(tmp_path / "pca"))
    again = PcaEmbedding.load(spark, str(tmp_path / "pca"))
    a, b = (m.transform(df, "v").orderBy("id").collect() for m in (model, again))
    assert a == b


def test_average_path():
    assert list(average_path(np.array([0, 1, 2]))) == [0, 0, 1]
    assert average_path(np.array([256]))[0] == pytest.approx(10.2448, abs=1e-3)


def test_forest_finds_the_outliers_and_is_repeatable(spark, points, tmp_path):
    df = table(spark, points)
    forest = fit_forest(df, "v", ["id"], trees=100, sample_size=64, contamination=0.05)
    raw = df.select("id", forest.score(spark, "v").alias("raw"))
    flagged = {r["id"] for r in raw.where(forest.is_anomaly(F.col("raw"))).collect()}
    assert {0, 1, 2, 3, 4} <= flagged and len(flagged) == 15
    again = fit_forest(df.repartition(7), "v", ["id"], trees=100, sample_size=64, contamination=0.05)
    np.testing.assert_array_equal(forest.threshold, again.threshold)
    assert forest.cutoff == pytest.approx(again.cutoff)
    forest.save(spark, str(tmp_path / "forest"))
    loaded = IsolationForest.load(spark, str(tmp_path / "forest"))
    np.testing.assert_allclose(raw_scores(points, loaded.tables()), raw_scores(points, forest.tables()))
    assert loaded.cutoff == forest.cutoff


def test_forest_path_lengths_follow_the_trees(spark, points):
    """Walk every tree by hand for some points."""
    nodes, hand = fit_forest_nodes(table(spark, points), "v", ["id"], 10, 32, 3)
    nodes = nodes.toPandas()
    forest = IsolationForest.from_nodes(nodes, hand)
    by_id = {(r.tree_id, r.node_id): r for r in nodes.itertuples()}
    for p in points[::60]:
        depths = []
        for tree in range(10):
            node = by_id[tree, 0]
            while node.feature >= 0:
                node = by_id[tree, node.left if p[node.feature] <= node.threshold else node.right]
            depths.append(node.depth + float(average_path(np.array([node.size]))[0]))
        expected = 2 ** (-np.mean(depths) / float(average_path(np.array([32]))[0]))
        assert raw_scores(p[None, :], forest.tables())[0] == pytest.approx(expected)


def test_the_pool_is_the_rows_with_the_smallest_hashes(spark):
    df = spark.range(5000).selectExpr("id", "array(cast(id AS double)) AS v")
    samples, hand = tree_samples(df, "v", ["id"], 4, 16, 7)
    chosen = {int(r["embedding"][0]) for r in samples.collect()}
    at = F.pmod(F.xxhash64("id", F.lit(7), F.lit(-1)), F.lit(2**40))
    assert hand == 16 and chosen == {r["id"] for r in df.orderBy(at, "id").limit(64).collect()}


@pytest.mark.parametrize("rows, trees, size", [(300, 20, 64), (300, 2, 16), (10, 5, 64), (300, 7, 300)])
def test_tree_samples_are_distinct_rows(spark, points, rows, trees, size):
    df = table(spark, points[:rows])
    samples, hand = tree_samples(df, "v", ["id"], trees, size, 1)
    assert hand == min(size, rows)
    counts = samples.groupBy("tree_id").agg(F.count("*").alias("n"), F.count_distinct("embedding").alias("d"))
    assert sorted((r["tree_id"], r["n"], r["d"]) for r in counts.collect()) == [(t, hand, hand) for t in range(trees)]


def test_identical_points_score_zero(spark):
    df = table(spark, np.ones((40, 3)))
    forest = fit_forest(df, "v", ["id"], trees=10, contamination=None)
    scored = anomaly.min_max_score(df.withColumn("raw", forest.score(spark, "v")), "raw")
    assert {r["anomaly_score"] for r in scored.collect()} == {0.0}


def test_missing_vectors_have_no_score(spark, points):
    df = table(spark, points[:50])
    forest = fit_forest(df, "v", ["id"], trees=5, contamination=None)
    mixed = df.withColumn("v", F.when(F.col("id") % 2 == 0, F.col("v")))
    found = mixed.select("id", forest.score(spark, "v").alias("raw")).collect()
    assert all((r["raw"] is None) == (r["id"] % 2 == 1) for r in found)


@pytest.mark.parametrize("sort_rows", [10, 100, 100_000])
@pytest.mark.parametrize("kind", ["normal", "repeated", "skewed"])
def test_quantiles_are_exact(spark, sort_rows, kind):
    rng = np.random.default_rng(2)
    x = {
        "normal": rng.normal(size=1501),
        "repeated": rng.integers(0, 4, size=1500).astype(float),
        "skewed": np.exp(rng.normal(size=1500) * 8),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(4)
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    found = anomaly.quantiles(df, "v", shares, sort_rows)
    np.testing.assert_allclose(found, np.percentile(x, [s * 100 for s in shares]), rtol=1e-12)


def test_infinite_values_are_ranks_at_the_ends(spark):
    x = [float(i % 60) for i in range(300)] + [float("inf")] * 3 + [float("-inf")] * 2 + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in x], "v double").repartition(4)
    ordered = sorted(v for v in x if v is not None and v == v)
    shares = [0.0, 0.001, 0.01, 0.5, 0.98, 0.999, 1.0]
    for rows in (10, 100_000):
        found = anomaly.quantiles(df, "v", shares, rows)
        assert found[0] == found[1] == float("-inf") and found[-1] == found[-2] == float("inf")
        np.testing.assert_allclose(found[2:5], [np.interp(s * 304, range(305), ordered) for s in shares[2:5]])


def test_approximate_quantiles_are_near(spark):
    df = spark.range(20_001).selectExpr("cast(id AS double) AS v").repartition(5)
    found = anomaly.approximate_quantiles(df, "v", [0.01, 0.5, 0.99])
    assert all(abs(a - b) <= 20 for a, b in zip(found, [200, 10_000, 19_800], strict=True))
    with pytest.raises(ValueError):
        anomaly.approximate_quantiles(df.where("false"), "v", [0.5])


def test_quantiles_take_few_passes(spark, monkeypatch):
    """However many ranks and however steep the distribution: two passes narrow all ranges at once."""
    jobs = []
    original = anomaly.DataFrame.agg
    monkeypatch.setattr(anomaly.DataFrame, "agg", lambda self, *e: jobs.append(1) or original(self, *e))
    df = spark.range(200_000).selectExpr("pow(1.001, id % 100000) AS v")
    anomaly.quantiles(df, "v", [0.01, 0.3, 0.5, 0.99], 1_000)
    assert len(jobs) <= 6


def test_error_scores(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "e double")
    found = [r["anomaly_score"] for r in anomaly.error_score(df, "e").orderBy("e").collect()]
    assert found[0] == found[1] == 0 and found[99] == found[100] == 1 and found[50] == pytest.approx(0.5)
    flat = spark.createDataFrame([(2.0,)] * 5, "e double")
    assert {r["anomaly_score"] for r in anomaly.error_score(flat, "e").collect()} == {0.0}
    one = spark.createDataFrame([(2.0,)], "e double")
    assert anomaly.min_max_score(one, "e").first()["anomaly_score"] == 0.0
    frozen = anomaly.min_max_score(one, "e", low=0.0, high=4.0)
    assert frozen.first()["anomaly_score"] == 0.5


def coalition_sums(x, background, forest, dimensions):
    """Shapley values of log2(score) by their definition: every coalition of dimensions."""
    tables = forest.tables()
    values = {}
    for mask in range(1 << dimensions):
        own = [(mask >> d) & 1 for d in range(dimensions)]
        values[mask] = np.log2(raw_scores(np.where(own, x, background), tables)).mean()
    out = np.zeros(dimensions)
    for d in range(dimensions):
        for mask in range(1 << dimensions):
            if not mask >> d & 1:
                k = mask.bit_count()
                out[d] += factorial(k) * factorial(dimensions - k - 1) / factorial(dimensions) * (values[mask | 1 << d] - values[mask])
    return out


def test_exact_attributions_equal_the_sum_over_all_coalitions(spark):
    pick = np.random.default_rng(4)
    points = pick.normal(size=(120, 10)).round(1)  # ties with thresholds and each other
    points[7] = points[8]
    df = table(spark, points)
    forest = fit_forest(df, "v", ["id"], trees=12, sample_size=64, contamination=None)
    found = attribution.exact_shapley_values(df, "v", ["id"], forest, 10, background_rows=15)
    phi = found.toPandas().pivot(index="id", columns="dimension", values="phi").to_numpy()
    background = np.array([r["v"] for r in attribution.background_sample(df, "v", ["id"], 15).collect()])
    for i in (0, 7, 8, 55, 119):
        assert phi[i] == pytest.approx(coalition_sums(points[i], background, forest, 10), abs=1e-9)
    assert (phi[7] == phi[8]).all()
    whole = np.log2(raw_scores(points, forest.tables())) - np.log2(raw_scores(background, forest.tables())).mean()
    assert phi.sum(axis=1) == pytest.approx(whole, abs=1e-9)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_exact_attributions_of_rows_without_an_embedding(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [2.0, 1.0]), (4, [0.0, 1.0])], "id long, v array<double>")
    forest = fit_forest(df, "v", ["id"], trees=5, contamination=None)
    found = {(r["id"], r["dimension"]): r["phi"] for r in attribution.exact_shapley_values(df, "v", ["id"], forest, 2).collect()}
    assert len(found) == 8 and found[2, 0] is found[2, 1] is None
    assert found[3, 1] == 0 and found[3, 0] > 0 > found[1, 0]
    empty = df.where("false")
    with pytest.raises(ValueError):
        attribution.exact_shapley_values(empty, "v", ["id"], forest, 2)


def test_attributions_add_up_along_each_path(spark, points):
    df = table(spark, points[:20, :4])
    forest = fit_forest(df, "v", ["id"], trees=20, contamination=None)
    found = attribution.shapley_values(df, "v", ["id"], forest, 4, background_rows=1, permutations=5)
    total = {r["id"]: r["s"] for r in found.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    raw = {r["id"]: r["raw"] for r in df.select("id", forest.score(spark, "v").alias("raw")).collect()}
    gaps = {round(raw[i] - total[i], 9) for i in raw}  # all equal the one background row's score
    assert len(gaps) == 1 and gaps.pop() in {round(v, 9) for v in raw.values()}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    ranked = attribution.importance(found).collect()
    assert len(ranked) == 4 and [r["mean_abs_shap"] for r in ranked] == sorted(
        (r["mean_abs_shap"] for r in ranked), reverse=True
    )


@pytest.fixture(scope="module")
def fleet(spark):
    rows = random_rows(9, {d: 70 for d in "abcdef"}, missing=0.05)
    return frame(spark, rows).cache()


def test_models_round_trip_and_shape_check(spark, fleet, tmp_path):
    models = plans.fit_models(fleet, trees=10)
    models.save(spark, str(tmp_path / "m"))
    loaded = plans.Models.load(spark, str(tmp_path / "m"))
    assert loaded.scaler == models.scaler
    a, b = (
        plans.build_fingerprint(fleet, m).orderBy("gpu_id").select("gpu_id", "anomaly_score").collect()
        for m in (models, loaded)
    )
    assert [r["gpu_id"] for r in a] == list("abcdef")
    assert [r["anomaly_score"] for r in a] == pytest.approx([r["anomaly_score"] for r in b])
    other = features.WindowScaler(models.scaler.mean, models.scaler.std, WindowSpec(10, 5))
    with pytest.raises(ValueError):
        plans.Models(other, models.embedding, models.forest)


@pytest.mark.parametrize("method", plans.METHODS)
def test_fingerprint_does_not_depend_on_the_layout(spark, fleet, method):
    from gaugeworks.operators.series import measure

    models = plans.fit_models(fleet, method=method, **({"trees": 10} if method == plans.FOREST else {}))
    cut = measure(fleet, long_rows=20, span_rows=15)
    assert cut.is_cut
    a, b = (
        plans.build_fingerprint(fleet, models, method, layout=l).orderBy("gpu_id").toPandas()
        for l in (SeriesLayout(), cut)
    )
    assert len(a) == 6 and a["anomaly_score"].between(0, 1).all()
    for column in a.columns[4:]:
        assert list(a[column]) == pytest.approx(list(b[column])) if column in STAT_COLUMNS else True
    np.testing.assert_allclose(a["anomaly_score"], b["anomaly_score"], atol=1e-6)


def test_frozen_limits_score_one_device_like_the_whole_batch(spark, fleet):
    models = plans.fit_models(fleet, method=plans.DEVIATION)
    limits = (0.0, 3.0)
    whole = plans.build_fingerprint(fleet, models, plans.DEVIATION, limits=limits)
    single = plans.build_fingerprint(fleet.where("gpu_id = 'c'"), models, plans.DEVIATION, limits=limits)
    assert single.first()["anomaly_score"] == pytest.approx(
        whole.where("gpu_id = 'c'").first()["anomaly_score"]
    )


def test_too_little_history(spark, fleet):
    models = plans.fit_models(fleet, method=plans.DEVIATION)
    short = fleet.orderBy("timestamp").limit(10)
    assert plans.build_fingerprint(short, models, plans.DEVIATION).count() == 0
    with pytest.raises(ValueError):
        plans.fit_models(short, method=plans.DEVIATION)


def test_scaler_round_trip(spark, fleet, tmp_path):
    scaler = plans.fit_models(fleet, method=plans.DEVIATION).scaler
    there = scaler.inverse(scaler.transform(fleet.na.fill(1.0))).toPandas()
    back = fleet.na.fill(1.0).toPandas()
    np.testing.assert_allclose(there[list(METRICS)], back[list(METRICS)], rtol=1e-9, atol=1e-9)
    flat = features.WindowScaler({"gpu_util": 5.0}, {"gpu_util": 0.0})
    assert spark.sql("SELECT 7D AS gpu_util").select(flat.scaled("gpu_util")).first()[0] == 2.0


def test_classifier_and_forecaster_beat_guessing(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        label = i % 4
        rows.append((i, label, [label * 3 + float(rng.normal()) for _ in range(5)]))
    df = spark.createDataFrame(rows, "id int, label int, features array<double>")
    held = features.is_validation(["id"], percent=25)
    model = supervised.fit_classifier(df.where(~held), inputs=5)
    scored = supervised.classify(model, df.where(held))
    assert evaluation.accuracy(scored, prediction="predicted_label").first()[0] > 0.7
    pairs = spark.createDataFrame(
        [(float(i), [float(i), float(i % 7)], [2.0 * i, 3.0 * (i % 7), 1.0]) for i in range(100)],
        "i double, x array<double>, y array<double>",
    )
    forecaster = supervised.fit_forecaster(pairs, outputs=3)
    forecaster.save(spark, str(tmp_path / "forecaster"))
    assert supervised.DemandForecaster.load(spark, str(tmp_path / "forecaster")) == forecaster
    forecast = forecaster.forecast(pairs)
    assert evaluation.mean_squared_error(forecast, "y", "forecast").first()[0] < 0.1


def test_split_is_stable_and_near_its_share(spark):
    df = spark.range(5000)
    a = df.where(features.is_validation(["id"])).count()
    assert a == df.repartition(5).where(features.is_validation(["id"])).count()
    assert 0.12 < a / 5000 < 0.18


def test_detection_trials(spark):
    trials = spark.createDataFrame(
        [(0, "gpu-010;gpu-018", "gpu-010;gpu-018"), (1, "", "gpu-1"), (2, "a;b", "b;c"), (3, None, "")],
        "trial int, actual string, flagged string",
    )
    counts = evaluation.trial_counts(trials, "actual", "flagged", "trial")
    assert [tuple(r) for r in counts.orderBy("trial").collect()] == [
        (0, 2, 0, 0), (1, 0, 1, 0), (2, 1, 1, 1), (3, 0, 0, 0)
    ]
    total = evaluation.precision_recall(counts).first()
    assert (total["precision"], total["recall"]) == (pytest.approx(3 / 5), pytest.approx(3 / 4))
    empty = evaluation.precision_recall(counts.where("false")).first()
    assert empty["precision"] is None


def test_settle_uses_the_configured_folder(spark, tmp_path):
    from gaugeworks.operators import store

    found = settle(spark.range(3))
    assert found.count() == 3
    assert spark.conf.get("spark.checkpoint.dir") in store.own_folder(spark)
    assert found.inputFiles()[0].removeprefix("file://").startswith(store.own_folder(spark).removeprefix("file:"))


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_moments_keep_their_digits_far_from_zero(spark, offset):
    pick = np.random.default_rng(3)
    points = pick.normal(size=(4000, 5)) * [1, 2, 0.5, 1, 3] + offset
    points[:, 3] = points[:, 0] * 0.5 + offset
    points[:, 4] = offset  # constant
    found = moments.vector_moments(table(spark, points).repartition(5), "v")
    assert found.count == 4000
    np.testing.assert_allclose(found.mean, points.mean(axis=0), rtol=1e-12, atol=1e-12)
    # The points themselves are rounded; numpy's two passes over them are the measure.
    np.testing.assert_allclose(found.covariance, np.cov(points.T, bias=True), rtol=1e-9, atol=1e-9)
    spec = WindowSpec(5, 1)
    scaler = features.scaler_of_moments(found, spec, ("x",))
    assert scaler.mean["x"] == pytest.approx(points.mean(), rel=1e-12)
    assert scaler.std["x"] == pytest.approx(points.std(), rel=1e-9)


def test_constant_metrics_have_no_spread(spark):
    points = np.full((50, 4), 0.1) + [0, 0, 1e9, 1e9]
    found = moments.vector_moments(table(spark, points), "v")
    scaler = features.scaler_of_moments(found, WindowSpec(2, 1), ("x", "y"))
    assert scaler.std["x"] > 0  # columns 0 and 2 are the two samples of x
    flat = features.scaler_of_moments(moments.vector_moments(table(spark, np.full((50, 4), 0.1)), "v"), WindowSpec(2, 1), ("x", "y"))
    assert flat.std == {"x": 0.0, "y": 0.0}


def test_forecaster_is_exact_far_from_zero(spark):
    pick = np.random.default_rng(6)
    x = pick.normal(size=(500, 3)) + 1e7
    y = (x - 1e7) @ [[2.0], [-1.0], [0.5]] + 1e7
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>")
    model = supervised.fit_forecaster(df, 1, regularization=0.0)
    assert model.weights[0] == pytest.approx([2.0, -1.0, 0.5], rel=1e-6)


def test_stored_moments_of_days_equal_the_union(spark, tmp_path):
    pick = np.random.default_rng(9)
    points = pick.normal(size=(900, 6)) @ pick.normal(size=(6, 6)) + 1e5
    points[pick.random(points.shape) < 0.05] = np.nan
    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    path = str(tmp_path / "moments")
    for day, own in zip(days, np.split(points, [100, 650]), strict=True):
        moments.store_moments(moments.moment_rows(table(spark, own), "v"), path, day)
    moments.store_moments(moments.moment_rows(table(spark, points[100:650]), "v"), path, days[1])  # again: replaced
    whole = moments.vector_moments(table(spark, points), "v")
    merged = moments.moments_of(moments.stored_moments(spark, path))
    assert merged.count == whole.count
    np.testing.assert_allclose(merged.covariance, whole.covariance, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(merged.mean, whole.mean, rtol=1e-12)
    later = moments.stored_moments(spark, path, first=days[1])
    np.testing.assert_allclose(moments.moments_of(later).covariance, moments.vector_moments(table(spark, points[100:]), "v").covariance, rtol=1e-9, atol=1e-9)
    assert "PartitionFilters: [isnotnull(day" in later._jdf.queryExecution().executedPlan().toString()
    known = (~np.isnan(points)).astype(float)
    n = known.T @ known  # pandas divides by one less
    np.testing.assert_allclose(whole.covariance, pd.DataFrame(points).cov().to_numpy() * (n - 1) / n, rtol=1e-9)


def ring(n, seed):
    """Points around a circle, and as many that lie off it: inside and outside."""
    pick = np.random.default_rng(seed)
    angle = pick.uniform(0, 2 * np.pi, n)
    on = np.stack([np.cos(angle), np.sin(angle)], axis=1) * (3 + pick.normal(size=n)[:, None] * 0.05)
    off = np.stack([np.cos(angle), np.sin(angle)], axis=1) * np.where(np.arange(n) % 2, 0.4, 5.5)[:, None]
    return on, off


def separation(spark, model, linear, on, off):
    """Share of pairs (point on, point off) in which the one off has the larger error."""
    def ranks(a, b):
        return float((np.array(a)[:, None] < np.array(b)[None, :]).mean())

    def errors(points):
        df = linear.transform(table(spark, points), "v")
        df = model.error(df.withColumn("linear", linear.reconstruction_error("v")), "v")
        rows = df.orderBy("id").collect()
        return [r["error"] for r in rows], [r["linear"] for r in rows]

    (curved_on, flat_on), (curved_off, flat_off) = errors(on), errors(off)
    return ranks(curved_on, curved_off), ranks(flat_on, flat_off)


def test_fourier_components_follow_a_curve(spark, tmp_path):
    on, off = ring(400, 1)
    model = fourier.fit_fourier(table(spark, on), "v", features=128, components=12, width=2.0)
    linear = fit_pca(table(spark, on), "v", 1)
    curved, flat = separation(spark, model, linear, *ring(150, 2))
    assert curved > 0.95 and flat < 0.8
    model.save(spark, str(tmp_path / "fourier"))
    again = fourier.FourierModel.load(spark, str(tmp_path / "fourier"))
    rows = table(spark, on[:20])
    assert [r["error"] for r in again.error(rows, "v").orderBy("id").collect()] == pytest.approx([r["error"] for r in model.error(rows, "v").orderBy("id").collect()])


def test_fourier_features_equal_numpy_and_skip_incomplete_rows(spark):
    pick = np.random.default_rng(4)
    points = pick.normal(size=(30, 3))
    model = fourier.drawn_waves(3, 5, 1.5, 7)
    df = table(spark, points).unionByName(spark.createDataFrame([(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("inf"), 0.0])], "id bigint, v array<double>"))
    found = {r["id"]: r["features"] for r in model.features(df, "v").collect()}
    expected = np.sqrt(2 / 5) * np.cos(points @ np.array(model.weights).T + model.phases)
    np.testing.assert_allclose(np.array([found[i] for i in range(30)]), expected, atol=1e-12)
    assert found[90] is found[91] is found[92] is None
    wide = fourier.drawn_waves(3, 4000, 1.5, 7)  # products approximate the kernel
    values = np.sqrt(2 / 4000) * np.cos(points[:2] @ np.array(wide.weights).T + wide.phases)
    assert values[0] @ values[1] == pytest.approx(np.exp(-((points[0] - points[1]) ** 2).sum() / (2 * 1.5**2)), abs=0.06)
    with pytest.raises(ValueError):
        model.error(df, "v")


def test_a_batch_of_window_vectors_is_not_copied_whole():
    """10,000 window vectors are 31 MB; every step of a projection had a copy or two of them in each worker."""
    import tracemalloc

    import pyarrow as pa

    from gaugeworks.operators import vectors

    points = np.random.default_rng(1).normal(size=(10_000, 390))
    column = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), 390).cast(pa.list_(pa.float64()))
    tracemalloc.start()
    found = vectors.projected(column, lambda x: (x - 1.0) @ np.ones((390, 8)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    np.testing.assert_allclose(found.flatten().to_numpy().reshape(-1, 8)[:, 0], (points - 1.0).sum(axis=1))


def test_vectors_that_are_missing_or_incomplete_have_no_projection():
    import pyarrow as pa

    from gaugeworks.operators import vectors

    rows = [None, [1.0, 2.0], [None, 3.0], [4.0, 5.0], [float("nan"), 1.0], [float("inf"), 0.0]]
    column = pa.array(rows * 3, pa.list_(pa.float64())).slice(3, 9)
    plain = vectors.projected(column, lambda x: x.sum(axis=1, keepdims=True)).to_pylist()
    assert plain == [[9.0], None, [float("inf")], None, [3.0], None, [9.0], None, [float("inf")]]
    finite = vectors.projected(column, lambda x: x.sum(axis=1, keepdims=True), np.isfinite).to_pylist()
    assert finite == [[9.0], None, None, None, [3.0], None, [9.0], None, None]
    assert [len(x) for _, x in vectors.matrices(column, 32)] == [2, 2, 2, 2]
    assert vectors.projected(column.slice(0, 0), lambda x: x).to_pylist() == []
