import time
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablelab.functions.distributions import add_normal_quantile, chi_square_tail, shapiro_wilk
from tablelab.operators import features, gram, models, ols, stats


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    n = 400
    level = np.array([f"v{i:02d}" for i in range(26)])
    data = pd.DataFrame(
        {
            "k": np.arange(n),
            "a": np.where(rng.random(n) < 0.1, np.nan, rng.normal(3, 2, n)),
            "b": rng.exponential(size=n),
            "c": rng.choice(["p", "q", "r"], n),
            "d": np.where(rng.random(n) < 0.1, None, level[(rng.random(n) ** 2 * 26).astype(int)]),
        }
    )
    data["y"] = 5 + data["a"].fillna(3) + 2 * data["b"] + (data["c"] == "q") * 3 + rng.normal(size=n) * (1 + data["b"])
    return data, spark.createDataFrame(data, "k bigint, a double, b double, c string, d string, y double").repartition(3)


def encode(data: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    """The encoding by hand: impute, scale, at most 20 outputs per category."""
    cols, names = [], []
    for c in ("a", "b"):
        v = data[c].fillna(data[c].median())
        cols.append(((v - v.mean()) / v.std(ddof=0)).to_numpy())
        names.append(f"numeric__{c}")
    for c in ("c", "d"):
        counts = data[c].value_counts()
        fill = min(counts[counts == counts.max()].index)
        v = data[c].fillna(fill)
        counts = v.value_counts()
        ranked = sorted(sorted(counts.index, reverse=True), key=lambda x: -counts[x])
        kept = sorted(ranked if len(ranked) <= 20 else ranked[:19])
        for level in kept:
            cols.append((v == level).astype(float).to_numpy())
            names.append(f"category__{c}_{level}")
        if len(ranked) > 20:
            cols.append((~v.isin(kept)).astype(float).to_numpy())
            names.append(f"category__{c}_infrequent_sklearn")
    return np.column_stack(cols), names


FEATURES = ["a", "b", "c", "d"]


def test_feature_matrix(frame):
    data, df = frame
    spec = features.FeatureSpec.fit(df, FEATURES, "y")
    want, names = encode(data)
    assert spec.names == names
    got = spec.encode(df).orderBy("k").select(*spec.slots).toPandas().to_numpy()
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_seen_and_new_levels(frame, spark, monkeypatch, limit):
    monkeypatch.setattr(features, "SEEN_LEVELS", limit)
    data, df = frame
    spec = features.FeatureSpec.fit(df, ["d"], "y")
    rare = sorted(set(data["d"].dropna()) - set(spec.category[0].levels))[0]
    test = spark.createDataFrame([(1, rare), (2, "never"), (3, spec.category[0].levels[0]), (4, None)], "k int, d string")
    got = spec.encode(spec.mark_seen(test, df), scoring=True).orderBy("k").select(*spec.slots).toPandas().to_numpy()
    assert got[0].argmax() == spec.width - 1 and got[0].sum() == 1
    assert got[1].sum() == 0
    assert got[2][0] == 1 and got[2].sum() == 1
    assert got[3].sum() == 1


@pytest.mark.parametrize("degree", [1, 2])
def test_gram_paths_agree(frame, monkeypatch, degree):
    _, df = frame
    spec = features.FeatureSpec.fit(df, ["a", "b", "c"], "y")
    monkeypatch.setattr(gram, "NARROW", 100)
    flat = gram.grams(df, spec, "y", 5.0, degree, F.col("k") % 3)
    monkeypatch.setattr(gram, "NARROW", 0)
    arrow = gram.grams(df, spec, "y", 5.0, degree, F.col("k") % 3)
    assert flat.keys() == arrow.keys() == {0, 1, 2}
    for f in flat:
        assert np.allclose(flat[f].cross, arrow[f].cross)


@pytest.mark.parametrize("names", [["a", "b"], ["b", "c"], FEATURES])
def test_ols_equals_pseudo_inverse(frame, names):
    data, df = frame
    z, all_names = encode(data)
    keep = [i for i, n in enumerate(all_names) if n.split("__")[1][0] in names]
    z = z[:, keep]
    x = np.column_stack([np.ones(len(z)), z])
    y = data["y"].to_numpy()
    beta = np.linalg.pinv(x) @ y
    fit = ols.ols_fit(df, "y", names)
    assert np.allclose(fit.params, beta, atol=1e-7)
    e = y - x @ beta
    n, rank = len(y), np.linalg.matrix_rank(x)
    s = fit.statistics()
    r2 = 1 - e @ e / ((y - y.mean()) ** 2).sum()
    assert fit.rank == rank and s["r2"] == pytest.approx(r2, abs=1e-9)
    assert s["adjusted_r2"] == pytest.approx(1 - (1 - r2) * (n - 1) / (n - rank), abs=1e-9)
    loglik = -n / 2 * (np.log(2 * np.pi) + np.log(e @ e / n) + 1)
    assert s["aic"] == pytest.approx(-2 * loglik + 2 * rank) and s["bic"] == pytest.approx(-2 * loglik + np.log(n) * rank)

    h = np.einsum("ij,jk,ik->i", x, np.linalg.pinv(x.T @ x), x)
    cooks = e**2 / (x.shape[1] * (e @ e / (n - rank))) * h / (1 - h) ** 2
    rows = ols.cooks_distance(fit, df).orderBy("k").toPandas()
    assert np.allclose(rows["fitted"], x @ beta, atol=1e-7)
    assert np.allclose(rows["leverage"], h, atol=1e-9) and np.allclose(rows["cooks"], cooks, atol=1e-9)

    e2 = e**2
    g = np.linalg.pinv(x) @ e2
    lm = n * (1 - ((e2 - x @ g) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum())
    found = ols.influence(fit, df)
    assert found.influential == (cooks > 4 / n).sum()
    assert found.lm == pytest.approx(lm, rel=1e-7)
    assert found.breusch_pagan_p == pytest.approx(chi_square_tail(lm, x.shape[1] - 1), rel=1e-6)

    values = dict(ols.vif_values(fit))
    for j, name in enumerate([all_names[i] for i in keep][:40]):
        others = np.delete(z, j, axis=1)
        constant = np.linalg.matrix_rank(np.column_stack([others, np.ones(n)])) == np.linalg.matrix_rank(others)
        rss = ((z[:, j] - others @ (np.linalg.pinv(others) @ z[:, j])) ** 2).sum()
        tss = ((z[:, j] - z[:, j].mean()) ** 2).sum() if constant else (z[:, j] ** 2).sum()
        if rss < 1e-8 * tss:
            assert values[name] is None, name
        else:
            assert values[name] == pytest.approx(tss / rss, rel=1e-6), name


def test_shapiro_known_values():
    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (round(w, 5), round(p, 5)) == (0.78881, 0.0067)
    w, p = shapiro_wilk([0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66])
    assert w == pytest.approx(0.900473, abs=1e-6) and p == pytest.approx(0.042090, abs=1e-5)
    assert shapiro_wilk([1, 2]) is None and shapiro_wilk([1, 1, 1]) == (1.0, 1.0)


def test_normal_quantile(spark):
    p = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.7, 0.999, 1 - 1e-9]
    got = [r["z"] for r in add_normal_quantile(spark.createDataFrame([(v,) for v in p], "p double"), "p", "z").collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(v) for v in p], rtol=1e-9, atol=1e-12)


def test_chi_square_tail():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-12)
    assert chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-12)
    assert chi_square_tail(0.0, 3) == 1.0


@pytest.mark.parametrize("spread", [65536, 7])
def test_qq_points_rank_ties_and_theory(spark, monkeypatch, spread):
    monkeypatch.setattr(ols, "SPREAD", spread)
    rng = np.random.default_rng(4)
    v = np.concatenate([np.full(300, 0.5), rng.normal(size=700)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(4)
    got = ols.qq_points(df, "v").toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(1, 1001))
    assert np.allclose(got["sample"], np.sort((v - v.mean()) / v.std()))
    assert np.allclose(got["theoretical"], [NormalDist().inv_cdf(i / 1001) for i in range(1, 1001)], atol=1e-9)


def _fitted(df, names):
    spec = features.FeatureSpec.fit(df, names, "y")
    by_fold = gram.grams(df, spec, "y", spec.target.mean, fold=F.col("k") % 4)
    parts = list(by_fold.values())
    return spec, by_fold, sum(parts[1:], parts[0])


def test_ridge_equals_brute_force_leave_one_out(frame):
    data, df = frame
    spec, _, whole = _fitted(df, ["a", "b", "c"])
    z = encode(data)[0][:, : spec.width]
    y = data["y"].to_numpy()
    alphas = (0.1, 3.0, 50.0)

    def solve(z, y, alpha):
        m = z.mean(axis=0)
        w = np.linalg.solve((z - m).T @ (z - m) + alpha * np.eye(z.shape[1]), (z - m).T @ (y - y.mean()))
        return w, y.mean() - m @ w

    errors = []
    for alpha in alphas:
        total = 0.0
        for i in range(len(y)):
            w, b = solve(np.delete(z, i, axis=0), np.delete(y, i), alpha)
            total += (y[i] - z[i] @ w - b) ** 2
        errors.append(total)
    model = models.fit_ridge_cv(spec, whole, df, "y", alphas)
    assert model.alpha == alphas[int(np.argmin(errors))]
    w, b = solve(z, y, model.alpha)
    assert np.allclose(model.weights, w, atol=1e-8) and model.constant == pytest.approx(b)


@pytest.mark.parametrize("ratio", [1.0, 0.5])
def test_penalised_fits_are_optimal_and_agree_with_spark(frame, ratio):
    data, df = frame
    spec, by_fold, whole = _fitted(df, ["a", "b", "c"])
    model = models.fit_elastic_net_cv(spec, by_fold, models.NET_ALPHAS, (ratio,))
    xx, xy, _ = whole.centred()
    n, w, a = whole.n, model.weights, model.alpha
    slope = xy / n - xx @ w / n - a * (1 - ratio) * w
    assert np.all(np.abs(slope) <= a * ratio * (1 + 1e-5) + 1e-9)
    assert np.allclose(slope[w != 0], a * ratio * np.sign(w[w != 0]), atol=1e-6)
    l1, l2 = a * ratio, a * (1 - ratio) * float(data["y"].std(ddof=0))
    rows = models.encoded_vector(df, spec)
    spark_fit = LinearRegression(
        featuresCol="_features", labelCol="y", regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2), standardization=False, tol=1e-12, maxIter=2000
    ).fit(rows)
    assert np.allclose(rows.count(), n)
    z = encode(data)[0][:, : spec.width]
    ours, theirs = z @ w + model.constant, z @ spark_fit.coefficients.toArray() + spark_fit.intercept
    assert np.allclose(ours, theirs, atol=1e-3)


def test_fold_error_picks_the_same_penalty_as_refits(frame):
    data, df = frame
    spec, by_fold, whole = _fitted(df, ["a", "b", "c"])
    z, y, fold = encode(data)[0][:, : spec.width], data["y"].to_numpy(), data["k"].to_numpy() % 4
    alphas = np.logspace(-3, 0.5, 8)
    errors = []
    for alpha in alphas:
        per = []
        for f in range(4):
            t = fold != f
            m, my = z[t].mean(axis=0), y[t].mean()
            zc, yc, n = z[t] - m, y[t] - my, t.sum()
            w = np.zeros(z.shape[1])
            for _ in range(3000):
                for j in range(len(w)):
                    pull = zc[:, j] @ (yc - zc @ w) / n + (zc[:, j] @ zc[:, j]) / n * w[j]
                    w[j] = np.sign(pull) * max(abs(pull) - alpha, 0) / ((zc[:, j] @ zc[:, j]) / n)
                if _ > 200:
                    break
            per.append((((y[~t] - my) - (z[~t] - m) @ w) ** 2).mean())
        errors.append(np.mean(per))
    model = models.fit_lasso_cv(spec, by_fold, alphas)
    assert model.alpha == pytest.approx(alphas[int(np.argmin(errors))])


def test_huber_is_a_local_optimum(frame):
    data, df = frame
    spec = features.FeatureSpec.fit(df, ["a", "b"], "y")
    model = models.fit_huber(spec, df, "y")
    z, y = encode(data)[0][:, :2], data["y"].to_numpy()

    def loss(w, b, s):
        r = np.abs((y - z @ w - b) / s)
        inner = np.where(r < 1.35, r**2, 2 * 1.35 * r - 1.35**2)
        return (s + inner * s).sum() + 1e-4 * (w @ w)

    scales = np.linspace(0.2, 6, 400)
    best = min(scales, key=lambda s: loss(model.weights, model.constant, s))
    base = min(loss(model.weights, model.constant, s) for s in np.linspace(best * 0.97, best * 1.03, 200))
    for step in (1e-2, -1e-2):
        for moved in ((model.weights + [step, 0], model.constant), (model.weights + [0, step], model.constant), (model.weights, model.constant + step)):
            assert min(loss(*moved, s) for s in np.linspace(best * 0.97, best * 1.03, 200)) > base


def test_polynomial_by_both_solvers(frame, monkeypatch):
    data, df = frame
    spec = features.FeatureSpec.fit(df, ["a", "b", "c"], "y")
    z = encode(data)[0][:, : spec.width]
    p = np.hstack([z] + [z[:, i : i + 1] * z[:, i:] for i in range(z.shape[1])])
    pc = p - p.mean(axis=0)
    want = data["y"].mean() + pc @ np.linalg.lstsq(pc, data["y"] - data["y"].mean(), rcond=1e-8)[0]
    exact = models.fit_poly2(spec, df, "y")
    got = exact.predict(df, "p").orderBy("k").toPandas()["p"]
    assert np.allclose(got, want, atol=1e-6)
    loose = models.fit_poly2(spec, df, "y", solver="iterative")
    assert isinstance(loose, models.VectorModel) and loose.parameters == exact.parameters
    assert np.allclose(loose.predict(df, "p").orderBy("k").toPandas()["p"], want, atol=1e-2)


@pytest.mark.parametrize("eps", [1e-4, 1e-5, 1e-6, 1e-7])
def test_nearly_collinear_columns(spark, eps):
    rng = np.random.default_rng(6)
    a, noise = rng.normal(size=400), rng.normal(size=400)
    b = a + eps * noise
    y = 3 + 2 * a + noise
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(zip(a, b, y))], "k int, a double, b double, y double")
    fit = ols.ols_fit(df.repartition(5), "y", ["a", "b"])
    z = np.column_stack([np.ones(400), (a - a.mean()) / a.std(), (b - b.mean()) / b.std()])
    beta, _, rank, _ = np.linalg.lstsq(z, y, rcond=None)
    assert fit.rank == rank == 3 and fit.statistics()["r2"] == pytest.approx(1, abs=1e-6)
    got = ols.ols_residuals(fit, df).orderBy("k").toPandas()["fitted"]
    assert np.allclose(got, z @ beta, atol=1e-5)
    others = z[:, 2:]
    left = ((z[:, 1:2] - others @ np.linalg.lstsq(others, z[:, 1:2], rcond=None)[0]) ** 2).sum()
    assert dict(ols.vif_values(fit))["numeric__a"] == pytest.approx(400 / left, rel=1e-4)
    found = {r.model: r.r2 for r in models.compare_models(df, "y", ["a", "b"], ["k"]).table.collect()}
    assert found["Linear Regression"] == pytest.approx(1, abs=1e-6) and found["Polynomial Degree 2"] == pytest.approx(1, abs=1e-6)


def test_factor_of_fewer_columns_comes_from_that_of_more(frame):
    _, df = frame
    spec = features.FeatureSpec.fit(df, ["a", "b", "c"], "y")
    more, fewer = (gram.triangle(df, spec, "y", spec.target.mean, d) for d in (2, 1))
    part = gram.leading(more, spec.width)
    assert np.allclose(part.T @ part, fewer.T @ fewer)


def test_factor_leaves_out_columns_that_cannot_differ(frame, monkeypatch):
    data, df = frame
    spec = features.FeatureSpec.fit(df, ["a", "b", "c", "d"], "y")
    merged, widths = gram.merged, []
    monkeypatch.setattr(gram, "merged", lambda blocks, width, merge: widths.append(width) or merged(blocks, width, merge))
    got = gram.triangle(df, spec, "y", spec.target.mean, 2)
    packed = df.select(*spec.compact(), (F.col("y") - spec.target.mean).alias("y")).toArrow().combine_chunks().to_batches()[0]
    x = spec.reader(2)(packed)
    z = np.column_stack([np.ones(len(x)), x, packed.column("y").to_numpy()])
    assert got.shape[1] == z.shape[1] and np.allclose(got.T @ got, z.T @ z)
    assert widths == [len(np.unique(z[:, z.any(axis=0)], axis=1).T)] and widths[0] < z.shape[1]


def test_values_are_not_worked_out_in_filters(frame):
    _, df = frame
    rows = ols.ols_residuals(ols.ols_fit(df, "y", ["a", "c"]), df)
    filters = [line for line in ols.placed(rows, "residual")[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters and not any("LN(" in line.upper() for line in filters)
    cells = stats._cells_in(df.select(F.expr("sqrt(abs(a))").alias("v")), ["v"], [stats._Bin(0, 0.1, 0.5, 0, 9, [1])], True)
    assert "Filter" not in cells._jdf.queryExecution().optimizedPlan().toString()
    assert cells.count() == sum(0.1 <= abs(r["a"]) ** 0.5 <= 0.5 for r in df.select("a").collect() if r["a"] is not None and r["a"] == r["a"])


@pytest.mark.parametrize("kind", ["independent", "correlated", "copies"])
@pytest.mark.parametrize("ratio", [1.0, 0.15])
def test_penalised_paths_are_optimal(kind, ratio):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 200))
    if kind == "correlated":
        x = rng.normal(size=(1500, 1)) + 0.3 * x
    if kind == "copies":
        x[:, 100:] = x[:, :100]
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    y = x[:, :20] @ rng.normal(size=20) + rng.normal(size=1500)
    y -= y.mean()
    xx, xy, yy = x.T @ x / 1500, x.T @ y / 1500, float(y @ y / 1500)
    alphas = sorted(models.LASSO_ALPHAS, reverse=True)
    started = time.perf_counter()
    path = models.net_path(xx, xy, yy, ratio, alphas)
    assert time.perf_counter() - started < 10
    for alpha, w in zip(alphas, path):
        pull, on = xy - xx @ w - alpha * (1 - ratio) * w, w != 0
        assert np.allclose(pull[on], alpha * ratio * np.sign(w[on]), atol=1e-8) and (np.abs(pull) <= alpha * ratio + 1e-8).all()
    if kind == "independent":
        k = 12
        other = models._descended(xx, xy, yy, alphas[k] * ratio, alphas[k] * (1 - ratio), np.zeros(200), 1e-18, 3000)
        assert np.allclose(other, path[k], atol=1e-7)


def test_more_columns_than_the_display_limits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 50))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k int, " + ", ".join(f"x{j} double" for j in range(50)))
    fit = ols.ols_fit(df, "x0", [f"x{j}" for j in range(1, 50)])
    got = dict(ols.vif_values(fit))
    assert len(got) == 49
    z = (x[:, 1:] - x[:, 1:].mean(axis=0)) / x[:, 1:].std(axis=0)
    assert np.allclose(list(got.values()), np.diag(np.linalg.inv(z.T @ z)) * 300)


@pytest.mark.parametrize("n", [3, 4, 6, 40, 7000])
def test_shapiro_of_all_rows(spark, n):
    rng = np.random.default_rng(n)
    x, e = rng.normal(size=n), rng.exponential(size=n).round(2)
    df = spark.createDataFrame([(i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(x, e))], "k int, x double, y double")
    fit = ols.ols_fit(df, "y", ["x"])
    residual = [r["residual"] for r in ols.ols_residuals(fit, df).collect()]
    got = ols.shapiro(fit, df).first()
    assert got["n"] == n and (got["w"], got["p"]) == pytest.approx(shapiro_wilk(residual), rel=1e-6, abs=1e-12)


def test_split_and_folds_are_exact(spark):
    for n in (12, 14, 100, 999):
        df = spark.createDataFrame([(f"key {i}", float(i)) for i in range(n)], "k string, x double")
        train, test = features.train_test_split(df, ["k"])
        assert test.count() == -(-n * 22 // 100) and train.count() + test.count() == n
        sizes = [r["count"] for r in features.assign_folds(df, ["k"], 5).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_comparison(frame, monkeypatch):
    data, df = frame

    def broken(*_):
        raise RuntimeError("no luck\nmore")

    monkeypatch.setattr(models, "fit_huber", broken)
    found = models.compare_models(df, "y", FEATURES, ["k"])
    rows = {r["model"]: r for r in found.table.collect()}
    assert rows["Huber Robust"]["error"] == "no luck" and rows["Huber Robust"]["rmse"] is None
    assert len(rows) == 6
    scored = found.predictions("Ridge").toPandas()
    e = scored["actual"] - scored["predicted"]
    assert rows["Ridge"]["rmse"] == pytest.approx(np.sqrt((e**2).mean()), abs=1e-5)
    assert rows["Ridge"]["mae"] == pytest.approx(e.abs().mean(), abs=1e-5)
    n, k, rss = len(e), rows["Ridge"]["parameters"], (e**2).sum()
    assert rows["Ridge"]["aic"] == pytest.approx(n * np.log(rss / n) + 2 * k, abs=1e-4)
    best = found.best().first()
    assert best["rmse"] == min(r["rmse"] for r in rows.values() if r["rmse"] is not None)
    sample = found.prediction_sample(best["model"], 10)
    assert sample.count() == 10


def test_selection_and_limits(frame, spark):
    _, df = frame
    assert features.select_features(df, "y", ["a", "y", "a"]) == ["a"]
    with pytest.raises(ValueError, match="zzz"):
        features.select_features(df, "y", ["a", "zzz"])
    assert features.select_features(df, "y") == ["k", "a", "b", "c", "d"]
    with pytest.raises(ValueError):
        features.select_features(df, "nope")
    with pytest.raises(ValueError):
        features.select_features(df.select("y"), "y")
    with pytest.raises(ValueError, match="12"):
        features.prepare_target(df.limit(11), "y", ["a"])
    texts = spark.createDataFrame([("1,000", 1), ("2", 1), (" 3 ", 1), (None, 1)], "t string, x int")
    assert sorted(r["t"] for r in features.prepare_target(texts, "t", ["x"], check=False).collect()) == [2.0, 3.0]
    assert [features.fold_count(n) for n in (5, 17, 18, 1000)] == [2, 2, 3, 5]


def test_constant_and_empty_features(spark):
    rows = [(i, float(i), 1.0, None, float(i) * 2) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, x double, c double, e double, y double")
    fit = ols.ols_fit(df, "y", ["x", "c", "e"])
    assert fit.spec.names == ["numeric__x", "numeric__c"]
    assert fit.statistics()["r2"] == pytest.approx(1.0)
    assert dict(ols.vif_values(fit))["numeric__c"] is None


def test_shapiro_by_group_equals_each_group_alone(spark):
    rng = np.random.default_rng(21)
    groups = np.where(rng.random(3000) < 0.95, "hot", rng.choice(["a", "b", None], 3000))
    values = np.where(rng.random(3000) < 0.3, 2.5, np.round(rng.exponential(size=3000), 2) - 1e3)
    rows = [(g, float(v)) for g, v in zip(groups, values)]
    rows += [("few", 1.0), ("few", 2.0), ("three", 1.0), ("three", 2.0), ("three", 5.0), *[("same", 4.0)] * 6, ("gap", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r.w, r.p) for r in ols.shapiro_by_group(df, "v", ["g"]).collect()}
    alone = {}
    for g, v in rows:
        if v is not None:
            alone.setdefault(g, []).append(v)
    assert set(got) == set(alone)
    for g, own in alone.items():
        want = shapiro_wilk(own) or (None, None)
        assert got[g][0] == len(own) and got[g][1:] == (want if want[0] is None else pytest.approx(want, rel=1e-6, abs=1e-9))


@pytest.mark.parametrize("n, points", [(50, 7), (50, 200), (1000, 100), (2, 5)])
def test_qq_grid_holds_points_of_the_whole(spark, n, points):
    rng = np.random.default_rng(n)
    values = [*np.round(rng.normal(size=n - n // 3), 1).tolist(), *[0.5] * (n // 3)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    whole = {r["rank"]: (r.theoretical, r.sample) for r in ols.qq_points(df, "v").collect()}
    got = {r["rank"]: (r.theoretical, r.sample) for r in ols.qq_grid(df, "v", points).collect()}
    steps = min(points, n) - 1
    assert set(got) == {1 + i * (n - 1) // steps for i in range(steps + 1)}
    assert all(got[r] == pytest.approx(whole[r]) for r in got)


def test_residual_sample_does_not_depend_on_partitions(frame):
    _, df = frame
    fit = ols.ols_fit(df, "y", ["a", "b"])
    one, other = (sorted(map(tuple, ols.residual_sample(fit, df.repartition(p), ["k"], 50).collect())) for p in (1, 7))
    assert [r[0] for r in one] == [r[0] for r in other] and len(one) == 50 and np.allclose(one, other)
