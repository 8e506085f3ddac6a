"""Candidate regression models, their evaluation on held-out rows, and the choice."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelab.functions.columns import col, rounded
from tablelab.operators.features import (
    FeatureSpec,
    fold_count,
    prepare_target,
    select_features,
    with_split,
)
from tablelab.operators.gram import NARROW, Gram, grams, leading, pseudo_inverse, triangle
from tablelab.operators.ols import linear_expr, singular
from tablelab.operators.stats import column_moments
from tablelab.session import dealt, materialise, small_table

# The candidates' settings.
RIDGE_ALPHAS = tuple(np.logspace(-3, 3, 30))
LASSO_ALPHAS = tuple(np.logspace(-4, 1, 36))
NET_ALPHAS = tuple(np.logspace(-4, 1, 28))
NET_RATIOS = (0.15, 0.5, 0.85)
MAX_SWEEPS = 8000
HUBER_EPSILON, HUBER_ALPHA, HUBER_ITERATIONS = 1.35, 1e-4, 800
POLY_FEATURES = 6
SHARED_WIDTH = 128  # expanded columns up to which the linear model takes its factor from that of the squares and products
RSS_FLOOR = 1e-12
PREDICTION_ROWS = 240

COMPARISON = ["candidate", "model", "rmse", "mae", "r2", "adjusted_r2", "aic", "bic", "parameters", "error"]


@dataclass
class LinearModel:
    """Weights on the encoded columns, and how they were chosen."""

    spec: FeatureSpec
    weights: np.ndarray
    constant: float
    degree: int = 1
    alpha: float | None = None
    l1_ratio: float | None = None

    @property
    def parameters(self) -> int:
        return max(1, len(self.weights))

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        if self.degree == 1:
            return df.withColumn(out, linear_expr(self.spec, self.weights, self.constant, scoring=True))
        if len(self.weights) <= NARROW:
            total = F.lit(float(self.constant))
            for z, w in zip(self.spec.products(), self.weights):
                total = total + z * F.lit(float(w))
            return self.spec.encode(df, scoring=True).withColumn(out, total).drop(*self.spec.slots)
        block, weights, constant = self.spec.reader(self.degree), self.weights, self.constant

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in batches:
                x = block(pa.RecordBatch.from_pandas(part, preserve_index=False))
                yield pd.Series(x @ weights + constant)

        return df.withColumn(out, score(F.struct(*self.spec.compact(scoring=True))))


@dataclass
class VectorModel:
    """A model fitted by Spark ML on the encoded columns."""

    spec: FeatureSpec
    fitted: LinearRegressionModel
    degree: int = 1

    @property
    def parameters(self) -> int:
        return max(1, self.fitted.coefficients.size)

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        vectors = encoded_vector(df, self.spec, self.degree, scoring=True)
        return self.fitted.setPredictionCol(out).transform(vectors).drop("_features")


def encoded_vector(df: DataFrame, spec: FeatureSpec, degree: int = 1, scoring: bool = False) -> DataFrame:
    """The rows with the encoded columns as one (sparse where it pays) vector."""
    rows = spec.encode(df, scoring)
    first = "_features" if degree == 1 else "_encoded"
    rows = VectorAssembler(inputCols=spec.slots, outputCol=first).transform(rows).drop(*spec.slots)
    if degree > 1:
        rows = PolynomialExpansion(degree=degree, inputCol=first, outputCol="_features").transform(rows).drop(first)
    return rows


def _intercept(g: Gram, weights: np.ndarray) -> float:
    return g.y_mean - float(g.sums @ weights) / g.n


def fit_linear(spec: FeatureSpec, g: Gram, degree: int = 1, factor: np.ndarray | None = None) -> LinearModel:
    """Least squares with intercept, minimum norm about the means.

    A triangular ``factor`` of the same rows keeps nearly collinear columns apart, which sums of products cannot.
    """
    if factor is None:
        xx, xy, _ = g.centred()
        w = pseudo_inverse(xx)[0] @ xy
    else:  # the first row and column belong to the constant
        left, size, right = singular(factor[1:, 1:-1])
        w = right.T @ ((left.T @ factor[1:, -1]) / size)
    return LinearModel(spec, w, _intercept(g, w), degree)


def fit_ridge_cv(
    spec: FeatureSpec, g: Gram, train: DataFrame, target: str, alphas: Sequence[float] = RIDGE_ALPHAS
) -> LinearModel:
    """Ridge with the penalty of least squared leave-one-out error.

    All penalties share one eigendecomposition; one pass over the rows sums
    the leave-one-out errors of all of them.
    """
    xx, xy, _ = g.centred()
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    inverse = 1 / (values[:, None] + np.asarray(alphas)[None, :])
    rotated = (vectors.T @ xy)[:, None] * inverse
    means, n, y_mean = g.sums / g.n, g.n, g.y_mean
    block, k, tried = spec.reader(), len(spec.compact()), len(alphas)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tried)
        for batch in batches:
            z = (block(batch) - means) @ vectors
            y = batch.column(k).to_numpy(zero_copy_only=False) - y_mean
            leverage = 1 / n + (z * z) @ inverse
            loo = (y[:, None] - z @ rotated) / (1 - leverage)
            total += (loo * loo).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(tried), pa.int32()), "e": pa.array(total)})

    rows = train.select(*spec.compact(), col(target).alias("y")).mapInArrow(errors, "i int, e double")
    found = {r["i"]: r["e"] for r in rows.groupBy("i").agg(F.sum("e").alias("e")).collect()}
    best = min(range(len(alphas)), key=lambda i: (found[i], i))
    w = vectors @ rotated[:, best]
    return LinearModel(spec, w, _intercept(g, w), alpha=float(alphas[best]))


def _optimum(xx, xy, l1: float, l2: float, w):
    """The weights that minimise w'xx w / 2 - xy'w + l1 |w| + l2 w'w / 2, by an active-set search from ``w``.

    The system of the active columns is solved with their signs fixed; a step
    stops where the first weight changes its sign, and that column leaves. When
    the signs hold, the columns that break the optimality conditions enter, all
    at once as long as that goes well. Null if the search does not end.
    """
    sign, w = np.sign(w), w.copy()
    room, rounds = 1e-9 * max(l1, 1e-12) + 1e-14, 0
    limit = 20 * len(xy) + 200
    while rounds < limit:
        rounds += 1
        on = np.flatnonzero(sign)
        if len(on):
            inner = xx[np.ix_(on, on)] + l2 * np.eye(len(on))
            try:
                best = np.linalg.solve(inner, xy[on] - l1 * sign[on])
            except np.linalg.LinAlgError:
                return None
            now = w[on]
            turned = best * sign[on] <= 0
            if turned.any():
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(turned, now / (now - best), np.inf)
                reach = np.where(turned & (now == 0), 0.0, reach)
                step = min(1.0, float(reach.min()))
                w[on] = now + step * (best - now)
                out = on[turned & (reach <= step * (1 + 1e-12))]
                w[out] = sign[out] = 0.0
                continue
            w[on] = best
        pull = xy - xx @ w - l2 * w
        over = np.where(sign == 0, np.abs(pull) - l1, -np.inf)
        if over.max(initial=-np.inf) <= room:
            return w
        # Many at once at first, one after the other where that starts to turn in circles.
        enter = np.flatnonzero(over > max(room, 0.5 * over.max())) if rounds < len(xy) else np.array([int(over.argmax())])
        sign[enter] = np.sign(pull[enter])
    return None


def _descended(xx, xy, yy: float, l1: float, l2: float, w, tolerance: float = 1e-10, sweeps: int = MAX_SWEEPS):
    """The same by coordinate descent, to a duality gap of ``tolerance`` times ``yy``: for columns that others determine exactly."""
    own, slack, w = np.diag(xx), xy - xx @ w, w.copy()
    for _ in range(sweeps):
        for j in np.flatnonzero((w != 0) | (np.abs(slack) > l1 * (1 - 1e-9))):
            pull = slack[j] + own[j] * w[j]
            after = np.sign(pull) * max(abs(pull) - l1, 0.0) / (own[j] + l2) if own[j] > 0 else 0.0
            if after != w[j]:
                slack -= (after - w[j]) * xx[:, j]
                w[j] = after
        fit = w @ xy
        residual = yy - fit - w @ slack + l2 * (w @ w)
        share = min(1.0, l1 / max(float(np.abs(slack - l2 * w).max(initial=0.0)), 1e-300))
        if residual * (1 + share**2) / 2 + l1 * np.abs(w).sum() - share * (yy - fit) <= tolerance * yy:
            break
    return w


def net_path(xx, xy, yy: float, ratio: float, alphas: Sequence[float]):
    """Elastic-net weights ``[alpha, column]`` for falling penalties, from cross products per row.

    Each minimises (y - Xw)'(y - Xw) / 2 + alpha (ratio |w| + (1 - ratio) w'w / 2). A column is
    looked at if the sequential strong rule keeps it, or if it breaks the optimality conditions of what
    the others gave; the search starts from the solution of the penalty before.
    """
    w, out = np.zeros(len(xy)), np.zeros((len(alphas), len(xy)))
    before = float(np.abs(xy).max(initial=0.0))
    for k, alpha in enumerate(alphas):
        l1, l2 = alpha * ratio, alpha * (1 - ratio)
        kept = (np.abs(xy - xx @ w) >= 2 * l1 - before) | (w != 0)
        while True:
            on = np.flatnonzero(kept)
            part = xx[np.ix_(on, on)], xy[on]
            found = _optimum(*part, l1, l2, w[on])
            if found is None:
                found = _descended(*part, yy, l1, l2, w[on])
            w = np.zeros(len(xy))
            w[on] = found
            missed = ~kept & (np.abs(xy - xx @ w) > l1 * (1 + 1e-9) + 1e-14)
            if not missed.any():
                break
            kept |= missed
        out[k], before = w, l1
    return out


def _net_paths(spark: SparkSession, sets: Sequence[Gram], ratios: Sequence[float], alphas: Sequence[float]) -> np.ndarray:
    """The paths ``[ratio, set, alpha, column]``: one task for each set of rows and ratio."""
    parts = []
    for g in sets:
        xx, xy, yy = g.centred()
        parts.append((xx / g.n, xy / g.n, yy / g.n))
    shared = spark.sparkContext.broadcast(parts)  # a matrix of the encoded columns for each fold
    count, penalties = len(sets), list(alphas)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                path = net_path(*shared.value[i % count], ratios[i // count], penalties)
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "path": pa.array([path.tobytes()], pa.binary())})

    problems = spark.range(0, count * len(ratios), 1, count * len(ratios))
    found = {r["i"]: np.frombuffer(r["path"], float) for r in problems.mapInArrow(solve, "i long, path binary").collect()}
    shared.unpersist()
    return np.stack([found[i] for i in range(len(found))]).reshape(len(ratios), count, len(penalties), -1)


def fit_elastic_net_cv(
    spec: FeatureSpec,
    by_fold: dict[int, Gram],
    alphas: Sequence[float] = NET_ALPHAS,
    ratios: Sequence[float] = NET_RATIOS,
) -> LinearModel:
    """Elastic net with the penalty of least mean squared error over the folds.

    Everything follows from one cross-product matrix per fold; the rows are
    not read again, whatever the number of penalties. The paths are worked out
    on executors, a task for each fold and ratio.
    """
    folds = [by_fold[f] for f in sorted(by_fold)]
    whole = sum(folds[1:], folds[0])
    alphas = sorted(alphas, reverse=True)  # of equal errors the stronger penalty wins
    sets = [whole - held for held in folds] + [whole]
    paths = _net_paths(SparkSession.active(), sets, ratios, alphas)
    error = np.zeros((len(ratios), len(alphas)))
    for i, (held, rest) in enumerate(zip(folds, sets)):
        w = paths[:, i]
        # squared error on the held-out rows, for y about the shift
        constants = rest.y_mean - rest.shift - w @ rest.sums / rest.n
        terms = np.concatenate([-constants[..., None], -w, np.ones((*w.shape[:2], 1))], axis=2)
        error += np.einsum("rai,ij,raj->ra", terms, held.cross, terms, optimize=True) / held.n / len(folds)
    r, a = divmod(int(np.argmin(error)), len(alphas))
    w = paths[r, -1, a]
    return LinearModel(spec, w, _intercept(whole, w), alpha=float(alphas[a]), l1_ratio=float(ratios[r]))


def fit_lasso_cv(spec: FeatureSpec, by_fold: dict[int, Gram], alphas: Sequence[float] = LASSO_ALPHAS) -> LinearModel:
    return fit_elastic_net_cv(spec, by_fold, alphas, (1.0,))


def fit_huber(spec: FeatureSpec, train: DataFrame, target: str) -> LinearModel:
    """Huber regression with a jointly fitted scale.

    The solver sees the target about its mean in units of its deviation, which
    takes far fewer passes; the penalty is scaled to match.
    """
    y = spec.target
    unit = math.sqrt(y.var_pop) or 1.0
    label = (col(target) - F.lit(y.mean)) / F.lit(unit)
    vectors = encoded_vector(train, spec).select("_features", label.alias("_label"))
    fitted = LinearRegression(
        featuresCol="_features",
        labelCol="_label",
        loss="huber",
        epsilon=HUBER_EPSILON,
        regParam=HUBER_ALPHA * unit / y.count,
        standardization=False,
        maxIter=HUBER_ITERATIONS,
        tol=1e-9,
    ).fit(vectors)
    return LinearModel(spec, fitted.coefficients.toArray() * unit, y.mean + fitted.intercept * unit)


def fit_iterative(spec: FeatureSpec, train: DataFrame, target: str, degree: int = 1) -> VectorModel:
    """Least squares on sparse vectors, for designs too wide for a cross-product matrix."""
    vectors = encoded_vector(train, spec, degree).select("_features", col(target).alias("_label"))
    fitted = LinearRegression(
        featuresCol="_features", labelCol="_label", solver="l-bfgs", standardization=False, maxIter=500, tol=1e-10
    ).fit(vectors)
    return VectorModel(spec, fitted, degree)


def fit_poly2(
    spec: FeatureSpec, train: DataFrame, target: str, factor: np.ndarray | None = None, solver: str = "exact"
) -> LinearModel | VectorModel:
    """Least squares on the encoded columns, their squares and products, from the triangular factor of the expanded rows.

    ``solver="iterative"`` for an approximate fit of very wide designs.
    """
    if solver == "iterative":
        return fit_iterative(spec, train, target, 2)
    shift = spec.target.mean
    factor = triangle(train, spec, target, shift, 2) if factor is None else factor
    names = [f"z{i}" for i in range(spec.expanded_width(2))]
    return fit_linear(spec, Gram(names, factor.T @ factor, shift), 2, factor)


def _score(sums: DataFrame) -> DataFrame:
    """RMSE, MAE, R2, adjusted R2, AIC and BIC from error sums, one row per model."""
    n, k = F.col("n").cast("double"), F.col("parameters").cast("double")
    tss = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    r2 = F.when(tss > 0, 1 - F.try_divide(F.col("sse"), tss)).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    out = sums.withColumn("_r2", r2).withColumn(
        "_fit", n * F.ln(F.try_divide(F.greatest(F.col("sse"), F.lit(RSS_FLOOR)), n))
    )
    left = n - k - 1
    adjusted = F.when(left > 0, 1 - (1 - F.col("_r2")) * F.try_divide(n - 1, left)).otherwise(F.col("_r2"))
    values = {
        "rmse": F.sqrt(F.try_divide(F.col("sse"), n)),
        "mae": F.try_divide(F.col("sae"), n),
        "r2": F.col("_r2"),
        "adjusted_r2": adjusted,
        "aic": F.col("_fit") + 2 * k,
        "bic": F.col("_fit") + k * F.ln(n),
    }
    return out.withColumns({name: rounded(v) for name, v in values.items()}).drop("_r2", "_fit")


def _error_sums(df: DataFrame, actual: str, predicted: Sequence[str], centre: float) -> list[tuple]:
    """``(n, sy, syy, sse, sae)`` per prediction column, all from one pass."""
    rows = df.select(
        (col(actual) - F.lit(float(centre))).alias("y"),
        *[(col(actual) - F.col(p)).alias(f"e{i}") for i, p in enumerate(predicted)],
    )
    y = F.col("y")
    row = rows.agg(
        F.count("*"),
        F.sum(y),
        F.sum(y * y),
        *[s for i in range(len(predicted)) for e in [F.col(f"e{i}")] for s in (F.sum(e * e), F.sum(F.abs(e)))],
    ).first()
    return [(*row[:3], row[3 + 2 * i], row[4 + 2 * i]) for i in range(len(predicted))]


SUMS = "n bigint, sy double, syy double, sse double, sae double, parameters int"


def regression_metrics(df: DataFrame, actual: str, predicted: str, parameters: int) -> DataFrame:
    """Scores of a prediction column."""
    centre = column_moments(df, [actual])[actual].mean or 0.0
    sums = [(*s, parameters) for s in _error_sums(df, actual, [predicted], centre)]
    scored = _score(small_table(df.sparkSession, sums, SUMS))
    return scored.select("rmse", "mae", "r2", "adjusted_r2", "aic", "bic", "parameters")


@dataclass
class Comparison:
    """Fitted candidates with their scores on the held-out rows."""

    table: DataFrame
    models: dict[str, LinearModel | VectorModel]
    train: DataFrame
    test: DataFrame
    spec: FeatureSpec
    target: str
    key: tuple[str, ...]

    def best(self) -> DataFrame:
        return best_model(self.table)

    def predictions(self, model: str) -> DataFrame:
        scored = self.models[model].predict(self.test, "predicted")
        return scored.select(*[col(k) for k in self.key], col(self.target).alias("actual"), "predicted")

    def prediction_sample(self, model: str, rows: int = PREDICTION_ROWS) -> DataFrame:
        """The first held-out rows in key order, for a chart."""
        first = self.predictions(model).orderBy(*[col(k) for k in self.key]).limit(rows)
        return first.select("actual", "predicted")


def best_model(table: DataFrame) -> DataFrame:
    """The candidate of least RMSE, the earlier one on a tie."""
    return table.filter("rmse is not null").orderBy("rmse", "candidate").limit(1)


def _train_sums(train: DataFrame, spec: FeatureSpec, target: str) -> tuple[dict[int, Gram], Gram]:
    """Sums per fold and overall: one pass."""
    by_fold = grams(train, spec, target, spec.target.mean, fold=F.col("_fold"))
    parts = list(by_fold.values())
    return by_fold, sum(parts[1:], parts[0])


def compare_models(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str]) -> Comparison:
    """Fit every candidate on the training rows and score all of them in one pass.

    The model's columns are written to the shared folder once, training and
    test rows apart.

    A candidate that fails keeps its row, with the reason.
    """
    features = select_features(df, target, features)
    rows = prepare_target(df, target, features, key)
    # Read many times from here on, so the split and the folds are worked out once and written.
    rows = with_split(rows, key)
    rows = materialise(dealt(rows), "model-rows", ["_test"])
    train, test = rows.filter(~F.col("_test")), rows.filter("_test")
    spec = FeatureSpec.fit(train, features, target)
    if not spec.width:
        raise ValueError("no feature column holds a value")
    shift = spec.target.mean
    by_fold, whole = _train_sums(train, spec, target)
    expanded = len(features) <= POLY_FEATURES

    @functools.cache
    def factor(degree: int) -> np.ndarray:
        """One pass gives the factors of both degrees where the expanded columns are few."""
        if degree == 1 and expanded and spec.expanded_width(2) <= SHARED_WIDTH:
            return leading(factor(2), spec.width)
        return triangle(train, spec, target, shift, degree)

    candidates: list[tuple[str, Callable]] = [
        ("Linear Regression", lambda: fit_linear(spec, whole, factor=factor(1))),
        ("Ridge", lambda: fit_ridge_cv(spec, whole, train, target)),
        ("LASSO", lambda: fit_lasso_cv(spec, by_fold)),
        ("ElasticNet", lambda: fit_elastic_net_cv(spec, by_fold)),
        ("Huber Robust", lambda: fit_huber(spec, train, target)),
    ]
    if expanded:
        candidates.append(("Polynomial Degree 2", lambda: fit_poly2(spec, train, target, factor(2))))

    models: dict[str, LinearModel | VectorModel] = {}
    errors: dict[str, str] = {}
    for name, fit in candidates:
        try:
            models[name] = fit()
        except Exception as error:  # a failed candidate is a result of its own
            errors[name] = str(error).splitlines()[0][:300]
    if not models:
        raise ValueError("every candidate failed, check target and features")

    marked = spec.mark_seen(test, train)
    scored = marked
    for i, name in enumerate(models):
        scored = models[name].predict(scored, f"_p{i}")
    sums = _error_sums(scored, target, [f"_p{i}" for i in range(len(models))], shift)
    found = dict(zip(models, sums))
    rows = []
    for i, (name, _) in enumerate(candidates):
        got = found.get(name, (None,) * 5)
        rows.append((i + 1, name, *got, models[name].parameters if name in models else None, errors.get(name)))
    table = _score(small_table(df.sparkSession, rows, f"candidate int, model string, {SUMS}, error string"))
    if not any(got and got[0] for got in found.values()):
        raise ValueError("no candidate has a score: no test row can be predicted")
    return Comparison(table.select(COMPARISON), models, train, marked, spec, target, tuple(key))
