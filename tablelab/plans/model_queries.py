"""Queries over feature preparation, OLS with its diagnostics, and the candidate models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelab.operators import eda, features, findings, gram, models, ols
from tablelab.plans.analysis import analyse, report_table
from tablelab.plans.inputs import EVENT_GAPS, EVENT_LINE, event_gaps, event_line, table
from tablelab.plans.registry import query


def _word(key: str, part: int = 0) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), {8 * part + 1}, 8) AS BIGINT)"


def _fold_sql(key: str, rows: str) -> str:
    """The fold of a row among five: by rank of the second digest word, each range ending at a fifth of the rows, rounded up."""
    rank = f"row_number() OVER (ORDER BY {_word(key, 1)})"
    return " + ".join(f"CAST({rank} > ceil((SELECT count(*) FROM {rows}) * {i} / 5.0) AS INTEGER)" for i in range(1, 5))


# --- feature preparation ---------------------------------------------------------------


@query(
    "prepare_target",
    f"WITH {EVENT_GAPS} SELECT event_id, amount, TRY_CAST(score AS DOUBLE) AS score FROM gaps WHERE TRY_CAST(score AS DOUBLE) IS NOT NULL",
)
def _(spark, folder):
    return features.prepare_target(event_gaps(spark, folder), "score", ["amount"], ["event_id"])


@query("impute_median", f"WITH {EVENT_GAPS} SELECT event_id, coalesce(amount, (SELECT median(amount) FROM gaps)) AS amount FROM gaps")
def _(spark, folder):
    return features.impute_median(event_gaps(spark, folder), ["amount"]).select("event_id", "amount")


@query(
    "impute_mode",
    f"WITH {EVENT_GAPS} SELECT event_id, coalesce(kind, (SELECT kind FROM gaps WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM gaps",
)
def _(spark, folder):
    return features.impute_mode(event_gaps(spark, folder), ["kind"]).select("event_id", "kind")


@query(
    "standardize",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
    round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice FROM lineitem""",
)
def _(spark, folder):
    names = ["l_quantity", "l_extendedprice"]
    rows = features.standardize(table(spark, folder, "lineitem"), names)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in names])


TOP_BRANDS = "(SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand DESC) AS rk, count(*) OVER () AS levels FROM part GROUP BY p_brand)"


@query(
    "one_hot_topk",
    f"""SELECT CASE WHEN rk <= 19 OR levels <= 20 THEN 'category__p_brand_' || p_brand ELSE 'category__p_brand_infrequent_sklearn' END AS output,
    count(*) AS n FROM part JOIN {TOP_BRANDS} USING (p_brand) GROUP BY 1""",
)
def _(spark, folder):
    return features.one_hot_topk(table(spark, folder, "part"), "p_brand")


@query(
    "feature_matrix",
    f"""WITH {EVENT_GAPS}, filled AS (SELECT event_id, coalesce(amount, (SELECT median(amount) FROM gaps)) AS a,
      coalesce(kind, (SELECT kind FROM gaps WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS k FROM gaps)
    SELECT event_id, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS numeric__amount, CAST((k = 'click')::INT AS DOUBLE) AS category__kind_click,
      CAST((k = 'error')::INT AS DOUBLE) AS category__kind_error, CAST((k = 'purchase')::INT AS DOUBLE) AS category__kind_purchase,
      CAST((k = 'signup')::INT AS DOUBLE) AS category__kind_signup FROM filled""",
)
def _(spark, folder):
    rows = event_gaps(spark, folder)
    spec = features.FeatureSpec.fit(rows, ["amount", "kind"], "event_id")
    out = spec.encode(rows).select("event_id", *[F.col(s).alias(n) for s, n in zip(spec.slots, spec.names)])
    return out.withColumn("numeric__amount", F.round("numeric__amount", 6))


@query(
    "poly2",
    """WITH z AS (SELECT p_partkey, (p_partkey - avg(p_partkey) OVER ()) / stddev_pop(p_partkey) OVER () AS a,
      (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS b FROM part)
    SELECT p_partkey, round(a, 6) AS a, round(b, 6) AS b, round(a * a, 6) AS aa, round(a * b, 6) AS ab, round(b * b, 6) AS bb FROM z""",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    spec = features.FeatureSpec.fit(part, ["p_partkey", "p_size"], "p_retailprice")
    out = features.poly2(part, spec, ["p_partkey"]).toDF("p_partkey", "a", "b", "aa", "ab", "bb")
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(
    "train_test_split",
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY {_word('o_orderkey')}) <= (SELECT ceil(count(*) * 22 / 100.0) FROM orders) AS is_test
    FROM orders""",
)
def _(spark, folder):
    train, test = features.train_test_split(table(spark, folder, "orders"), ["o_orderkey"])
    return train.select("o_orderkey", F.lit(False).alias("is_test")).unionAll(test.select("o_orderkey", F.lit(True)))


@query("assign_folds", f"SELECT o_orderkey, {_fold_sql('o_orderkey', 'orders')} AS fold FROM orders")
def _(spark, folder):
    return features.assign_folds(table(spark, folder, "orders"), ["o_orderkey"], 5).select("o_orderkey", "fold")


# --- OLS -------------------------------------------------------------------------------

# One feature, closed forms: moments, coefficients, residuals.
ONE = f"""{EVENT_LINE}, m AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, avg(x) AS mx, var_pop(x) AS vx, avg(y) AS my,
  var_pop(y) AS vy, CAST(count(*) AS DOUBLE) AS n FROM line),
 res AS (SELECT event_id, x, i + s * x AS fitted, y - (i + s * x) AS e, 1 / n + (x - mx) * (x - mx) / (n * vx) AS h, n FROM line, m),
 rss AS (SELECT sum(e * e) AS rss FROM res),
 cook AS (SELECT event_id, fitted, e, h, e * e / (2 * (rss / (n - 2))) * h / ((1 - h) * (1 - h)) AS cooks, n FROM res, rss)"""


def _one(spark, folder):
    rows = event_line(spark, folder)
    return ols.ols_fit(rows, "y", ["x"]), rows


@query(
    "gram",
    """WITH z AS (SELECT (p_partkey - avg(p_partkey) OVER ()) / stddev_pop(p_partkey) OVER () AS a,
      (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS b, p_retailprice AS y FROM part),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * b) AS bb, sum(b * y) AS by_, sum(y * y) AS yy FROM z)
    SELECT 'const' AS "row", 'const' AS col, n AS value FROM s UNION ALL SELECT 'const', 'p_retailprice', round(y, 3) FROM s
    UNION ALL SELECT 'numeric__p_partkey', 'numeric__p_partkey', round(aa, 3) FROM s UNION ALL SELECT 'numeric__p_partkey', 'numeric__p_size', round(ab, 3) FROM s
    UNION ALL SELECT 'numeric__p_partkey', 'p_retailprice', round(ay, 3) FROM s UNION ALL SELECT 'numeric__p_size', 'numeric__p_size', round(bb, 3) FROM s
    UNION ALL SELECT 'numeric__p_size', 'p_retailprice', round(by_, 3) FROM s UNION ALL SELECT 'p_retailprice', 'p_retailprice', round(yy, 3) FROM s""",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    spec = features.FeatureSpec.fit(part, ["p_partkey", "p_size"], "p_retailprice")
    cells = gram.gram_table(part, spec, "p_retailprice").withColumn("value", F.round("value", 3))
    # the sums of standardised columns are zero but for rounding noise
    return cells.filter("row <> 'const' OR col IN ('const', 'p_retailprice')")


@query(
    "ols_coefficients",
    f"""WITH {ONE} SELECT 0 AS position, 'const' AS feature, round(my, 6) AS coefficient FROM m
    UNION ALL SELECT 1, 'numeric__x', round(s * sqrt(vx), 6) FROM m""",
)
def _(spark, folder):
    fit, rows = _one(spark, folder)
    return ols.ols_coefficients(fit, rows).withColumn("coefficient", F.round("coefficient", 6))


TWO = """c AS (SELECT var_pop(p_partkey) AS s11, var_pop(p_size) AS s22, covar_pop(p_partkey, p_size) AS s12,
  covar_pop(p_partkey, p_retailprice) AS s1y, covar_pop(p_size, p_retailprice) AS s2y, avg(p_retailprice) AS my, corr(p_partkey, p_size) AS r FROM part),
 b AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2, * FROM c)"""


@query(
    "ols_fit",
    f"""WITH {TWO} SELECT 0 AS position, 'const' AS feature, round(my, 6) AS coefficient FROM b
    UNION ALL SELECT 1, 'numeric__p_partkey', round(b1 * sqrt(s11), 6) FROM b UNION ALL SELECT 2, 'numeric__p_size', round(b2 * sqrt(s22), 6) FROM b""",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    fit = ols.ols_fit(part, "p_retailprice", ["p_partkey", "p_size"])
    return ols.ols_coefficients(fit, part).withColumn("coefficient", F.round("coefficient", 6))


@query(
    "ols_category",
    """WITH g AS (SELECT o_orderstatus AS s, avg(o_totalprice) AS m FROM orders GROUP BY 1), c AS (SELECT sum(m) / (count(*) + 1) AS c FROM g)
    SELECT 0 AS position, 'const' AS feature, round(c, 4) AS coefficient FROM c
    UNION ALL SELECT CAST(row_number() OVER (ORDER BY s) AS INTEGER), 'category__o_orderstatus_' || s, round(m - c, 4) FROM g, c""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    fit = ols.ols_fit(orders, "o_totalprice", ["o_orderstatus"])
    return ols.ols_coefficients(fit, orders).withColumn("coefficient", F.round("coefficient", 4))


@query(
    "top_coefficients",
    """WITH g AS (SELECT o_orderpriority AS s, avg(o_totalprice) AS m FROM orders GROUP BY 1), c AS (SELECT sum(m) / (count(*) + 1) AS c FROM g)
    SELECT 'category__o_orderpriority_' || s AS feature, round(m - c, 4) AS coefficient FROM g, c ORDER BY abs(m - c) DESC LIMIT 3""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    fit = ols.ols_fit(orders, "o_totalprice", ["o_orderpriority"])
    found = findings.top_coefficients(ols.ols_coefficients(fit, orders), 3)
    return found.withColumn("coefficient", F.round("coefficient", 4))


@query(
    "ols_summary",
    f"""WITH {ONE} SELECT CAST(n AS BIGINT) AS n, 2 AS rank, round(1 - rss / (n * vy), 8) AS r2, round(1 - (rss / (n * vy)) * (n - 1) / (n - 2), 8) AS adjusted_r2,
    round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 4, 4) AS aic, round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * ln(n), 4) AS bic FROM m, rss""",
)
def _(spark, folder):
    fit, rows = _one(spark, folder)
    s = ols.ols_summary(fit, rows)
    digits = {"r2": 8, "adjusted_r2": 8, "aic": 4, "bic": 4}
    return s.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("ols_residuals", f"WITH {ONE} SELECT event_id, round(fitted, 5) AS fitted, round(e, 5) AS residual FROM res")
def _(spark, folder):
    fit, rows = _one(spark, folder)
    return ols.ols_residuals(fit, rows).select("event_id", F.round("fitted", 5).alias("fitted"), F.round("residual", 5).alias("residual"))


@query("residuals_vs_fitted", f"WITH {ONE} SELECT round(fitted, 5) AS fitted, round(e, 5) AS residual FROM res")
def _(spark, folder):
    fit, rows = _one(spark, folder)
    return ols.residuals_vs_fitted(fit, rows).select(F.round("fitted", 5).alias("fitted"), F.round("residual", 5).alias("residual"))


@query("scale_location", f"WITH {ONE} SELECT round(fitted, 5) AS fitted, round(sqrt(abs(e)), 5) AS sqrt_abs_residual FROM res")
def _(spark, folder):
    fit, rows = _one(spark, folder)
    points = ols.scale_location(fit, rows)
    return points.select(*[F.round(c, 5).alias(c) for c in points.columns])


@query("cooks_distance", f"WITH {ONE} SELECT event_id, round(h, 9) AS leverage, round(cooks, 9) AS cooks FROM cook")
def _(spark, folder):
    fit, rows = _one(spark, folder)
    return ols.cooks_distance(fit, rows).select("event_id", F.round("leverage", 9).alias("leverage"), F.round("cooks", 9).alias("cooks"))


@query(
    "influential_count",
    f"WITH {ONE} SELECT 4 / any_value(n) AS threshold, count(*) FILTER (cooks > 4 / n) AS influential FROM cook",
)
def _(spark, folder):
    return ols.influential_count(*_one(spark, folder))


@query("breusch_pagan", f"WITH {ONE} SELECT round(any_value(n) * pow(corr(x, e * e), 2), 4) AS lm, 1 AS df FROM res")
def _(spark, folder):
    return ols.breusch_pagan(*_one(spark, folder)).select(F.round("lm", 4).alias("lm"), "df")


@query(
    "vif",
    f"WITH {TWO} SELECT 0 AS position, 'numeric__p_partkey' AS feature, round(1 / (1 - r * r), 8) AS vif FROM c UNION ALL SELECT 1, 'numeric__p_size', round(1 / (1 - r * r), 8) FROM c",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    fit = ols.ols_fit(part, "p_retailprice", ["p_partkey", "p_size"])
    return ols.vif(fit, part).withColumn("vif", F.round("vif", 8))


@query(
    "vif_collinear",
    "SELECT 0 AS position, 'numeric__n_chars' AS feature, CAST(NULL AS DOUBLE) AS vif WHERE (SELECT corr(n_chars, length(text)) FROM documents) > 0.999999 UNION ALL SELECT 1, 'numeric__n_text', CAST(NULL AS DOUBLE)",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "n_chars", F.length("text").alias("n_text"))
    return ols.vif(ols.ols_fit(rows, "doc_id", ["n_chars", "n_text"]), rows)




@query(
    "qq_points",
    f"""WITH {ONE} SELECT row_number() OVER (ORDER BY e) AS rank, round((e - avg(e) OVER ()) / stddev_pop(e) OVER (), 5) AS sample FROM res""",
)
def _(spark, folder):
    fit, rows = _one(spark, folder)
    points = ols.qq_points(ols.ols_residuals(fit, rows), "residual")
    return points.select("rank", F.round("sample", 5).alias("sample"))


@query(
    "qq_grid",
    f"""WITH {ONE}, r AS (SELECT row_number() OVER (ORDER BY e) AS rank, count(*) OVER () AS n,
      round((e - avg(e) OVER ()) / stddev_pop(e) OVER (), 5) AS sample FROM res),
    g AS (SELECT DISTINCT 1 + (i * (n - 1)) // (least(200, n) - 1) AS rank FROM (SELECT count(*) AS n FROM res), (SELECT range AS i FROM range(200)) WHERE i < n)
    SELECT rank, sample, round(rank / (n + 1), 9) AS p FROM r JOIN g USING (rank)""",
)
def _(spark, folder):
    """The share below each point is what its theoretical quantile is the quantile of."""
    fit, rows = _one(spark, folder)
    points = ols.qq_grid(ols.ols_residuals(fit, rows), "residual", 200)
    share = F.round(F.col("rank") / F.lit(float(fit.n + 1)), 9)
    return points.select("rank", F.round("sample", 5).alias("sample"), share.alias("p"))


@query(
    "residual_sample",
    f"WITH {ONE} SELECT event_id, round(fitted, 5) AS fitted, round(e, 5) AS residual, round(sqrt(abs(e)), 5) AS sqrt_abs_residual "
    "FROM res WHERE e IS NOT NULL ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 300",
)
def _(spark, folder):
    fit, rows = _one(spark, folder)
    points = ols.residual_sample(fit, rows, ["event_id"], 300)
    return points.select("event_id", *[F.round(c, 5).alias(c) for c in ("fitted", "residual", "sqrt_abs_residual")])


@query("shapiro_by_group")
def _(spark, folder):
    return ols.shapiro_by_group(table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


NEAR = """SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_size + 1e-6 * sin(p_partkey) AS b, 2.0 * p_size + 1e5 * (1e-6 * sin(p_partkey)) AS y FROM part"""


@query("near_collinear", f"SELECT p_partkey, round(y, 2) AS linear, round(y, 2) AS squares FROM ({NEAR})")
def _(spark, folder):
    """Columns that differ in the sixth digit, and a target that only their difference tells: both fits give the target back."""
    rows = spark.sql(NEAR.replace("FROM part", "FROM {part}"), part=table(spark, folder, "part"))
    spec = features.FeatureSpec.fit(rows, ["a", "b"], "y")
    factor = gram.triangle(rows, spec, "y", spec.target.mean, 2)
    part = gram.leading(factor, spec.width)
    linear = models.fit_linear(spec, gram.Gram(spec.names, part.T @ part, spec.target.mean), factor=part)
    squares = models.fit_poly2(spec, rows, "y", factor)
    out = squares.predict(linear.predict(rows, "linear"), "squares")
    return out.select("p_partkey", F.round("linear", 2).alias("linear"), F.round("squares", 2).alias("squares"))


@query("shapiro_wilk")
def _(spark, folder):
    fit, rows = _one(spark, folder)
    return ols.shapiro(fit, rows)


@query("diagnostics")
def _(spark, folder):
    fit, rows = _one(spark, folder)
    return ols.diagnostics(fit, rows)


def _metrics(spark, folder):
    """Many rows of made-to-measure figures, so that the rules meet every case."""
    return table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("max_vif"),
        F.when(F.col("l_returnflag") != "N", F.col("l_discount")).alias("shapiro_p"),
        F.col("l_tax").alias("breusch_pagan_p"),
        (F.col("l_linenumber") - 1).alias("influential_points"),
    )


METRICS = """metrics AS (SELECT l_quantity AS max_vif, CASE WHEN l_returnflag <> 'N' THEN l_discount END AS shapiro_p,
  l_tax AS breusch_pagan_p, l_linenumber - 1 AS influential_points FROM lineitem)"""


@query(
    "diagnostic_flags",
    f"""WITH {METRICS}, f AS (SELECT 'vif' AS diagnostic, max_vif > 10 AS problem FROM metrics UNION ALL SELECT 'shapiro', coalesce(shapiro_p < 0.05, FALSE) FROM metrics
    UNION ALL SELECT 'breusch_pagan', breusch_pagan_p < 0.05 FROM metrics UNION ALL SELECT 'influential', influential_points > 0 FROM metrics)
    SELECT diagnostic, problem, count(*) AS n FROM f GROUP BY ALL""",
)
def _(spark, folder):
    flags = findings.diagnostic_flags(_metrics(spark, folder))
    return flags.groupBy("diagnostic", "problem").agg(F.count("*").alias("n"))


@query(
    "diagnostic_recommendations",
    f"""WITH {METRICS}, f AS (SELECT list_filter([CASE WHEN max_vif > 10 THEN 'vif' END, CASE WHEN shapiro_p < 0.05 THEN 'shapiro' END,
      CASE WHEN breusch_pagan_p < 0.05 THEN 'breusch_pagan' END, CASE WHEN influential_points > 0 THEN 'influential' END], lambda x: x IS NOT NULL) AS l FROM metrics),
    g AS (SELECT CASE WHEN len(l) = 0 THEN ['none'] ELSE l END AS l FROM f)
    SELECT CAST(ord - 1 AS INTEGER) AS ord, l[ord] AS rule, count(*) AS n FROM (SELECT l, unnest(range(1, len(l) + 1)) AS ord FROM g) GROUP BY ALL""",
)
def _(spark, folder):
    advice = ols.diagnostic_recommendations(_metrics(spark, folder))
    return advice.groupBy("ord", "rule").agg(F.count("*").alias("n"))


@query(
    "overfit_note",
    """SELECT l_returnflag AS model, CASE WHEN l_linenumber / l_quantity > 0.2 THEN 'many parameters' WHEN l_discount - l_tax > 0.05 THEN 'adjusted R2 far below R2'
    ELSE 'none' END AS overfit, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def _(spark, folder):
    best = table(spark, folder, "lineitem").withColumns(
        {"model": F.col("l_returnflag"), "parameters": F.col("l_linenumber"), "r2": F.col("l_discount"), "adjusted_r2": F.col("l_tax")}
    )
    notes = findings.overfit_note(best, F.col("l_quantity"))
    return notes.groupBy("model", "overfit").agg(F.count("*").alias("n"))


# --- candidate models ------------------------------------------------------------------

# One feature, standardised on the training rows; y about its training mean. The error sum is floored at 1e-12 in AIC and BIC.
SPLIT = f"""pt AS (SELECT *, row_number() OVER (ORDER BY {_word('p_partkey')}) <= (SELECT ceil(count(*) * 22 / 100.0) FROM part) AS test FROM part),
 tn AS (SELECT p_partkey, {_fold_sql('p_partkey', 'pt WHERE NOT test')} AS fold FROM pt WHERE NOT test),
 sp AS (SELECT p_partkey, p_partkey AS x, p_retailprice AS y, test, fold FROM pt LEFT JOIN tn USING (p_partkey)),
 tm AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, CAST(count(*) AS DOUBLE) AS n FROM sp WHERE NOT test),
 z AS (SELECT p_partkey, (x - mx) / sx AS z, y, y - my AS yc, test, fold, n, my FROM sp, tm),
 tr AS (SELECT sum(z * z) AS zz, sum(z * yc) AS zy FROM z WHERE NOT test)"""
SCORE = """score AS (SELECT count(*) AS nt, sum((y - (my + w * z)) * (y - (my + w * z))) AS rss, sum(abs(y - (my + w * z))) AS ae, var_pop(y) * count(*) AS tss FROM z, fit WHERE test)
 SELECT round(w, 6) AS weight, round(sqrt(rss / nt), 6) AS rmse, round(ae / nt, 6) AS mae, round(1 - rss / tss, 6) AS r2,
   round(1 - (rss / tss) * (nt - 1) / (nt - 2), 6) AS adjusted_r2, round(nt * ln(greatest(rss, 1e-12) / nt) + 2, 4) AS aic, round(nt * ln(greatest(rss, 1e-12) / nt) + ln(nt), 4) AS bic"""


def _training(spark, folder, names=("p_partkey",)):
    part = table(spark, folder, "part")
    rows = features.prepare_target(part, "p_retailprice", names, ["p_partkey"])
    train, test = features.train_test_split(rows, ["p_partkey"])
    return train, test, features.FeatureSpec.fit(train, names, "p_retailprice")


def _folds(train, spec):
    fold = features.fold_number(train, ["p_partkey"], features.fold_count(spec.target.count))
    by_fold = gram.grams(train, spec, "p_retailprice", spec.target.mean, fold=fold)
    parts = list(by_fold.values())
    return by_fold, sum(parts[1:], parts[0])


def _scored(model, test):
    found = models.regression_metrics(model.predict(test, "predicted"), "p_retailprice", "predicted", model.parameters)
    out = found.withColumn("weight", F.round(F.lit(float(model.weights[0])), 6)).drop("parameters")
    out = out.withColumns({"aic": F.round("aic", 4), "bic": F.round("bic", 4)})
    if model.alpha is not None:
        out = out.withColumn("alpha", F.round(F.lit(model.alpha), 6))
    if model.l1_ratio is not None:
        out = out.withColumn("l1_ratio", F.lit(model.l1_ratio))
    return out


@query("fit_linear", f"WITH {SPLIT}, fit AS (SELECT zy / zz AS w FROM tr), {SCORE} FROM score, fit")
def _(spark, folder):
    train, test, spec = _training(spark, folder)
    return _scored(models.fit_linear(spec, _folds(train, spec)[1]), test)


@query(
    "fit_ridge_cv",
    f"""WITH {SPLIT}, grid AS (SELECT range AS k, pow(10, -3 + range * (6.0 / 29)) AS a FROM range(30)),
    loo AS (SELECT a, sum(pow((yc - zy / (zz + a) * z) / (1 - 1 / n - z * z / (zz + a)), 2)) AS err FROM z, tr, grid WHERE NOT test GROUP BY a),
    fit AS (SELECT zy / (zz + a) AS w, a FROM tr, (SELECT a FROM loo ORDER BY err, a LIMIT 1)), {SCORE}, round(a, 6) AS alpha FROM score, fit""",
)
def _(spark, folder):
    train, test, spec = _training(spark, folder)
    return _scored(models.fit_ridge_cv(spec, _folds(train, spec)[1], train, "p_retailprice"), test)


def _net_sql(ratios: str, count: int) -> str:
    return f"""WITH {SPLIT}, grid AS (SELECT pow(10, -4 + range * (5.0 / {count - 1})) AS a, l1 FROM range({count}), (SELECT unnest([{ratios}])::DOUBLE AS l1)),
    per AS (SELECT fold, count(*)::DOUBLE AS n, sum(z) AS z, sum(yc) AS y, sum(z * z) AS zz, sum(z * yc) AS zy, sum(yc * yc) AS yy FROM z WHERE NOT test GROUP BY fold),
    rest AS (SELECT p.fold, p.n AS nf, p.z AS zf, p.y AS yf, p.zz AS zzf, p.zy AS zyf, p.yy AS yyf, sum(q.n) AS n, sum(q.z) AS z, sum(q.y) AS y, sum(q.zz) AS zz, sum(q.zy) AS zy
      FROM per p JOIN per q ON p.fold <> q.fold GROUP BY ALL),
    sol AS (SELECT *, sign(zy - z * y / n) * greatest(abs(zy - z * y / n) / n - a * l1, 0) / ((zz - z * z / n) / n + a * (1 - l1)) AS w FROM rest, grid),
    err AS (SELECT a, l1, avg((yyf - 2 * b * yf - 2 * w * zyf + nf * b * b + 2 * b * w * zf + w * w * zzf) / nf) AS mse FROM (SELECT *, (y - w * z) / n AS b FROM sol) GROUP BY a, l1),
    fit AS (SELECT sign(zy) * greatest(abs(zy) / n - a * l1, 0) / (zz / n + a * (1 - l1)) AS w, a, l1 FROM tr, tm, (SELECT a, l1 FROM err ORDER BY mse, l1, a DESC LIMIT 1)),
    {SCORE}, round(a, 6) AS alpha, l1 AS l1_ratio FROM score, fit"""


@query("fit_lasso_cv", _net_sql("1.0", 36))
def _(spark, folder):
    train, test, spec = _training(spark, folder)
    return _scored(models.fit_lasso_cv(spec, _folds(train, spec)[0]), test)


@query("fit_elastic_net_cv", _net_sql("0.15, 0.5, 0.85", 28))
def _(spark, folder):
    train, test, spec = _training(spark, folder)
    return _scored(models.fit_elastic_net_cv(spec, _folds(train, spec)[0]), test)


@query("fit_huber")
def _(spark, folder):
    train, test, spec = _training(spark, folder)
    return _scored(models.fit_huber(spec, train, "p_retailprice"), test)


@query(
    "fit_poly2",
    f"""WITH {SPLIT}, q AS (SELECT *, z * z AS u FROM z),
    c AS (SELECT var_pop(z) AS s11, var_pop(u) AS s22, covar_pop(z, u) AS s12, covar_pop(z, y) AS s1y, covar_pop(u, y) AS s2y, avg(z) AS mz, avg(u) AS mu, avg(y) AS m FROM q WHERE NOT test),
    fit AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS w1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS w2, mz, mu, m FROM c),
    p AS (SELECT y, y - (m + w1 * (z - mz) + w2 * (u - mu)) AS e FROM q, fit WHERE test),
    s AS (SELECT count(*) AS nt, sum(e * e) AS rss, sum(abs(e)) AS ae, var_pop(y) * count(*) AS tss FROM p)
    SELECT round(w1, 6) AS weight, round(sqrt(rss / nt), 6) AS rmse, round(ae / nt, 6) AS mae, round(1 - rss / tss, 6) AS r2,
      round(1 - (rss / tss) * (nt - 1) / (nt - 3), 6) AS adjusted_r2, round(nt * ln(greatest(rss, 1e-12) / nt) + 4, 4) AS aic, round(nt * ln(greatest(rss, 1e-12) / nt) + 2 * ln(nt), 4) AS bic FROM s, fit""",
)
def _(spark, folder):
    train, test, spec = _training(spark, folder)
    return _scored(models.fit_poly2(spec, train, "p_retailprice"), test)


@query(
    "regression_metrics",
    """SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2,
      round(1 - (sum(e * e) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - 4), 6) AS adjusted_r2,
      round(count(*) * ln(sum(e * e) / count(*)) + 6, 3) AS aic, round(count(*) * ln(sum(e * e) / count(*)) + 3 * ln(count(*)), 3) AS bic, 3 AS parameters
    FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 2000 AS e FROM lineitem)""",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("guess", F.col("l_quantity") * 2000)
    found = models.regression_metrics(rows, "l_extendedprice", "guess", 3)
    return found.withColumns({"aic": F.round("aic", 3), "bic": F.round("bic", 3)})


@query(
    "predict",
    f"WITH {SPLIT}, fit AS (SELECT zy / zz AS w FROM tr) SELECT p_partkey, y AS actual, round(my + w * z, 5) AS predicted FROM z, fit WHERE test",
)
def _(spark, folder):
    train, test, spec = _training(spark, folder)
    model = models.fit_linear(spec, _folds(train, spec)[1])
    scored = model.predict(test, "predicted")
    return scored.select("p_partkey", F.col("p_retailprice").alias("actual"), F.round("predicted", 5).alias("predicted"))


PART_KEY, PART_TARGET, PART_FEATURES = ["p_partkey"], "p_retailprice", ["p_partkey", "p_size", "p_type", "p_brand"]


@query("compare_models")
def _(spark, folder):
    return models.compare_models(table(spark, folder, "part"), PART_TARGET, PART_FEATURES, PART_KEY).table


@query("best_model")
def _(spark, folder):
    return models.compare_models(table(spark, folder, "part"), PART_TARGET, ["p_partkey", "p_size"], PART_KEY).best()


@query(
    "prediction_sample",
    f"WITH {SPLIT}, fit AS (SELECT zy / zz AS w FROM tr) SELECT y AS actual, round(my + w * z, 5) AS predicted FROM z, fit WHERE test ORDER BY p_partkey LIMIT 240",
)
def _(spark, folder):
    compared = models.compare_models(table(spark, folder, "part"), PART_TARGET, ["p_partkey"], PART_KEY)
    return compared.prediction_sample("Linear Regression").withColumn("predicted", F.round("predicted", 5))


@query("insight_summary")
def _(spark, folder):
    part = table(spark, folder, "part")
    compared = models.compare_models(part, PART_TARGET, ["p_partkey", "p_size"], PART_KEY)
    fit = ols.ols_fit(part, PART_TARGET, ["p_partkey", "p_size"])
    metrics = ols.diagnostics(fit, part)
    return findings.insight_summary(part.count(), len(part.columns), PART_TARGET, compared.best(), metrics, eda.describe_numeric(part))


@query("report_table")
def _(spark, folder):
    return report_table(analyse(table(spark, folder, "part"), PART_KEY, target=PART_TARGET, features=PART_FEATURES))
