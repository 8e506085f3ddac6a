"""The whole analysis of one table: clean, explore, fit, compare, report, log."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablelab.functions.columns import categorical_columns, limited_names, numeric_columns, stamp
from tablelab.operators import eda, findings, models, ols
from tablelab.operators.cleaning import Cleaned, apply_cleaning, resolve_columns
from tablelab.operators.features import prepare_target, select_features
from tablelab.operators.profile import cleaning_proposal, default_roles, require_rows
from tablelab.operators.runlog import RunLog
from tablelab.session import dealt, hold, materialise, small_table
from tablelab.sources.readers import read_table
from tablelab.sources.writers import write_summary, write_table

# The report's sections, in order.
SECTIONS = (
    "1. 数据集概况",
    "2. 数据清洗摘要",
    "3. 探索性数据分析 EDA",
    "4. 初始线性回归结果",
    "5. 回归诊断结果",
    "6. 自动优化路径",
    "7. 模型比较",
    "8. 最佳模型解释",
    "9. 结论与建议",
    "10. 附录",
)
REPORT = "section string, ord int, item string, value string"


@dataclass
class Results:
    """Result tables of one analysis; the data itself stays in ``cleaned.data``."""

    proposal: DataFrame
    cleaned: Cleaned
    target: str
    features: list[str]
    rows: int
    numeric_stats: DataFrame
    categorical_stats: DataFrame
    correlation: DataFrame
    coefficients: DataFrame
    ols: DataFrame
    vif: DataFrame
    metrics: DataFrame
    recommendations: DataFrame
    comparison: models.Comparison
    best: DataFrame
    sample_count: int
    key: list[str]
    fit: ols.OlsFit
    model_rows: DataFrame

    def report(self, file: str = "", created: str = "") -> DataFrame:
        return report_table(self, file, created)

    def charts(self) -> dict[str, DataFrame]:
        """The data of every chart, each of a bounded number of rows a column."""
        data, rows = self.cleaned.data, self.model_rows
        measured = [c for c in self.features if c in numeric_columns(rows)]
        out = {
            "histogram": eda.histogram(data),
            "density": eda.density_curves(data),
            "top_categories": eda.top_categories(data),
            "correlation": self.correlation,
            "residuals": ols.residual_sample(self.fit, rows, self.key),
            "residual_quantiles": ols.qq_grid(ols.ols_residuals(self.fit, rows), "residual"),
            "model_errors": self.comparison.table.select("candidate", "model", "rmse"),
            "predictions": self.comparison.prediction_sample(self.best.first()["model"]),
        }
        if measured:
            out["scatter"] = eda.scatter_sample(rows, self.target, self.key, measured)
        return out


def analyse(
    df: DataFrame, key: Sequence[str], accepted: Sequence[str] = (), target: str = "", features: Sequence[str] = ()
) -> Results:
    """Profile, clean, explore and model a table.

    ``key`` names columns that identify a row; they give the split, the folds
    and every "first rows" a meaning that does not depend on partitions. It
    and the target and features go by their names before cleaning.
    """
    proposal = cleaning_proposal(require_rows(df))
    cleaned = apply_cleaning(df, accepted)
    renamed = "normalize_columns" in accepted
    key = resolve_columns(df, key, renamed)
    chosen = resolve_columns(df, features, renamed)
    if target:
        target = resolve_columns(df, [target], renamed)[0]
    else:
        target, usual = default_roles(cleaned.data.drop(*key))
        chosen = chosen or usual
    data = cleaned.data
    names = select_features(data.drop(*[k for k in key if k != target and k not in chosen]), target, chosen)

    rows = materialise(dealt(prepare_target(data, target, names, key)), "analysed")
    fit = ols.ols_fit(rows, target, names)
    metrics = ols.diagnostics(fit, rows)
    compared = models.compare_models(rows, target, names, key)
    return Results(
        proposal=proposal,
        cleaned=cleaned,
        target=target,
        features=names,
        rows=data.count(),
        numeric_stats=eda.describe_numeric(data),
        categorical_stats=hold(eda.describe_categorical(data)),
        correlation=eda.correlation_matrix(data),
        coefficients=ols.ols_coefficients(fit, rows),
        ols=ols.ols_summary(fit, rows),
        vif=ols.vif(fit, rows),
        metrics=metrics,
        recommendations=ols.diagnostic_recommendations(metrics),
        comparison=compared,
        best=hold(compared.best()),
        sample_count=fit.n,
        key=list(key),
        fit=fit,
        model_rows=rows,
    )


def _lines(df: DataFrame, section: int, item: Column, value: Column, order: Sequence[str], start: int) -> DataFrame:
    """Rows of a small result table as report rows."""
    numbered = findings.ranked(df, [F.col(c) for c in order])
    return numbered.select(
        F.lit(SECTIONS[section - 1]).alias("section"),
        (F.col("ord") + start).cast("int").alias("ord"),
        item.cast("string").alias("item"),
        value.cast("string").alias("value"),
    )


def _positioned(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A table of one row per column with the column's place."""
    return stats.withColumn("position", F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")))


def report_table(r: Results, file: str = "", created: str = "") -> DataFrame:
    """What the report states, as rows of the sections they belong to.

    Long lists show their first rows in the order of the columns, and a line
    with the number left out. ``file`` and ``created`` are shown if given.
    """
    data = r.cleaned.data
    spark = data.sparkSession

    def names(values: Sequence[str]) -> str:
        return spark.range(1).select(limited_names(F.array(*[F.lit(v) for v in values]).cast("array<string>"))).first()[0]

    def pairs(section: int, rows: Sequence[tuple[str, object]], start: int = 0) -> DataFrame:
        cells = [(SECTIONS[section - 1], start + i + 1, k, None if v is None else str(v)) for i, (k, v) in enumerate(rows)]
        return small_table(spark, cells, REPORT)

    best = r.best.first()
    head = [(k, v) for k, v in (("file", file), ("created", created)) if v]
    head += [
        ("rows", r.rows),
        ("columns", len(data.columns)),
        ("target", r.target),
        ("features", names(r.features)),
        ("numeric columns", names(numeric_columns(data))),
        ("categorical columns", names(categorical_columns(data))),
    ]
    sides = r.cleaned.summary().collect()
    change = [(f"{s['side']} {k}", s[k]) for s in sides for k in ("rows", "columns", "missing")]
    change += [(k, sides[0][k]) for k in ("rows_removed", "cells_filled", "values_capped")]
    fit = r.ols.first()
    linear = r.comparison.table.filter("candidate = 1").first()
    base = [("r2", fit["r2"]), ("adjusted_r2", fit["adjusted_r2"]), ("rmse", linear["rmse"]), ("mae", linear["mae"])]
    flags = findings.diagnostic_flags(r.metrics)
    overfit = findings.overfit_note(r.best, F.lit(r.sample_count)).first()["overfit"]

    def js(df: DataFrame, *drop: str) -> Column:
        return F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in drop]))

    def preview(df: DataFrame, section: int, item: Column, value: Column, order: Sequence[str], start: int) -> DataFrame:
        lines = findings.preview_lines(df, item, value, order)
        return _lines(lines, section, F.col("item"), F.col("detail"), ["ord"], start)

    def listed(df: DataFrame, value: Column, group: str, start: int) -> DataFrame:
        named = df.select("ord", F.concat_ws(" ", group, "column").alias("item"), value.alias("detail"))
        return _lines(findings.finding_lines(named, "item", "detail"), 2, F.col("item"), F.col("detail"), ["ord"], start)

    low, high = F.col("low").cast("string"), F.col("high").cast("string")
    figures = F.when(F.col("operation") == "cap_outliers", F.concat_ws(" to ", low, high)).otherwise(low)
    stats = _positioned(r.numeric_stats, data.columns)
    groups = _positioned(r.categorical_stats, data.columns)
    table = r.comparison.table
    pieces = [
        pairs(1, head),
        listed(r.proposal, F.concat_ws(", ", "detail", F.concat("affected", F.lit(" affected"))), "category", 0),
        listed(r.cleaned.log(), F.concat_ws(": ", "detail", figures, "names"), "action", 100),
        pairs(2, change, 200),
        preview(stats, 3, F.col("column"), js(r.numeric_stats, "column"), ["position"], 0),
        preview(groups, 3, F.col("column"), js(r.categorical_stats, "column"), ["position"], 100),
        _lines(
            findings.top_correlations(r.correlation).withColumn("_a", -F.abs("r")),
            3, F.concat_ws(" ~ ", "col_a", "col_b"), F.col("r"), ["_a", "col_a", "col_b"], 200,
        ),
        pairs(4, base),
        preview(r.coefficients, 4, F.col("feature"), F.col("coefficient"), ["position"], 100),
        _lines(
            findings.top_coefficients(r.coefficients).withColumn("_a", -F.abs("coefficient")),
            4, F.col("feature"), F.col("coefficient"), ["_a", "feature"], 200,
        ),
        _lines(flags, 5, F.col("diagnostic"), js(flags, "diagnostic"), ["diagnostic"], 0),
        preview(r.vif, 5, F.col("feature"), F.col("vif"), ["position"], 100),
        _lines(r.recommendations, 6, F.col("rule"), F.col("text"), ["ord"], 0),
        _lines(table, 7, F.col("model"), js(table, "model", "candidate"), ["candidate"], 0),
        pairs(7, [("overfit", overfit)], 100),
        pairs(8, [("best model", best["model"]), ("rmse", best["rmse"]), ("r2", best["r2"])]),
        pairs(9, [("check on independent data", best["model"])]),
        pairs(10, [("table", t) for t in OUTPUTS]),
    ]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


OUTPUTS = ("cleaned_data", "model_comparison", "ols_coefficients", "vif_diagnostics", "analysis_summary", "chart_data", "report")


def run_analysis(
    spark: SparkSession,
    path: str,
    out: str,
    key: Sequence[str],
    accepted: Sequence[str] = (),
    target: str = "",
    features: Sequence[str] = (),
    log: RunLog | None = None,
    run: str | None = None,
    **options,
) -> str:
    """Read a file, analyse it and write every result below ``out``; progress goes to the log."""
    run = run or uuid.uuid4().hex

    def note(status: str, progress: int, stage: str, payload: str = "{}") -> None:
        if log is not None:
            log.append(run, status, progress, stage, payload)

    try:
        note("running", 12, "cleaning")
        df = read_table(spark, path, **options)
        if not path.endswith(".parquet") and options.get("fmt") != "parquet":
            df = materialise(df, "input")  # text is parsed once
        results = analyse(df, key, accepted, target, features)
        note("running", 82, "report")
        write_table(results.cleaned.data, f"{out}/cleaned_data")
        write_table(results.comparison.table.drop("candidate"), f"{out}/model_comparison")
        write_table(results.coefficients.select("feature", "coefficient"), f"{out}/ols_coefficients")
        write_table(results.vif.select("feature", "vif"), f"{out}/vif_diagnostics")
        roles = [(results.target, results.features, results.sample_count)]
        parts = {
            "roles": small_table(spark, roles, "target string, features array<string>, samples bigint"),
            "ols": results.ols,
            "coefficients": results.coefficients,
            "vif": results.vif,
            "recommendations": results.recommendations,
            "predictions": results.comparison.prediction_sample(results.best.first()["model"]),
            "cleaning_log": results.cleaned.log(),
            "numeric_stats": results.numeric_stats,
            "categorical_stats": results.categorical_stats,
            "correlation": results.correlation,
            "diagnostics": results.metrics,
            "comparison": results.comparison.table,
            "best_model": results.best,
        }
        write_summary(parts, f"{out}/analysis_summary")
        write_summary(results.charts(), f"{out}/chart_data")
        now = spark.range(1).select(stamp(F.current_timestamp())).first()[0]
        write_table(results.report(path.rstrip("/").rsplit("/", 1)[-1], now).orderBy("section", "ord"), f"{out}/report")
        note("completed", 100, "done")
    except Exception as error:
        note("failed", 100, "failed", str(error).splitlines()[0] if str(error) else type(error).__name__)
        raise
    return run
