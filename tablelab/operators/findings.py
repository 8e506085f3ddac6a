"""What a report states: rankings, flags and notes taken from result tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelab.functions.columns import col
from tablelab.operators.ols import P_LIMIT, VIF_LIMIT
from tablelab.session import small_table

# How much each finding lists, and when overfitting is suspected.
TOP_PAIRS, TOP_COEFFICIENTS, LISTED, TABLE_ROWS, SUMMARISED = 5, 8, 12, 10, 6
PARAMETER_SHARE, R2_DROP = 0.2, 0.05


def top_correlations(matrix: DataFrame, rows: int = TOP_PAIRS) -> DataFrame:
    """The strongest pairs of a long correlation matrix, names breaking ties downwards."""
    upper = matrix.filter("pos_a < pos_b")
    order = [F.abs("r").desc(), F.col("col_a").desc(), F.col("col_b").desc()]
    return upper.orderBy(*order).limit(rows).select("col_a", "col_b", "r")


def diagnostic_flags(metrics: DataFrame) -> DataFrame:
    """One row per diagnostic with its figure and whether it points to a problem; unknown is no."""
    tests = {
        "vif": (F.col("max_vif"), F.col("max_vif") > VIF_LIMIT),
        "shapiro": (F.col("shapiro_p"), F.col("shapiro_p") < P_LIMIT),
        "breusch_pagan": (F.col("breusch_pagan_p"), F.col("breusch_pagan_p") < P_LIMIT),
        "influential": (F.col("influential_points").cast("double"), F.col("influential_points") > 0),
    }
    rows = [
        F.struct(F.lit(name).alias("diagnostic"), value.alias("value"), F.coalesce(problem, F.lit(False)).alias("problem"))
        for name, (value, problem) in tests.items()
    ]
    return metrics.select(F.inline(F.array(*rows)))


def top_coefficients(coefficients: DataFrame, rows: int = TOP_COEFFICIENTS) -> DataFrame:
    """The encoded features of largest weight; earlier ones first among equals."""
    kept = coefficients.filter((F.col("feature") != "const") & F.col("coefficient").isNotNull())
    return kept.orderBy(F.abs("coefficient").desc(), "position").limit(rows).select("feature", "coefficient")


def overfit_note(best: DataFrame, sample_count: Column) -> DataFrame:
    """Whether the chosen model looks overfitted, and by which sign."""
    share = F.try_divide(F.col("parameters").cast("double"), sample_count.cast("double"))
    note = (
        F.when((F.col("parameters") > 0) & (share > PARAMETER_SHARE), "many parameters")
        .when(F.col("r2") - F.col("adjusted_r2") > R2_DROP, "adjusted R2 far below R2")
        .otherwise("none")
    )
    return best.select("model", note.alias("overfit"))


def finding_lines(findings: DataFrame, group: str, detail: str, limit: int = LISTED) -> DataFrame:
    """The first lines of an ordered list, then one line with the number left out."""
    shown = findings.filter(F.col("ord") <= limit).select(
        F.col("ord").cast("bigint"), col(group).alias("item"), col(detail).alias("detail")
    )
    rest = findings.filter(F.col("ord") > limit).agg(F.count("*").alias("n")).filter("n > 0")
    more = rest.select(F.lit(limit + 1).cast("bigint").alias("ord"), F.lit("more").alias("item"), F.col("n").cast("string").alias("detail"))
    return shown.unionByName(more)


def first_rows(df: DataFrame, position: str, rows: int = TABLE_ROWS) -> DataFrame:
    """The part of a long table that a report shows."""
    return df.orderBy(position).limit(rows)


def preview_lines(df: DataFrame, item: Column, value: Column, order: Sequence[str], rows: int = TABLE_ROWS) -> DataFrame:
    """The first rows of a bounded result table as lines ``(ord, item, detail)``, then one line with the number left out."""
    lines = ranked(df, [F.col(c) for c in order]).select("ord", item.cast("string").alias("item"), value.cast("string").alias("detail"))
    return finding_lines(lines, "item", "detail", rows)


def insight_summary(rows: int, columns: int, target: str, best: DataFrame, metrics: DataFrame, stats: DataFrame) -> DataFrame:
    """One row of JSON: sizes, target, best model, diagnostics, the first numeric columns and how many others there are.

    Its inputs are result tables of one row, or one row per column in the order of the columns.
    """
    described = [r.asDict() for r in stats.collect()]
    body = {
        "rows": rows,
        "columns": columns,
        "target": target,
        "best_model": best.first().asDict(),
        "diagnostics": metrics.first().asDict(),
        "numeric_stats": described[:SUMMARISED],
        "numeric_columns_left_out": max(0, len(described) - SUMMARISED),
    }
    return small_table(stats.sparkSession, [(json.dumps(body, ensure_ascii=False),)], "summary string")


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """A bounded result table with its order written down."""
    return df.withColumn("ord", F.row_number().over(Window.orderBy(*order)))
