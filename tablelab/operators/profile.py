"""Data-quality profile of a table and the list of fixes it suggests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tablelab.functions.columns import (
    as_double,
    categorical_columns,
    col,
    is_missing,
    normalize_names,
    numeric_columns,
    parse_grouped_number,
    require_scalars,
    text_key,
)
from tablelab.operators.stats import numeric_summary
from tablelab.session import small_table

# When a fix is suggested, and the category it is listed under.
CONVERT_SHARE = 0.85
IQR_FACTOR = 1.5
IQR_MIN_VALUES = 8
CATEGORIES = {
    "normalize_columns": "列名规范化",
    "drop_duplicates": "重复记录",
    "fill_missing": "缺失值",
    "convert_numeric": "类型转换",
    "cap_outliers": "异常值",
}

PROPOSAL = "ord int, id string, operation string, column string, category string, detail string, affected bigint, recommended boolean"


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def preview(df: DataFrame, key: Sequence[str], rows: int = 8) -> DataFrame:
    """The first rows in key order."""
    return df.orderBy(*[col(k) for k in key]).limit(rows)


def profile_table(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("bigint")
    )


def _distinct_counts(df: DataFrame) -> DataFrame:
    """``(i, missing, unique)`` for every column from one scan and one shuffle.

    Values travel in a field of their own kind, so that integers keep all
    digits and doubles stay eight bytes; texts travel as keys of at most 16
    bytes. Missing values are not counted.
    """
    cells = []
    for i, name in enumerate(df.columns):
        kind = df.schema[name].dataType
        whole = isinstance(kind, T.IntegralType)
        real = isinstance(kind, (T.DoubleType, T.FloatType))
        cells += [
            F.lit(i),
            (col(name) if whole else F.lit(None)).cast("bigint"),
            # adding zero makes -0.0 and 0.0 one value
            ((as_double(name) + F.lit(0.0)) if real else F.lit(None)).cast("double"),
            (F.lit(None) if whole or real else text_key(col(name))).cast("binary"),
        ]
    long = df.select(F.stack(F.lit(len(df.columns)), *cells).alias("i", "whole", "real", "text"))
    groups = long.groupBy("i", "whole", "real", "text").agg(F.count("*").alias("n"))
    held = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()
    return groups.groupBy("i").agg(
        F.coalesce(F.sum(F.when(~held, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(held).alias("unique"),
    )


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, missing count, distinct count and numeric flag of every column.

    ``approx`` replaces the distinct-value shuffle by HyperLogLog sketches.
    """
    require_scalars(df)
    names = df.columns
    if approx:
        both = [
            F.struct(
                F.lit(i).alias("i"),
                F.count_if(is_missing(df, c)).alias("missing"),
                F.approx_count_distinct(col(c)).alias("unique"),
            )
            for i, c in enumerate(names)
        ]
        counts = df.agg(F.array(*both).alias("x")).select(F.inline("x"))
    else:
        counts = _distinct_counts(df)
    numeric = set(numeric_columns(df))
    facts = [
        F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(f.name in numeric).alias("numeric"))
        for f in df.schema.fields
    ]
    return counts.withColumn("f", F.array(*facts)[F.col("i")]).select(
        F.col("i").alias("position"), "f.name", "f.dtype", "missing", "unique", "f.numeric"
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row; missing values equal each other. Texts are shuffled as keys of at most 16 bytes."""
    keys = [text_key(col(f.name)) if isinstance(f.dataType, T.StringType) else col(f.name) for f in df.schema.fields]
    copies = df.groupBy(*[k.alias(f"{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("copies"))
    return copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


def _flat_counts(df: DataFrame) -> dict[str, dict[str, int]]:
    """Rows, missing cells and parsable texts of every column in one pass."""
    texts = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
        *[F.count(parse_grouped_number(col(c))).alias(f"p{i}") for i, c in enumerate(texts)],
    ).first()
    return {
        "rows": {"": row["rows"]},
        "missing": {c: row[f"m{i}"] for i, c in enumerate(df.columns)},
        "parsable": {c: row[f"p{i}"] for i, c in enumerate(texts)},
    }


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing cells and the way they would be filled."""
    numeric = set(numeric_columns(df))
    names = df.columns
    counts = df.agg(*[F.count_if(is_missing(df, c)).alias(f"{i}") for i, c in enumerate(names)])
    facts = [
        F.struct(F.lit(c).alias("column"), F.lit("median" if c in numeric else "mode").alias("strategy"))
        for c in names
    ]
    return (
        counts.unpivot([], [col(f"{i}") for i in range(len(names))], "i", "missing")
        .filter("missing > 0")
        .withColumn("f", F.array(*facts)[F.col("i").cast("int")])
        .select("f.column", "missing", "f.strategy")
    )


def numeric_ratio(df: DataFrame) -> DataFrame:
    """Share of the non-missing texts of each text column that parse as numbers."""
    texts = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return small_table(df.sparkSession, [], "column string, ratio double, suggested boolean")
    shares = []
    for c in texts:
        parsed, held = F.count(parse_grouped_number(col(c))), F.count(col(c))
        shares.append(F.struct(F.lit(c).alias("column"), F.coalesce(F.try_divide(parsed, held), F.lit(0.0)).alias("ratio")))
    return (
        df.agg(F.array(*shares).alias("x"))
        .select(F.inline("x"))
        .select("column", "ratio", (F.col("ratio") >= CONVERT_SHARE).alias("suggested"))
    )


def iqr_fences(
    df: DataFrame, columns: Sequence[str], approx: bool = False, spread_only: bool = True
) -> dict[str, tuple[float, float]]:
    """Lower and upper fence of the columns that have a spread to speak of.

    ``spread_only=False`` gives fences to every column that holds a value.
    ``approx`` takes the quartiles from sketches, in one pass.
    """
    if approx and columns:
        row = df.agg(
            *[F.percentile_approx(as_double(c), [0.25, 0.75], 10000).alias(f"q{i}") for i, c in enumerate(columns)],
            *[F.count(as_double(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        ).first()
        quartiles = {c: (row[f"n{i}"], *(row[f"q{i}"] or (None, None))) for i, c in enumerate(columns)}
    else:
        found = numeric_summary(df, columns, (0.25, 0.75))
        quartiles = {c: (s.count, s.quantiles.get(0.25), s.quantiles.get(0.75)) for c, s in found.items()}
    out = {}
    for c, (n, q1, q3) in quartiles.items():
        if n and (not spread_only or (n >= IQR_MIN_VALUES and q3 - q1 > 0)):
            out[c] = (q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1))
    return out


def _outlier_counts(df: DataFrame, fences: dict[str, tuple[float, float]]) -> dict[str, int]:
    if not fences:
        return {}
    tests = [
        F.count_if((as_double(c) < low) | (as_double(c) > high)).alias(f"{i}")
        for i, (c, (low, high)) in enumerate(fences.items())
    ]
    return dict(zip(fences, df.agg(*tests).first()))


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Fences and the number of values strictly outside them, per numeric column."""
    fences = iqr_fences(df, list(columns or numeric_columns(df)), approx)
    counts = _outlier_counts(df, fences)
    rows = [(c, low, high, counts[c]) for c, (low, high) in fences.items()]
    return small_table(df.sparkSession, rows, "column string, lower double, upper double, outliers bigint")


def cleaning_proposal(df: DataFrame, approx: bool = False) -> DataFrame:
    """The fixes this table calls for, in the order they are listed.

    Flat counts, the duplicate count (the one shuffle of the rows), the quartiles
    (:func:`numeric_summary`) and one more pass for the outliers.
    """
    require_scalars(df)
    flat = _flat_counts(df)
    duplicates = duplicate_count(df).first()[0]
    numeric = numeric_columns(df)
    fences = iqr_fences(df, numeric, approx)
    outliers = _outlier_counts(df, fences)

    rows: list[tuple] = []

    def suggest(operation: str, column: str | None, detail: str, affected: int) -> None:
        ident = operation if column is None else f"{operation}::{column}"
        rows.append(
            (len(rows) + 1, ident, operation, column, CATEGORIES[operation], detail, affected, operation != "cap_outliers")
        )

    if normalize_names(df.columns) != df.columns:
        suggest("normalize_columns", None, "rename", len(df.columns))
    if duplicates:
        suggest("drop_duplicates", None, "drop", duplicates)
    for c in df.columns:
        missing = flat["missing"][c]
        held = flat["rows"][""] - missing
        if missing:
            suggest("fill_missing", c, "median" if c in numeric else "mode", missing)
        if c in flat["parsable"] and held and flat["parsable"][c] / held >= CONVERT_SHARE:
            suggest("convert_numeric", c, f"{flat['parsable'][c] / held:.0%}", held)
        if outliers.get(c):
            suggest("cap_outliers", c, "IQR", outliers[c])
    return small_table(df.sparkSession, rows, PROPOSAL)


def recommend_roles(df: DataFrame) -> DataFrame:
    """The last numeric column as target, the other numeric ones as features."""
    numeric = numeric_columns(df)
    rows = [(c, "target" if c == numeric[-1] else "feature") for c in numeric]
    return small_table(df.sparkSession, rows, "column string, role string")


def default_roles(df: DataFrame) -> tuple[str, list[str]]:
    numeric = numeric_columns(df)
    return (numeric[-1], numeric[:-1]) if numeric else ("", [])


def missing_cells(df: DataFrame):
    """One expression: missing cells of the whole table."""
    return reduce(lambda a, b: a + b, [F.count_if(is_missing(df, c)) for c in df.columns])
