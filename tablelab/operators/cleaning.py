"""Cleaning transforms and their application in one fixed order.

Statistics (fill values, fences) are a few numbers per column: they are
computed first and enter the plan as literals, so each transform is a plain
projection. Only the removal of duplicate rows shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from tablelab.functions.columns import (
    UNKNOWN_FILL,
    as_double,
    categorical_columns,
    col,
    is_missing,
    normalize_names,
    numeric_columns,
    parse_grouped_number,
)
from tablelab.operators.profile import iqr_fences, missing_cells
from tablelab.operators.stats import medians, modes
from tablelab.session import materialise, small_table

# The step names written to the log.
ACTIONS = {
    "normalize_columns": "列名规范化",
    "drop_duplicates": "移除重复行",
    "convert_numeric": "类型转换",
    "fill_missing": "缺失值填补",
    "cap_outliers": "异常值缩尾",
}
COPIES = "_copies"
COLUMN_STEPS = ("convert_numeric", "fill_missing", "cap_outliers")


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalize_names(df.columns))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each group of identical rows; copies are combined before the shuffle."""
    return df.dropDuplicates()


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Texts to doubles, thousands commas removed; what does not parse becomes null."""
    numeric = set(numeric_columns(df))
    changed = {c: parse_grouped_number(col(c).cast("string")).alias(c) for c in columns if c not in numeric}
    return df.select(*[changed.get(c, col(c)) for c in df.columns])


def fill_values(df: DataFrame, columns: Sequence[str]) -> dict[str, float | str]:
    """The median of numeric columns, the mode of the others; nothing for an empty numeric column."""
    numeric = [c for c in columns if c in numeric_columns(df)]
    found: dict = medians(df, numeric)
    for c, value in modes(df, [c for c in columns if c not in numeric]).items():
        found[c] = UNKNOWN_FILL if value is None else value
    return {c: found[c] for c in columns if found[c] is not None}


def fill_missing(df: DataFrame, values: Mapping[str, float | str]) -> DataFrame:
    """Replace missing cells by fixed values. A filled integer column becomes a double."""
    out = []
    for name in df.columns:
        kind = df.schema[name].dataType
        if name not in values:
            out.append(col(name))
        elif isinstance(kind, T.NumericType):
            out.append(F.coalesce(as_double(name), F.lit(float(values[name]))).alias(name))
        else:
            value = F.lit(values[name])
            if not isinstance(kind, T.StringType):
                value = value.try_cast(kind)
            out.append(F.coalesce(col(name), value).alias(name))
    return df.select(*out)


def fill_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return fill_missing(df, fill_values(df, list(columns or numeric_columns(df))))


def fill_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return fill_missing(df, fill_values(df, list(columns or categorical_columns(df))))


def cap(df: DataFrame, fences: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clip columns to their fences; missing stays missing."""
    out = []
    for name in df.columns:
        if name in fences:
            low, high = (F.lit(float(x)) for x in fences[name])
            v = as_double(name)
            out.append(F.when(v < low, low).when(v > high, high).otherwise(v).alias(name))
        else:
            out.append(col(name))
    return df.select(*out)


def cap_iqr(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    return cap(df, iqr_fences(df, list(columns or numeric_columns(df)), approx, spread_only=False))


def inf_to_null(df: DataFrame) -> DataFrame:
    """Infinite values, and NaN with them, become null."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = F.nanvl(col(f.name), F.lit(None).cast(f.dataType))
            out.append(F.when(F.abs(v) != float("inf"), v).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


@dataclass
class Cleaned:
    """A cleaned table, the log of the steps and the sizes before and after."""

    data: DataFrame
    before: DataFrame
    steps: list[tuple[str, str | None, str, float | None, float | None]] = field(default_factory=list)
    renames: list[tuple[str, str]] = field(default_factory=list)

    def log(self) -> DataFrame:
        """The steps in order: what was done to which column, with fill values and fences, and the names before and after."""
        names = ", ".join(f"{old} -> {new}" for old, new in self.renames)
        rows = [(i + 1, ACTIONS[s[0]], *s, names if s[0] == "normalize_columns" else None) for i, s in enumerate(self.steps)]
        return small_table(
            self.data.sparkSession,
            rows,
            "ord int, action string, operation string, column string, detail string, low double, high double, names string",
        )

    def renamed(self) -> DataFrame:
        """The columns that got another name, in their order."""
        rows = [(i + 1, *pair) for i, pair in enumerate(self.renames)]
        return small_table(self.data.sparkSession, rows, "ord int, before string, after string")

    def summary(self) -> DataFrame:
        """Rows, columns and missing cells of both tables, and what was done."""
        sides = [
            df.agg(F.count("*").alias("rows"), F.coalesce(missing_cells(df), F.lit(0)).alias("missing")).select(
                F.lit(side).alias("side"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), "missing"
            )
            for side, df in (("original", self.before), ("cleaned", self.data))
        ]
        done = {s[0] for s in self.steps}
        return sides[0].unionByName(sides[1]).select(
            "*",
            F.lit("drop_duplicates" in done).alias("rows_removed"),
            F.lit("fill_missing" in done).alias("cells_filled"),
            F.lit("cap_outliers" in done).alias("values_capped"),
        )


def resolve_columns(df: DataFrame, names: Sequence[str], normalized: bool) -> list[str]:
    """Original column names as they are called after an optional rename."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    if not normalized:
        return list(names)
    return [normalize_names(df.columns)[df.columns.index(n)] for n in names]


def _split_ids(df: DataFrame, accepted: Sequence[str]) -> dict[str, list[str]]:
    steps: dict[str, list[str]] = {"normalize_columns": [], "drop_duplicates": []}
    steps.update({s: [] for s in COLUMN_STEPS})
    chosen = []
    for ident in accepted:
        operation, _, column = ident.partition("::")
        if operation not in steps or bool(column) != (operation in COLUMN_STEPS):
            raise ValueError(f"unknown suggestion: {ident}")
        chosen.append(operation)
        if column:
            steps[operation].append(column)
    normalized = "normalize_columns" in chosen
    out = {s: resolve_columns(df, steps[s], normalized) for s in COLUMN_STEPS if steps[s]}
    return {s: out.get(s, []) for s in steps if s in chosen}


def apply_cleaning(df: DataFrame, accepted: Sequence[str], approx: bool = False) -> Cleaned:
    """Apply accepted suggestions: rename, deduplicate, convert, fill, cap, drop infinities.

    The order is fixed: a column is a number before its median is taken, and
    fences come from the filled column. After deduplication the rows are
    written once, so that later passes do not repeat that shuffle.
    """
    steps = _split_ids(df, accepted)
    out = Cleaned(df, df)
    data = df
    if "normalize_columns" in steps:
        data = normalize_columns(data)
        out.renames = [(a, b) for a, b in zip(df.columns, data.columns) if a != b]
        out.steps.append(("normalize_columns", None, f"{len(out.renames)} renamed", None, None))
    if "drop_duplicates" in steps:
        groups = data.groupBy(*[col(c) for c in data.columns]).agg(F.count("*").alias(COPIES))
        written = materialise(groups, "distinct")
        removed = written.agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0))).first()[0]
        data = written.drop(COPIES)
        out.steps.append(("drop_duplicates", None, f"{removed} removed", None, None))
    if "convert_numeric" in steps:
        data = to_numeric(data, steps["convert_numeric"])
        for c in steps["convert_numeric"]:
            out.steps.append(("convert_numeric", c, "to double", None, None))
    if "fill_missing" in steps:
        values = fill_values(data, steps["fill_missing"])
        data = fill_missing(data, values)
        for c in steps["fill_missing"]:
            value = values.get(c)
            number = value if isinstance(value, float) else None
            detail = "median" if number is not None else "nothing to fill with" if value is None else str(value)
            out.steps.append(("fill_missing", c, detail, number, number))
    if "cap_outliers" in steps:
        known = set(numeric_columns(data))
        fences = iqr_fences(data, [c for c in steps["cap_outliers"] if c in known], approx, spread_only=False)
        data = cap(data, fences)
        for c, (low, high) in fences.items():
            out.steps.append(("cap_outliers", c, "IQR", low, high))
    out.data = inf_to_null(data)
    return out
