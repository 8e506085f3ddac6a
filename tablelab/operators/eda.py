"""Exploratory statistics and the data behind the charts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelab.functions.columns import (
    NULL_LABEL,
    as_double,
    as_finite,
    categorical_columns,
    col,
    numeric_columns,
    rounded,
    row_digest,
)
from tablelab.operators.blocks import BLOCK, block_batch, merged
from tablelab.operators.stats import column_moments, numeric_summary, top_labels
from tablelab.session import small_table

# Bins of a histogram, rows of a top list, points of a density curve.
HISTOGRAM_BINS, CATEGORY_ROWS, KDE_GRID = 24, 12, 200
KDE_FINE = 256  # bins a bandwidth
SCATTER_POINTS = 1000  # most points a feature

DESCRIBE = "column string, count bigint, mean double, std double, min double, median double, max double"


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    return numeric_columns(df), categorical_columns(df)


def _finite(value: float | None) -> float | None:
    return value if value is not None and math.isfinite(value) else None


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Count, mean, sample deviation, min, median and max of every numeric column."""
    columns = list(columns or numeric_columns(df))
    found = numeric_summary(df, columns, (0.5,))
    rows = []
    for c in columns:
        s = found[c]
        rows.append((c, s.count, *map(_finite, (s.mean, s.std, s.min, s.quantiles.get(0.5), s.max))))
    out = small_table(df.sparkSession, rows, DESCRIBE)
    return out.select("column", "count", *[rounded(F.col(c), digits).alias(c) for c in out.columns[2:]])


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal bins over each column's range, empty bins included.

    A constant column has no range; it gets bins of one unit around its value.
    Infinite values count as missing.
    """
    columns = list(columns or numeric_columns(df))
    df = df.select(*[as_finite(c).alias(c) for c in columns])
    ranges = []
    for c, s in column_moments(df, columns).items():
        if s.count:
            ranges.append((c, *((s.min, s.max) if s.max > s.min else (s.min - 0.5, s.max + 0.5))))
    if not ranges:
        return small_table(df.sparkSession, [], "column string, bin int, bin_low double, bin_high double, n bigint")
    placed = df.select(*[_bin(col(c), low, high, bins).alias(f"{i}") for i, (c, low, high) in enumerate(ranges)])
    counted = (
        placed.unpivot([], [col(f"{i}") for i in range(len(ranges))], "i", "bin")
        .filter("bin is not null")
        .groupBy("i", "bin")
        .agg(F.count("*").alias("n"))
    )
    # One row per column with all its bins: at most ``bins`` entries each.
    filled = counted.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    facts = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit(low).alias("low"), F.lit(high).alias("high")) for c, low, high in ranges]
    )
    each = filled.select(
        facts[F.col("i").cast("int")].alias("f"), "m", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    )
    width = (F.col("f.high") - F.col("f.low")) / bins
    return each.select(
        F.col("f.column").alias("column"),
        "bin",
        (F.col("f.low") + (F.col("bin") - 1) * width).alias("bin_low"),
        (F.col("f.low") + F.col("bin") * width).alias("bin_high"),
        F.coalesce(F.col("m")[F.col("bin")], F.lit(0).cast("bigint")).alias("n"),
    )


def _bin(v: Column, low: float, high: float, bins: int) -> Column:
    """Equal bins numbered from 1; the last one includes the upper end."""
    at = F.floor((v - F.lit(low)) / F.lit(high - low) * bins) + 1
    return F.when(v.isNotNull(), F.least(F.lit(bins), at)).cast("int")


def kde_curve(df: DataFrame, column: str, grid: int = KDE_GRID) -> DataFrame:
    """The density of one column, as :func:`density_curves` has it."""
    return density_curves(df, [column], grid).select("grid_no", "x", "density")


def density_curves(df: DataFrame, columns: Sequence[str] | None = None, grid: int = KDE_GRID) -> DataFrame:
    """Gaussian densities with Scott's bandwidth on an even grid over each column's range.

    Rows are counted in bins of a 256th of the bandwidth, with the mean and the
    variance of each: a map-side combined aggregate in generated code, one for all
    columns. A bin adds to the grid points within nine bandwidths the kernel at its
    mean, corrected to the second order; what is left out is below 1e-9 of the
    density. Infinite values count as missing. A column of fewer than two values,
    or of equal ones, has no curve.
    """
    columns = list(columns or numeric_columns(df))
    df = df.select(*[as_finite(c).alias(c) for c in columns])
    kept = [(c, s) for c, s in column_moments(df, columns).items() if s.count >= 2 and s.var_pop]
    if not kept:
        return small_table(df.sparkSession, [], "column string, grid_no int, x double, density double")
    facts = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(float(s.min)).alias("low"),
                F.lit(float((s.max - s.min) / (grid - 1))).alias("step"),
                F.lit(float(s.std * s.count**-0.2)).alias("width"),
                F.lit(float(s.count)).alias("count"),
            )
            for c, s in kept
        ]
    )
    cells = df.select(*[col(c).alias(f"{i}") for i, (c, _) in enumerate(kept)])
    if len(kept) == 1:
        long = cells.select(F.lit(0).alias("i"), col("0").alias("v"))
    else:
        long = cells.unpivot([], [col(f"{i}") for i in range(len(kept))], "i", "v").select(F.col("i").cast("int").alias("i"), "v")
    f, v = facts[F.col("i")], F.col("v")
    bins = long.filter(v.isNotNull()).groupBy("i", F.floor((v - f["low"]) / (f["width"] / KDE_FINE)).alias("bin"))
    bins = bins.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var")).withColumn("f", f)
    low, step, width = F.col("f.low"), F.col("f.step"), F.col("f.width")
    place, reach = (F.col("mean") - low) / step, 9 * width / step  # beyond it a kernel is below 3e-18
    first, last = F.greatest(F.ceil(place - reach), F.lit(0)), F.least(F.floor(place + reach), F.lit(grid - 1))
    near = bins.filter(first <= last).select("i", "f", "n", "mean", "var", F.explode(F.sequence(first, last)).alias("grid_no"))
    z = (F.col("mean") - low - F.col("grid_no") * step) / width
    near = near.select("i", "grid_no", "n", (z * z).alias("z2"), (F.col("var") / (2 * width * width)).alias("spread"))
    kernels = F.col("n") * F.exp(F.col("z2") * -0.5) * (1 + (F.col("z2") - 1) * F.col("spread"))
    sums = near.groupBy("i", "grid_no").agg(F.sum(kernels).alias("s"))
    points = df.sparkSession.range(len(kept)).select(
        F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid - 1).cast("bigint"))).alias("grid_no")
    )
    curves = points.join(F.broadcast(sums), ["i", "grid_no"], "left").withColumn("f", f)  # as many rows as grid points
    return curves.select(
        "f.column",
        F.col("grid_no").cast("int").alias("grid_no"),
        (low + F.col("grid_no") * step).alias("x"),
        (F.coalesce("s", F.lit(0.0)) / (F.col("f.count") * width * math.sqrt(2 * math.pi))).alias("density"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlations over jointly present rows, long form; undefined ones are 0.

    A first pass finds means and constant columns. The second multiplies blocks
    of centred values, their squares and their presence with each other, for any
    number of columns; a task sends on one block.
    """
    columns = list(columns or numeric_columns(df))
    schema = "pos_a int, pos_b int, col_a string, col_b string, r double"
    if len(columns) < 2:
        return small_table(df.sparkSession, [], schema)
    found = column_moments(df, columns)
    live = [i for i, c in enumerate(columns) if found[c].count and found[c].max > found[c].min]
    centred = df.select(*[(as_double(columns[i]) - F.lit(found[columns[i]].mean)).alias(f"{i}") for i in live])
    r = {(i, j): 0.0 for i in range(len(columns)) for j in range(len(columns))}
    r.update({(i, i): 1.0 for i in live if found[columns[i]].count > 1})
    if len(live) > 1:
        size = len(live)

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((4 * size, size))
            for batch in batches:
                v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                there = ~np.isnan(v)
                v, m = np.where(there, v, 0.0), there.astype(float)
                total += np.vstack([v.T @ v, m.T @ m, v.T @ m, (v * v).T @ m])
            yield block_batch({0: total})

        n_cells = merged(centred.mapInArrow(products, BLOCK), size, np.add)[0].reshape(4, size, size)
        ab, n, sums, squares = n_cells
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb = squares - sums * sums / n, squares.T - sums.T * sums.T / n
            value = (ab - sums * sums.T / n) / np.sqrt(va) / np.sqrt(vb)
            # what is left of a constant after centring is rounding noise
            defined = (n > 0) & (va > squares * 1e-12) & (vb > squares.T * 1e-12) & np.isfinite(value)
        value = np.where(defined, np.clip(value, -1, 1), 0.0)
        r.update({(live[p], live[q]): float(value[p, q]) for p in range(size) for q in range(size) if p != q})
    rows = [(i, j, columns[i], columns[j], v) for (i, j), v in r.items()]
    return small_table(df.sparkSession, rows, schema).withColumn("r", rounded(F.col("r")))


def scatter_points(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """Every (feature, target) pair of values, long form."""
    features = list(features or [c for c in numeric_columns(df) if c != target])
    cells = df.select(as_double(target).alias("y"), *[as_double(c).alias(f"{i}") for i, c in enumerate(features)])
    names = F.array(*[F.lit(c) for c in features])
    return (
        cells.unpivot("y", [col(f"{i}") for i in range(len(features))], "i", "x")
        .filter("x is not null and y is not null")
        .select(names[F.col("i").cast("int")].alias("feature"), "x", "y")
    )


def scatter_sample(
    df: DataFrame, target: str, key: Sequence[str], features: Sequence[str] | None = None, points: int = SCATTER_POINTS
) -> DataFrame:
    """For each feature the ``points`` pairs of values whose rows have the smallest key digests: ``feature``, ``key``, ``x``, ``y``.

    Each task keeps the smallest ones of its own, and the same rows come out on every partitioning.
    """
    features = list(features or [c for c in numeric_columns(df) if c != target and c not in key])
    keys = [f"k{i}" for i in range(len(key))]
    cells = df.select(
        row_digest(key).alias("d"), *[col(k).alias(n) for k, n in zip(key, keys)], as_double(target).alias("y"),
        *[as_double(c).alias(f"{i}") for i, c in enumerate(features)],
    )
    names = F.array(*[F.lit(c) for c in features])
    pairs = cells.unpivot(["d", *keys, "y"], [col(f"{i}") for i in range(len(features))], "i", "x").filter("x is not null and y is not null")
    place = F.row_number().over(Window.partitionBy("i").orderBy("d", *keys))
    kept = pairs.withColumn("place", place).filter(F.col("place") <= points)
    return kept.select(names[F.col("i").cast("int")].alias("feature"), *[F.col(n).alias(k) for k, n in zip(key, keys)], "x", "y")


def scatter_bins(
    df: DataFrame, target: str, features: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """The same points as counts on a grid: a bounded result for a table of any size."""
    features = list(features or [c for c in numeric_columns(df) if c != target])
    found = column_moments(df, [*features, target])

    def place(c: str) -> Column:
        s = found[c]
        if not s.count:
            return F.lit(None).cast("int")
        if s.max > s.min:
            return _bin(as_double(c), s.min, s.max, bins)
        return F.when(as_double(c).isNotNull(), 1)

    cells = df.select(place(target).alias("y_bin"), *[place(c).alias(f"{i}") for i, c in enumerate(features)])
    names = F.array(*[F.lit(c) for c in features])
    return (
        cells.unpivot("y_bin", [col(f"{i}") for i in range(len(features))], "i", "x_bin")
        .filter("x_bin is not null and y_bin is not null")
        .groupBy("i", "x_bin", "y_bin")
        .agg(F.count("*").alias("n"))
        .select(names[F.col("i").cast("int")].alias("feature"), "x_bin", "y_bin", "n")
    )


def top_categories(df: DataFrame, columns: Sequence[str] | None = None, rows: int = CATEGORY_ROWS) -> DataFrame:
    """The most frequent values of the categorical columns, missing as a value of its own.

    Equal counts are ordered by value. No text is shuffled but those of the
    values that can be listed.
    """
    columns = list(columns or categorical_columns(df))
    if not columns:
        return small_table(df.sparkSession, [], "column string, value string, n bigint, rank int")
    return top_labels(df, columns, rows, NULL_LABEL).select("column", F.col("label").alias("value"), "n", "rank")


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values (missing not counted), top value and its count per categorical column."""
    columns = list(columns or categorical_columns(df))
    if not columns:
        return small_table(df.sparkSession, [], "column string, unique bigint, top string, top_count bigint")
    best = top_labels(df, columns, 1, NULL_LABEL)
    return best.select("column", "unique", F.col("label").alias("top"), F.col("n").alias("top_count"))
