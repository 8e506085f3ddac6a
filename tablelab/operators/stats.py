"""Column statistics that the other operators are built on.

Exact quantiles never gather a column in one place. A first pass counts the
values of every column in fine logarithmic bins, with the moments of each bin;
only the bins that hold a wanted rank are looked at again, split further while
they are large. Each pass is a map-side combined aggregate over few groups, so
a heavily repeated value costs one group and nothing more.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelab.functions.columns import KEY_BYTES, as_double, col, text_key
from tablelab.session import small_table

BINS_PER_E = 128  # first-pass bins per factor e of magnitude, 0.8 % wide
SPLIT = 4096  # parts a large bin is split into
GATHER = 1 << 20  # most values that are brought together to pick the ranks
START = 16  # characters that order equally frequent values before their texts are looked up
LOOKUP = 10_000  # most values whose texts are looked up by keys sent to every task
WIDE = 48  # most columns of one flat aggregate or one pass over bins


@dataclass
class Summary:
    """Statistics of one numeric column."""

    count: int = 0
    missing: int = 0
    mean: float | None = None
    var_pop: float | None = None
    min: float | None = None
    max: float | None = None
    quantiles: dict[float, float] = field(default_factory=dict)

    @property
    def std(self) -> float | None:
        if self.count < 2 or self.var_pop is None:
            return None
        return math.sqrt(self.var_pop * self.count / (self.count - 1))


def long_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``(i, v)`` per cell; ``i`` is the position in ``columns``, as text."""
    cells = df.select(*[as_double(c).alias(f"{i}") for i, c in enumerate(columns)])
    return cells.unpivot([], [col(f"{i}") for i in range(len(columns))], "i", "v")


def order_bin(v: Column, per_e: int = BINS_PER_E) -> Column:
    """A bin number that never falls as ``v`` rises, of even relative width."""
    magnitude = F.floor((F.ln(F.abs(v)) + 750) * per_e)  # ln of the least double is -745
    return F.when(v > 0, magnitude).when(v < 0, -magnitude).when(v == 0, F.lit(0))


def column_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Summary]:
    """Count, missing, mean, variance, min and max of each column in one pass."""
    if not columns:
        return {}

    def aggregates(v: Column) -> list[Column]:
        return [F.count("*"), F.count(v), F.avg(v), F.var_pop(v), F.min(v), F.max(v)]

    if len(columns) <= WIDE:
        cells = df.select(*[as_double(c).alias(f"{i}") for i, c in enumerate(columns)])
        row = list(cells.agg(*[a for i in range(len(columns)) for a in aggregates(col(f"{i}"))]).first())
        parts = {i: row[6 * i : 6 * i + 6] for i in range(len(columns))}
    else:
        rows = long_doubles(df, columns).groupBy("i").agg(*aggregates(F.col("v"))).collect()
        parts = {int(r[0]): list(r)[1:] for r in rows}
    out = {}
    for i, c in enumerate(columns):
        total, n, mean, var, low, high = parts.get(i, (0, 0, None, None, None, None))
        out[c] = Summary(n, total - n, mean, var, low, high)
    return out


@dataclass
class _Bin:
    column: int
    low: float
    high: float
    before: int
    count: int
    ranks: list[int]

    def settle(self, found: dict[tuple[int, int], float]) -> bool:
        """Take the ranks the bounds already tell; true when none are left."""
        left = []
        for r in self.ranks:
            if self.low == self.high or r == self.before:
                found[self.column, r] = self.low
            elif r == self.before + self.count - 1:
                found[self.column, r] = self.high
            else:
                left.append(r)
        self.ranks = left
        return not left


def _rank_pair(n: int, p: float) -> tuple[int, int, float]:
    at = p * (n - 1)
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def _cells_in(df: DataFrame, columns: Sequence[str], bins: list[_Bin], part: bool) -> DataFrame:
    """``(b, v[, s])`` for every cell inside one of the value ranges ``bins``."""
    structs = []
    for b, r in enumerate(bins):
        v = col(f"{r.column}")
        fields = [F.lit(b).alias("b"), v.alias("v")]
        if part:
            share = (v - F.lit(r.low)) / F.lit(r.high - r.low)
            fields.append(F.least(F.floor(share * SPLIT), F.lit(SPLIT - 1)).alias("s"))
        structs.append(F.when(v.between(r.low, r.high), F.struct(*fields)))
    used = sorted({r.column for r in bins})
    cells = df.select(*[as_double(columns[i]).alias(f"{i}") for i in used])
    # No filter before: it would work out each cell anew for every bound it is held against.
    return cells.select(F.explode(F.array_compact(F.array(*structs))).alias("x")).select("x.*")


def _descend(df: DataFrame, columns: Sequence[str], bins: list[_Bin]) -> dict[tuple[int, int], float]:
    """The values at the wanted ranks of ``bins``, by splitting until they are small."""
    found: dict[tuple[int, int], float] = {}
    bins = [b for b in bins if not b.settle(found)]
    while bins:
        small = [b for b in bins if b.count <= GATHER // len(bins)]
        large = [b for b in bins if b.count > GATHER // len(bins)]
        if small:
            # At most GATHER values in all, counted above; no shuffle.
            values = _cells_in(df, columns, small, False).toPandas()
            for i, part in values.groupby("b")["v"]:
                b, ordered = small[i], np.sort(part.to_numpy())
                found.update({(b.column, r): float(ordered[r - b.before]) for r in b.ranks})
        bins = []
        if large:
            groups = (
                _cells_in(df, columns, large, True)
                .groupBy("b", "s")
                .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
                .toPandas()  # at most SPLIT rows per bin
            )
            for i, part in groups.sort_values("s").groupby("b"):
                b, after = large[i], np.cumsum(part["n"].to_numpy())
                for k in np.unique(np.searchsorted(after, [r - b.before for r in b.ranks], side="right")):
                    n = int(part["n"].iloc[k])
                    start = b.before + int(after[k]) - n
                    ranks = [r for r in b.ranks if start <= r < start + n]
                    low, high = float(part["low"].iloc[k]), float(part["high"].iloc[k])
                    bins.append(_Bin(b.column, low, high, start, n, ranks))
            bins = [b for b in bins if not b.settle(found)]
    return found


def numeric_summary(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = ()
) -> dict[str, Summary]:
    """Moments, extremes and exact linearly interpolated quantiles per column.

    Two passes for most data; one more for each factor ``SPLIT`` of rows.
    """
    if not probs:
        return column_moments(df, columns)
    out: dict[str, Summary] = {}
    for start in range(0, len(columns), WIDE):
        out.update(_binned_summary(df, columns[start : start + WIDE], probs))
    return out


def _binned_summary(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, Summary]:
    v = F.col("v")
    bins = (
        long_doubles(df, columns)
        .groupBy("i", order_bin(v).alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.avg(v).alias("mean"),
            F.var_pop(v).alias("var"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
        )
        # One row per column and bin: at most BINS_PER_E for each factor e between least and largest size, of either sign.
        .toPandas()
    )
    out = {c: Summary() for c in columns}
    open_bins: list[_Bin] = []
    for i, part in bins.groupby(bins["i"].astype(int)):
        s = out[columns[i]]
        held = part[part["bin"].notna()].sort_values("bin")
        s.missing = int(part.loc[part["bin"].isna(), "n"].sum())
        if not len(held):
            continue
        n = held["n"].to_numpy()
        mean, var = held["mean"].to_numpy(), held["var"].to_numpy()
        after = np.cumsum(n)
        s.count, s.min, s.max = int(after[-1]), float(held["low"].min()), float(held["high"].max())
        with np.errstate(invalid="ignore"):  # infinite values have no finite moments
            s.mean = float((n * mean).sum() / s.count)
            s.var_pop = float((n * (var + (mean - s.mean) ** 2)).sum() / s.count)
        ranks = sorted({r for p in probs for r in _rank_pair(s.count, p)[:2]})
        for k in np.unique(np.searchsorted(after, ranks, side="right")):
            before = int(after[k] - n[k])
            here = [r for r in ranks if before <= r < after[k]]
            low, high = held["low"].iloc[k], held["high"].iloc[k]
            open_bins.append(_Bin(i, float(low), float(high), before, int(n[k]), here))
    found = _descend(df, columns, open_bins)
    for i, c in enumerate(columns):
        s = out[c]
        for p in probs if s.count else ():
            low, high, share = _rank_pair(s.count, p)
            a, b = found[i, low], found[i, high]
            s.quantiles[p] = a if a == b else a + (b - a) * share
    return out


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    found = numeric_summary(df, columns, (0.5,))
    return {c: found[c].quantiles.get(0.5) for c in columns}


def _long_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = df.select(*[col(c).cast("string").alias(f"{i}") for i, c in enumerate(columns)])
    return cells.unpivot([], [col(f"{i}") for i in range(len(columns))], "i", "value")


def _named(columns: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in columns])[F.col("i").cast("int")].alias("column")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)``: every distinct value of the columns, as text.

    One scan and one shuffle for all columns; repeated values are combined
    before the shuffle. ``value`` is null for missing cells.
    """
    counts = _long_texts(df, columns).groupBy("i", "value").agg(F.count("*").alias("n"))
    return counts.select(_named(columns), "value", "n")


def top_labels(df: DataFrame, columns: Sequence[str], rows: int, missing: str | None = None) -> DataFrame:
    """``(column, label, n, rank, unique)``: the most frequent values of each column, equal counts in order of the value.

    Missing cells count as the label ``missing``, or not at all; ``unique`` never
    counts them. Values are counted by keys of at most 16 bytes and their first
    ``START`` characters. Those that can be among the first ``rows`` get their
    texts in a second scan, which is left out if keys are texts. There are ``rows`` of
    them and what ties with the last one; more than ``LOOKUP`` in all are joined
    instead of sent to the tasks.
    """
    cells = _long_texts(df, columns)
    label = F.col("value") if missing is None else F.coalesce("value", F.lit(missing))
    cells = cells.select(F.col("i").cast("int").alias("i"), "value", label.alias("label")).filter("label is not null")
    key = text_key(F.col("label")).alias("key")
    groups = cells.groupBy("i", key, F.substring("label", 1, START).alias("start"))
    groups = groups.agg(F.count("*").alias("n"), F.count("value").alias("real"))
    unique = F.broadcast(groups.groupBy("i").agg(F.count_if(F.col("real") > 0).alias("unique")))  # a row a column
    place = F.rank().over(Window.partitionBy("i").orderBy(F.col("n").desc(), "start"))
    near = groups.withColumn("place", place).filter(F.col("place") <= rows).join(unique, "i").select("i", "key", "n", "unique")
    first = near.limit(LOOKUP + 1).collect()
    few = len(first) <= LOOKUP
    if few:
        near = small_table(df.sparkSession, [(r["i"], bytes(r["key"]), r["n"], r["unique"]) for r in first], "i int, key binary, n bigint, unique bigint")
    short = F.octet_length("key") < KEY_BYTES
    out = near.filter(short).select("i", F.col("key").cast("string").alias("label"), "n", "unique")
    if not few or any(len(r["key"]) >= KEY_BYTES for r in first):
        asked = near.filter(~short)
        texts = cells.filter(F.octet_length("label") >= KEY_BYTES).select("i", key, "label")
        found = texts.join(F.broadcast(asked) if few else asked, ["i", "key"]).select("i", "label", "n", "unique").distinct()
        out = out.unionByName(found)
    order = Window.partitionBy("i").orderBy(F.col("n").desc(), "label")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows).select(_named(columns), "label", "n", "rank", "unique")


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value of each column, the lowest one on a tie."""
    if not columns:
        return {}
    found = {r["column"]: r["label"] for r in top_labels(df, columns, 1).collect()}
    return {c: found.get(c) for c in columns}
