"""Feature preparation: selection, target, imputation, scaling, encoding, splits."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablelab.functions.columns import (
    as_double,
    categorical_columns,
    col,
    digest_word,
    numeric_columns,
    parse_number,
    text_key,
)
from tablelab.operators.stats import Summary, column_moments, medians, numeric_summary, value_counts
from tablelab.session import materialise

# Sizes of the encoding, the split and the folds.
MAX_LEVELS = 20
TEST_PER_10000 = 2200
MIN_ROWS = 12
INFREQUENT = "infrequent_sklearn"

SEEN_LEVELS = 200_000  # most rare levels, of 16 bytes each, that are sent to every task


def select_features(df: DataFrame, target: str, features: Sequence[str] = ()) -> list[str]:
    """The named features, or every column where none is named, without the target. Unknown names are errors."""
    if unknown := sorted({target, *features}.difference(df.columns)):
        raise ValueError(f"no such columns: {unknown}")
    wanted = dict.fromkeys(features or df.columns)
    wanted.pop(target, None)
    if not wanted:
        raise ValueError("a model needs a feature besides its target")
    return list(wanted)


def prepare_target(
    df: DataFrame, target: str, features: Sequence[str], key: Sequence[str] = (), check: bool = True
) -> DataFrame:
    """The model's columns, target as a double, rows without a target dropped."""
    kind = df.schema[target].dataType
    if isinstance(kind, T.NumericType):
        y = as_double(target)
    elif isinstance(kind, T.BooleanType):
        y = col(target).cast("double")
    else:
        y = parse_number(col(target).cast("string"))
    kept = [c for c in dict.fromkeys([*key, *features]) if c != target]
    out = df.select(*[col(c) for c in kept], y.alias(target)).filter(col(target).isNotNull())
    if check and out.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"fewer than {MIN_ROWS} rows have a target")
    return out


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    fill = medians(df, columns)
    return df.withColumns({c: F.coalesce(as_double(c), F.lit(fill[c])) for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from tablelab.operators.cleaning import fill_mode

    return fill_mode(df, columns)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column becomes 0."""
    found = column_moments(df, columns)
    out = {}
    for c in columns:
        s = found[c]
        scale = math.sqrt(s.var_pop) if s.count and s.max > s.min else 1.0
        out[c] = (as_double(c) - F.lit(s.mean)) / F.lit(scale)
    return df.withColumns(out)


@dataclass(frozen=True)
class NumericFeature:
    column: str
    fill: float
    mean: float
    scale: float

    @property
    def names(self) -> list[str]:
        return [f"numeric__{self.column}"]

    def value(self) -> Column:
        return (F.coalesce(as_double(self.column), F.lit(self.fill)) - F.lit(self.mean)) / F.lit(self.scale)


@dataclass(frozen=True)
class CategoryFeature:
    """One output per kept level; rarer levels share one output when there are too many."""

    column: str
    fill: str
    levels: tuple[str, ...]
    capped: bool

    @property
    def names(self) -> list[str]:
        rest = (INFREQUENT,) if self.capped else ()
        return [f"category__{self.column}_{level}" for level in self.levels + rest]

    @property
    def seen(self) -> str:
        return f"_seen__{self.column}"

    def text(self) -> Column:
        return F.coalesce(col(self.column).cast("string"), F.lit(self.fill))

    def code(self, scoring: bool) -> Column:
        """Position of the output that is 1, or -1 when there is none."""
        at = F.array_position(F.array(*[F.lit(x) for x in self.levels]), self.text()).cast("int") - 1
        if not self.capped:
            return at
        rest = F.lit(len(self.levels))
        if scoring:
            rest = F.when(col(self.seen), rest).otherwise(-1)
        return F.when(at >= 0, at).otherwise(rest)


@dataclass(frozen=True)
class FeatureSpec:
    """Everything learned from the rows it was fitted on: a few values per column."""

    numeric: tuple[NumericFeature, ...]
    category: tuple[CategoryFeature, ...]
    target: Summary = field(default_factory=Summary)

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], target: str, max_levels: int = MAX_LEVELS) -> FeatureSpec:
        """One pass for the numeric columns and the target, one for the categorical ones.

        Medians are looked up only for columns with gaps. A column without any
        value is left out.
        """
        numeric = [c for c in features if c in numeric_columns(df)]
        found = column_moments(df, [*numeric, target])
        fill = medians(df, [c for c in numeric if found[c].count and found[c].missing])
        out = []
        for c in numeric:
            s = found[c]
            if not s.count:
                continue
            f, share = fill.get(c, s.mean), s.missing / (s.count + s.missing)
            mean = s.mean + share * (f - s.mean)
            var = (1 - share) * s.var_pop + share * (1 - share) * (f - s.mean) ** 2
            varies = s.max > s.min or (s.missing and f != s.min)
            out.append(NumericFeature(c, f, mean, math.sqrt(var) if varies and var > 0 else 1.0))
        text = [c for c in features if c not in numeric]
        return cls(tuple(out), cls._fit_categories(df, text, max_levels), found[target])

    @staticmethod
    def _fit_categories(df: DataFrame, columns: Sequence[str], max_levels: int) -> tuple[CategoryFeature, ...]:
        if not columns:
            return ()
        counts = value_counts(df, columns)
        real = F.col("value").isNotNull()
        # Per column: the fill value (lowest of the most frequent ones), gaps and levels ...
        facts = counts.groupBy("column").agg(
            F.min(F.when(real, F.struct((-F.col("n")).alias("m"), "value"))).alias("x"),
            F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("gaps"),
            F.count("value").alias("levels"),
        )
        # ... and its most frequent levels. Spark limits each partition to these
        # before the ranking shuffle, and shuffles the counts once for both.
        order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").desc())
        top = counts.filter(real).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_levels)
        both = facts.select("column", F.col("x.value").alias("value"), F.lit(0).alias("rank"), "gaps", "levels").unionByName(
            top.select("column", "value", "rank"), allowMissingColumns=True
        )
        found: dict[str, list] = {c: [] for c in columns}
        for r in both.collect():
            found[r["column"]].append(r)
        out = []
        for c in columns:
            fact, *ranked = sorted(found[c], key=lambda r: r["rank"])
            if not fact["levels"]:
                continue
            kept = [r["value"] for r in ranked]
            capped = fact["levels"] > max_levels
            if capped and fact["gaps"]:  # filled cells make the fill value the most frequent
                kept = [fact["value"], *[v for v in kept if v != fact["value"]]]
            if capped:
                kept = kept[: max_levels - 1]
            out.append(CategoryFeature(c, fact["value"], tuple(sorted(kept)), capped))
        return tuple(out)

    @property
    def names(self) -> list[str]:
        return [n for f in (*self.numeric, *self.category) for n in f.names]

    @property
    def width(self) -> int:
        return len(self.names)

    @property
    def slots(self) -> list[str]:
        """Names of the columns :meth:`encode` adds."""
        return [f"_z{i}" for i in range(self.width)]

    def encode(self, df: DataFrame, scoring: bool = False) -> DataFrame:
        """The rows with the encoded columns added; every level position is looked up once."""
        codes = {f"_c{i}": f.code(scoring) for i, f in enumerate(self.category)}
        out = [f.value() for f in self.numeric]
        for i, f in enumerate(self.category):
            out += [F.when(F.col(f"_c{i}") == k, 1.0).otherwise(0.0) for k in range(len(f.names))]
        rows = df.withColumns(codes) if codes else df
        return rows.withColumns(dict(zip(self.slots, out))).drop(*codes)

    def products(self, degree: int = 2) -> list[Column]:
        """The encoded columns, then for degree 2 their squares and products."""
        z = [F.col(s) for s in self.slots]
        if degree == 2:
            z = z + [z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))]
        return z

    def compact(self, scoring: bool = False) -> list[Column]:
        """One column per feature: scaled values and level positions."""
        out = [f.value().alias(f"n{i}") for i, f in enumerate(self.numeric)]
        return out + [f.code(scoring).alias(f"c{i}") for i, f in enumerate(self.category)]

    def reader(self, degree: int = 1) -> Callable[[pa.RecordBatch], np.ndarray]:
        """A function from a batch, whose first columns are :meth:`compact`, to its dense encoded rows.

        It holds a few numbers only, so executors need nothing of this package.
        """
        numeric, widths = len(self.numeric), [len(f.names) for f in self.category]

        def block(batch: pa.RecordBatch) -> np.ndarray:
            x = np.zeros((batch.num_rows, numeric + sum(widths)))
            for i in range(numeric):
                x[:, i] = batch.column(i).to_numpy(zero_copy_only=False)
            at = numeric
            for i, width in enumerate(widths):
                code = batch.column(numeric + i).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(code >= 0)
                x[hit, at + code[hit]] = 1.0
                at += width
            if degree == 2:
                x = np.hstack([x, *[x[:, i : i + 1] * x[:, i:] for i in range(x.shape[1])]])
            return x

        return block

    def expanded_width(self, degree: int = 1) -> int:
        return self.width if degree == 1 else self.width * (self.width + 3) // 2

    def expansion(self, degree: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The products that are columns of their own, as positions ``left`` and ``right`` of encoded columns, and the ``place`` of every expanded column.

        An output of a category is 0 or 1, so its square is that output itself, and
        the product of two outputs of one category is zero (place -1). Places count
        the encoded columns first, then the products.
        """
        of = [-1 - i for i in range(len(self.numeric))] + [i for i, f in enumerate(self.category) for _ in f.names]
        left, right, place = [], [], list(range(len(of)))
        for i in range(len(of)) if degree == 2 else ():
            for j in range(i, len(of)):
                if of[i] == of[j] >= 0:
                    place.append(i if i == j else -1)
                else:
                    place.append(len(of) + len(left))
                    left.append(i)
                    right.append(j)
        return np.array(left, int), np.array(right, int), np.array(place, int)

    def mark_seen(self, df: DataFrame, fitted_on: DataFrame) -> DataFrame:
        """Flag, per capped column, whether a row's value occurred in the fitted rows.

        A rare level scores as "infrequent", a new one as nothing. The rare levels
        of all columns are written once, as keys of at most 16 bytes. Up to
        ``SEEN_LEVELS`` of them are sent to the tasks, and the rows are not shuffled;
        more are joined. Kept levels, the frequent ones, are known: only other
        rows are looked up, and kept ones spread over all tasks.
        """
        capped = [f for f in self.category if f.capped]
        if not capped:
            return df
        rare = [F.when(~f.text().isin(*f.levels), text_key(f.text())).alias(f"{i}") for i, f in enumerate(capped)]
        cells = fitted_on.select(*rare).unpivot([], [col(f"{i}") for i in range(len(capped))], "i", "_level")
        levels = materialise(cells.filter("_level is not null").select(F.col("i").cast("int").alias("i"), "_level").distinct(), "levels")
        few = levels.count() <= SEEN_LEVELS
        for i, f in enumerate(capped):
            kept = f.text().isin(*f.levels)
            own = levels.filter(F.col("i") == i).select("_level", F.lit(True).alias(f.seen))
            if few:
                df = df.withColumn("_kept", kept).join(F.broadcast(own), text_key(f.text()) == F.col("_level"), "left").drop("_level")
            else:
                own = own.withColumn("_spread", F.lit(0))
                spread = F.when(kept, F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(1023)) + 1).otherwise(0)
                on = (text_key(f.text()) == F.col("_level")) & (spread == F.col("_spread"))
                df = df.withColumn("_kept", kept).join(own, on, "left").drop("_level", "_spread")
            df = df.withColumn(f.seen, F.coalesce(col(f.seen), F.col("_kept"))).drop("_kept")
        return df


def one_hot_topk(df: DataFrame, column: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Rows per output of the capped one-hot encoding of one column."""
    spec = FeatureSpec(numeric=(), category=FeatureSpec._fit_categories(df, [column], max_levels))
    f = spec.category[0]
    names = F.array(*[F.lit(n) for n in f.names])
    counted = df.groupBy(f.code(False).alias("code")).agg(F.count("*").alias("n"))
    return counted.select(names[F.col("code")].alias("output"), "n")


def poly2(df: DataFrame, spec: FeatureSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Encoded columns with their squares and products."""
    z = spec.names
    names = z + [f"{z[i]} {z[j]}" if i != j else f"{z[i]}^2" for i in range(len(z)) for j in range(i, len(z))]
    rows = spec.encode(df)
    return rows.select(*[col(c) for c in keep], *[e.alias(n) for e, n in zip(spec.products(), names)])


def _digest(key: Sequence[str], part: int) -> Column:
    """A part of the key digest as a double; its whole range is exact."""
    return digest_word(key, part).cast("double")


def _smallest(df: DataFrame, value: Column, ranks: Sequence[int], count: int) -> list[float]:
    """The values of the given ranks (from 1) of ``count``: an exact search, no sort."""
    probs = {r: (r - 1) / max(count - 1, 1) for r in ranks}
    found = numeric_summary(df.select(value.alias("v")), ["v"], sorted(set(probs.values())))["v"].quantiles
    return [float(round(found[probs[r]])) for r in ranks]


def test_limit(df: DataFrame, key: Sequence[str], count: int | None = None) -> float:
    """The digest up to which a row is a test row: that of rank 22 % of the rows, rounded up. -1 for no rows."""
    count = df.count() if count is None else count
    return _smallest(df, _digest(key, 0), [math.ceil(count * TEST_PER_10000 / 10000)], count)[0] if count else -1.0


def train_test_split(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; rows with one key stay together."""
    limit = F.lit(test_limit(df, key))
    return df.filter(_digest(key, 0) > limit), df.filter(_digest(key, 0) <= limit)


def fold_count(train_rows: int) -> int:
    return min(5, max(2, train_rows // 6))


def fold_number(df: DataFrame, key: Sequence[str], folds: int, count: int | None = None) -> Column:
    """Folds of equal size, by ranges of a part of the key digest that the split does not use."""
    count = df.count() if count is None else count
    if not count:
        return F.lit(0)
    cuts = _smallest(df, _digest(key, 1), [max(1, math.ceil(count * i / folds)) for i in range(1, folds)], count)
    return sum(((_digest(key, 1) > F.lit(c)).cast("int") for c in cuts), F.lit(0))


def assign_folds(df: DataFrame, key: Sequence[str], folds: int) -> DataFrame:
    return df.withColumn("fold", fold_number(df, key, folds))


def with_split(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``_test`` and, counted over the training rows, ``_fold``."""
    limit = F.lit(test_limit(df, key))
    train = df.filter(_digest(key, 0) > limit)
    count = train.count()
    return df.withColumns({"_test": _digest(key, 0) <= limit, "_fold": fold_number(train, key, fold_count(count), count)})
