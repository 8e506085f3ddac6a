import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tablelab.operators import stats


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    n = 20000
    data = pd.DataFrame(
        {
            "normal": rng.normal(size=n),
            "heavy": rng.standard_cauchy(n) * 1e5,
            "hot": np.where(rng.random(n) < 0.4, 3.25, rng.normal(size=n)),
            "const": 1.1,
            "narrow": 1 + rng.random(n) * 1e-9,
            "whole": rng.integers(-5, 5, n),
            "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.random(n)),
            "empty": np.nan,
        }
    )
    return data, spark.createDataFrame(data).repartition(6)


@pytest.mark.parametrize("gather,split", [(1 << 20, 4096), (300, 16)])
def test_quantiles_equal_interpolated_ones(frame, monkeypatch, gather, split):
    data, df = frame
    monkeypatch.setattr(stats, "GATHER", gather)
    monkeypatch.setattr(stats, "SPLIT", split)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    found = stats.numeric_summary(df, list(data.columns), probs)
    for c in data.columns[:-1]:
        want = data[c].quantile(list(probs))
        for p in probs:
            assert found[c].quantiles[p] == pytest.approx(want[p], rel=1e-12, abs=0), (c, p)
        assert found[c].count == data[c].count()
        assert found[c].missing == data[c].isna().sum()
        assert found[c].mean == pytest.approx(data[c].mean(), rel=1e-9, abs=1e-9)
        assert found[c].std == pytest.approx(data[c].std(), rel=1e-6, abs=1e-12)
    assert found["empty"].count == 0 and found["empty"].missing == len(data)
    assert found["empty"].quantiles == {}


def test_moments_agree_between_narrow_and_wide_path(frame, monkeypatch):
    data, df = frame
    flat = stats.column_moments(df, list(data.columns))
    monkeypatch.setattr(stats, "WIDE", 0)
    long = stats.column_moments(df, list(data.columns))
    for c in data.columns:
        assert flat[c].count == long[c].count and flat[c].missing == long[c].missing
        assert flat[c].min == long[c].min and flat[c].max == long[c].max
        if flat[c].count:
            assert flat[c].var_pop == pytest.approx(long[c].var_pop, rel=1e-9, abs=1e-15)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert stats.numeric_summary(df, ["a"], (0.5,))["a"].count == 0
    assert stats.modes(df, ["b"]) == {"b": None}


def test_mode_takes_lowest_on_ties_and_skips_missing(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None), (None, None), (None, None)], "x string, y string")
    assert stats.modes(df, ["x", "y"]) == {"x": "a", "y": None}


def test_value_counts_keep_missing_apart_from_its_label(spark):
    df = spark.createDataFrame([("空值",), (None,), (None,)], "x string")
    found = {(r["value"], r["n"]) for r in stats.value_counts(df, ["x"]).collect()}
    assert found == {("空值", 1), (None, 2)}


@pytest.mark.parametrize("lookup", [10_000, 0])
def test_top_labels_of_long_texts(spark, monkeypatch, lookup):
    monkeypatch.setattr(stats, "LOOKUP", lookup)
    rng = np.random.default_rng(4)
    same = "one beginning that many texts share, "
    pool = [same + str(i) for i in range(40)] + ["short", "", "x" * 15, "x" * 16, "é" * 8, "z" * 100_000] + [f"other {i} of the long ones" for i in range(30)]
    texts = [pool[i] for i in rng.integers(0, len(pool), 400)] + [None] * 9 + ["x" * 16] * 150
    df = spark.createDataFrame([(t, None if i % 2 else "b", None) for i, t in enumerate(texts)], "t string, u string, v string").repartition(7)
    for missing in (None, "none"):
        for rows in (1, 12, 500):
            got = stats.top_labels(df, ["t", "u", "v"], rows, missing).collect()
            for c, values in (("t", texts), ("u", [None if i % 2 else "b" for i in range(len(texts))]), ("v", [None] * len(texts))):
                held = Counter(v if v is not None else missing for v in values if v is not None or missing is not None)
                want = sorted(held.items(), key=lambda x: (-x[1], x[0].encode()))[:rows]
                found = sorted((r for r in got if r["column"] == c), key=lambda r: r["rank"])
                assert [(r["label"], r["n"]) for r in found] == want, (c, missing, rows)
                assert {r["unique"] for r in found} <= {len({v for v in values if v is not None})}
    assert stats.top_labels(df.limit(0), ["t"], 3, "none").count() == 0


def test_plans_carry_no_long_text(spark, tmp_path):
    from tablelab.operators import profile

    spark.createDataFrame([("y" * 50, 1)], "t string, k int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for out in (profile.profile_columns(df), profile.duplicate_count(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert exchanges and "octet_length" in plan and not any(re.search(r"\bt#", line) for line in exchanges)
