import hashlib
import numpy as np
import pandas as pd
import pytest

from tablelab.operators import eda, findings


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 500
    x = rng.normal(size=n)
    data = pd.DataFrame({"x": x, "y": 2 * x + rng.normal(size=n), "const": 0.1, "gaps": np.where(rng.random(n) < 0.4, np.nan, x + rng.normal(size=n) * 0.1)})
    return data, spark.createDataFrame(data)


def test_describe(frame):
    data, df = frame
    got = eda.describe_numeric(df).toPandas().set_index("column")
    want = data.describe().T
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("median", "50%"), ("max", "max")):
        assert np.allclose(got[ours].astype(float), want[theirs], atol=1e-6)


def test_correlation(frame):
    data, df = frame
    got = eda.correlation_matrix(df).toPandas().pivot(index="pos_a", columns="pos_b", values="r").to_numpy()
    want = data.corr().fillna(0).to_numpy()
    want[2, :] = want[:, 2] = 0
    assert np.allclose(got, want, atol=1e-6)
    top = findings.top_correlations(eda.correlation_matrix(df)).collect()
    assert {top[0]["col_a"], top[0]["col_b"]} == {"x", "gaps"} and len(top) == 5


def test_histogram(frame):
    data, df = frame
    got = eda.histogram(df).toPandas()
    for c in ("x", "gaps"):
        counts, edges = np.histogram(data[c].dropna(), bins=24)
        part = got[got["column"] == c].sort_values("bin")
        assert part["n"].tolist() == counts.tolist()
        assert np.allclose(part["bin_low"], edges[:-1]) and np.allclose(part["bin_high"], edges[1:])
    assert got[got["column"] == "const"]["n"].sum() == len(data)


def test_kde(frame):
    data, df = frame
    got = eda.kde_curve(df, "x").toPandas().sort_values("grid_no")
    x = data["x"].to_numpy()
    width = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / width) ** 2).sum(axis=1) / (len(x) * width * np.sqrt(2 * np.pi))
    assert np.allclose(got["density"], want, rtol=1e-12)
    assert eda.kde_curve(df, "const").count() == 0


def test_scatter(frame):
    data, df = frame
    assert eda.scatter_points(df, "y", ["gaps"]).count() == data["gaps"].notna().sum()
    bins = eda.scatter_bins(df, "y").toPandas()
    assert bins.groupby("feature")["n"].sum().to_dict() == {"x": 500, "const": 500, "gaps": int(data["gaps"].notna().sum())}


def test_categories(spark):
    rows = [("a", None), ("b", None), ("a", None), (None, None), (None, None), ("空值", None)]
    df = spark.createDataFrame(rows, "s string, e string")
    top = [tuple(r) for r in eda.top_categories(df, ["s"]).orderBy("rank").collect()]
    assert top == [("s", "空值", 3, 1), ("s", "a", 2, 2), ("s", "b", 1, 3)]
    got = {r["column"]: tuple(r)[1:] for r in eda.describe_categorical(df).collect()}
    assert got == {"s": (3, "空值", 3), "e": (0, "空值", 6)}


def test_few_columns(spark):
    df = spark.createDataFrame([("a",)], "s string")
    assert eda.correlation_matrix(df).count() == 0
    assert eda.describe_numeric(df).count() == 0
    assert eda.histogram(df).count() == 0


def test_all_columns_by_default(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.normal(size=(80, 20)), columns=[f"c{i}" for i in range(20)])
    data = data.mask(rng.random(data.shape) < 0.1)
    df = spark.createDataFrame(data)
    got = eda.correlation_matrix(df).toPandas().pivot(index="pos_a", columns="pos_b", values="r").to_numpy()
    assert np.allclose(got, data.corr(), atol=1e-6)
    assert eda.histogram(df).select("column").distinct().count() == 20
    assert eda.scatter_bins(df, "c0").select("feature").distinct().count() == 19
    texts = df.select(*[df[c].cast("string") for c in df.columns])
    assert eda.describe_categorical(texts).count() == 20 and eda.top_categories(texts).select("column").distinct().count() == 20


def test_infinite_values_count_as_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)] + [(float("inf"),), (float("-inf"),), (None,)], "x double")
    plain = df.filter("abs(x) < 100")
    assert sorted(eda.histogram(df).collect()) == sorted(eda.histogram(plain).collect())
    assert sorted(eda.kde_curve(df, "x").collect()) == sorted(eda.kde_curve(plain, "x").collect())


def test_scatter_sample_is_the_same_on_every_partitioning(spark):
    rows = [(i, float(i % 7), None if i % 3 else float(i), float(i * i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    found = [sorted(map(tuple, eda.scatter_sample(df.repartition(p), "y", ["k"], points=40).collect())) for p in (1, 6)]
    assert found[0] == found[1] and len(found[0]) == 80
    want = sorted((r for r in rows if r[2] is not None), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())[:40]
    assert {r[1] for r in found[0] if r[0] == "b"} == {r[0] for r in want}


def test_density_of_many_columns_equals_that_of_each(spark):
    df = spark.range(500).selectExpr("cast(id as double) a", "sin(id) b", "1.5 c", "if(id % 3 = 0, null, id * id) d", "cast('Infinity' as double) e")
    many = eda.density_curves(df, ["a", "b", "c", "d", "e"]).toPandas()
    assert sorted(set(many["column"])) == ["a", "b", "d"] and len(many) == 600
    for c in "abd":
        one = eda.kde_curve(df, c).toPandas().sort_values("grid_no")
        part = many[many["column"] == c].sort_values("grid_no")
        assert np.allclose(one["density"], part["density"], rtol=1e-12) and np.allclose(one["x"], part["x"])
        values = np.array([r[0] for r in df.select(c).dropna().collect()])
        width = values.std(ddof=1) * len(values) ** -0.2
        want = np.exp(-0.5 * ((part["x"].to_numpy()[:, None] - values) / width) ** 2).sum(1) / (len(values) * width * np.sqrt(2 * np.pi))
        assert np.allclose(part["density"], want, rtol=0, atol=1e-6 * want.max())
