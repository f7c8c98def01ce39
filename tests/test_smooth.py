"""Local regression from moments against an exact local fit over the points."""

import numpy as np
import pandas as pd
import pytest

from dugout.operators.smooth import bin_moments, local_fits, smooth_trend


def exact_fit(x, y, at, span):
    """Weighted quadratic over all points, one position at a time."""
    out = []
    wanted = int(max(1, np.floor(len(x) * span + 1e-5)))
    for x0 in at:
        d = np.abs(x - x0)
        h = np.sort(d)[wanted - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        u = (x - x0) / h
        design = np.stack([np.ones_like(u), u, u * u], axis=1)
        beta, *_ = np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)
        out.append((beta[0], np.sqrt((w * (y - design @ beta) ** 2).sum() / w.sum())))
    return np.array(out)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(85, 12, 4000), rng.uniform(40, 130, 500)])
    return pd.DataFrame({"x": x, "y": np.sin(x / 15) + x / 60 + rng.normal(0, 0.2, len(x)), "g": rng.integers(0, 2, len(x))})


@pytest.mark.parametrize("span", [0.75, 0.3, 0.1, 1.0])
def test_curve_is_close_to_an_exact_local_fit(spark, points, span):
    df = spark.createDataFrame(points)
    moments = bin_moments(df, {"x": (30, 140)}, ["y"], bins=500, by=["g"])
    got = smooth_trend(moments, points=30, span=span, by=["g"]).toPandas()
    assert len(got) == 60
    for g, curve in got.groupby("g"):
        mine = points[points["g"] == g]
        want = exact_fit(mine["x"].to_numpy(), mine["y"].to_numpy(), curve["x_at"].to_numpy(), span)
        # The spread of y is 0.65; the bins move the curve by less than half a percent of that.
        assert np.abs(curve["fit"] - want[:, 0]).max() < 0.003
        assert np.abs(curve["spread"] - want[:, 1]).max() < 0.003


def test_moments_of_two_tables_add_up(spark, points):
    xs, names = {"x": (30, 140)}, ["n", "x1", "x2", "x3", "x4", "y0", "y1", "y2", "yy"]
    whole, *parts = (
        bin_moments(spark.createDataFrame(p), xs, ["y"], bins=50).toPandas().set_index("bin")[names]
        for p in (points, points[:2000], points[2000:]))
    added = parts[0].add(parts[1], fill_value=0).loc[whole.index]
    assert np.allclose(added, whole)
    assert whole["n"].sum() == len(points)


def test_a_quadratic_is_met_exactly(spark):
    x = np.linspace(-3, 9, 200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 - x + 0.5 * x * x}))
    got = smooth_trend(bin_moments(df, {"x": (-3, 9)}, ["y"], bins=37), points=20, span=0.5).toPandas()
    assert np.allclose(got["fit"], 2 - got["x_at"] + 0.5 * got["x_at"] ** 2) and got["spread"].max() < 1e-5


def test_few_points_nulls_and_values_outside_the_range(spark):
    rows = [(1.0, 5.0, "a"), (None, 1.0, "a"), (2.0, None, "a"), (float("nan"), 1.0, "a"), (1.0, 7.0, "b"), (3.0, 9.0, "b"),
            (None, None, "c"), *[(v, 2 * v, "d") for v in (-50.0, 0.5, 1.5, 2.5, 80.0)]]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    got = smooth_trend(bin_moments(df, {"x": (0, 4)}, ["y"], bins=4, by=["g"]), points=3, by=["g"]).toPandas()
    a, b, d = (got[got["g"] == g] for g in "abd")
    assert a[["x_at", "fit", "n"]].values.tolist() == [[1.0, 5.0, 1]]
    assert np.allclose(b["x_at"], [1, 2, 3]) and b["fit"].between(7, 9).all()
    assert np.allclose(d["fit"], 2 * d["x_at"]) and "c" not in set(got["g"])
    assert smooth_trend(bin_moments(df.limit(0), {"x": (0, 4)}, ["y"])).count() == 0


def test_one_bin_gives_its_mean():
    one = pd.DataFrame([{"bin": 2, "low": 0.0, "high": 4.0, "bins": 4, "n": 3, "x1": 0.3, "x2": 0.1, "x3": 0.0, "x4": 0.0,
                         "y0": 6.0, "y1": 0.5, "y2": 0.1, "yy": 14.0}])
    got = local_fits(one, points=5, span=0.75)
    assert got["fit"].tolist() == [2.0] and got["n"].tolist() == [3]
