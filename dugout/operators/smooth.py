"""Smooth trends: local quadratic regression from mergeable moments of fine bins.

A trend line needs every point near each position of the curve. Instead of the points, one pass keeps
per fine bin the sums that a quadratic fit asks for: powers of x up to four, their products with y and
the square of y. The local fits then read a few hundred bins, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions.columns import key_of

_MOMENTS = ("n", "x1", "x2", "x3", "x4", "y0", "y1", "y2", "yy")


def bin_moments(
    df: DataFrame, xs: Mapping[str, tuple[float, float]], ys: Sequence[str], *, bins: int = 500, by: Sequence[str] = ()
) -> DataFrame:
    """(by, x, y, bin, low, high, n, x1..x4, y0..y2, yy): sums over the points of each bin, all pairs in one pass.

    Powers are of u, the distance to the bin's centre in bin widths: ``xk`` is the sum of u^k, ``yk`` of
    y u^k, ``yy`` of y^2. Sums of two tables add up to those of their union. Values outside the range
    given for a column lie in bins 0 and ``bins + 1``. Points that lack x or y are left out.
    """
    pairs = []
    for x, (low, high) in xs.items():
        width = (high - low) / bins
        value = F.col(x).cast("double")
        number = F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins))
        u = (value - F.lit(float(low))) / F.lit(width) - (number - F.lit(0.5))
        pairs += [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), number.alias("bin"), u.alias("u"),
                           F.col(y).cast("double").alias("v")) for y in ys]
    points = df.select(key_of(*by).alias("key"), F.inline(F.array(*pairs))).where("u IS NOT NULL AND v IS NOT NULL")
    u, v = F.col("u"), F.col("v")
    summed = points.where(~F.isnan("u") & ~F.isnan("v")).groupBy("key", "x", "y", "bin").agg(
        F.count("*").alias("n"), F.sum(u).alias("x1"), F.sum(u * u).alias("x2"), F.sum(u * u * u).alias("x3"),
        F.sum(u * u * u * u).alias("x4"), F.sum(v).alias("y0"), F.sum(v * u).alias("y1"), F.sum(v * u * u).alias("y2"),
        F.sum(v * v).alias("yy"))
    edge = lambda k: F.create_map(*[F.lit(z) for x in xs for z in (x, float(xs[x][k]))])[F.col("x")]
    return summed.select(*[F.col("key")[c].alias(c) for c in by], "x", "y", "bin", edge(0).alias("low"),
                         edge(1).alias("high"), F.lit(bins).alias("bins"), *_MOMENTS)


def local_fits(moments: pd.DataFrame, *, points: int, span: float) -> pd.DataFrame:
    """The curve of one pair from its bins: x_at, bandwidth, n, fit, spread at ``points`` even positions.

    At each position the ``span`` share of the points that lies nearest sets the bandwidth. Bins weigh
    (1 - d^3)^3, d the distance of their mean in bandwidths. The fit is a weighted quadratic; with two
    bins in reach a line, with one its mean. ``spread`` is the weighted root mean square residual.
    """
    moments = moments.sort_values("bin")
    n, x1, x2, x3, x4, y0, y1, y2, yy = (moments[c].to_numpy(float) for c in _MOMENTS)
    width = float(moments["high"].iloc[0] - moments["low"].iloc[0]) / int(moments["bins"].iloc[0])
    centre = float(moments["low"].iloc[0]) + (moments["bin"].to_numpy(float) - 0.5) * width
    mean = centre + width * x1 / n
    at = np.linspace(mean[0], mean[-1], points) if len(n) > 1 else mean[:1]
    wanted = max(1.0, np.floor(n.sum() * min(span, 1.0) + 1e-5))
    out = []
    for x0 in at:
        distance = np.abs(mean - x0)
        order = np.argsort(distance, kind="stable")
        h = distance[order][np.searchsorted(np.cumsum(n[order]), wanted)]
        if h <= 0:
            h = width / 2  # the nearest bin alone has enough points
        d = distance / h
        w = np.where(d < 1, (1 - d**3) ** 3, 0.0)
        reach = int((w > 0).sum())
        if not reach:  # everything lies exactly a bandwidth away
            w = (distance <= h).astype(float)
            reach = int(w.sum())
        # Moments around x0 in bandwidths: (a + s u)^k, expanded.
        a, s = (centre - x0) / h, width / h
        m = np.array([
            (w * n).sum(), (w * (a * n + s * x1)).sum(), (w * (a**2 * n + 2 * a * s * x1 + s**2 * x2)).sum(),
            (w * (a**3 * n + 3 * a**2 * s * x1 + 3 * a * s**2 * x2 + s**3 * x3)).sum(),
            (w * (a**4 * n + 4 * a**3 * s * x1 + 6 * a**2 * s**2 * x2 + 4 * a * s**3 * x3 + s**4 * x4)).sum()])
        t = np.array([
            (w * y0).sum(), (w * (a * y0 + s * y1)).sum(), (w * (a**2 * y0 + 2 * a * s * y1 + s**2 * y2)).sum()])
        size = min(reach, 3)
        normal = np.array([[m[i + j] for j in range(size)] for i in range(size)])
        beta = np.linalg.solve(normal, t[:size])
        rest = (w * yy).sum() - beta @ t[:size]
        out.append((x0, h, int(n[w > 0].sum()), beta[0], np.sqrt(max(rest, 0.0) / m[0])))
    return pd.DataFrame(out, columns=["x_at", "bandwidth", "n", "fit", "spread"])


def smooth_trend(moments: DataFrame, *, points: int = 80, span: float = 0.75, by: Sequence[str] = ()) -> DataFrame:
    """(by, x, y, x_at, bandwidth, n, fit, spread): a curve for every pair of :func:`bin_moments`.

    A pair's bins are one group, at most ``bins + 2`` rows whatever the number of points.
    """
    keys = [*by, "x", "y"]
    kinds = {f.name: f.dataType.simpleString() for f in moments.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "x_at double", "bandwidth double", "n long", "fit double",
                        "spread double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        curve = local_fits(group, points=points, span=span)
        for i, c in enumerate(keys):
            curve.insert(i, c, [group[c].iloc[0]] * len(curve))
        return curve

    return moments.groupBy(*keys).applyInPandas(run, schema)
