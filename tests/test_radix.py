"""Radix selection against plain order statistics."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dugout.operators import radix


def _values(spark, seed=5):
    rng = random.Random(seed)
    rows = [("hot", round(rng.gauss(80, 15), 1)) for _ in range(3000)]
    rows += [("copies", 88.8)] * 500 + [("copies", 90.0)] * 2
    rows += [("one", 71.5)] + [("two", 60.0), ("two", 61.0)] + [(None, rng.random()) for _ in range(40)]
    rows += [("hot", None), ("empty", None)]
    return rows, spark.createDataFrame(rows, "grp string, value double")


def _groups(rows):
    out = {}
    for g, v in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return out


@pytest.mark.parametrize("shifts", [(40, 20, 0), (52, 36, 12, 0), (0,), (60, 56, 48, 40, 32, 24, 16, 8, 0)])
def test_exact_quantiles(spark, monkeypatch, shifts):
    monkeypatch.setattr(radix, "SHIFTS", shifts)
    rows, df = _values(spark)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    names = [f"p{i}" for i in range(5)]
    got = {
        r.grp: [r[n] for n in names]
        for r in radix.exact_quantiles(df, "value", by=["grp"], probs=probs, names=names).collect()
    }
    want = {g: list(np.quantile(v, probs)) for g, v in _groups(rows).items()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-9)


@pytest.mark.parametrize("top", [0.5, 0.2])
def test_top_fraction_mean(spark, top):
    rows, df = _values(spark)
    got = {r.grp: r.mean for r in radix.top_fraction_mean(df, "value", by=["grp"], top=top, name="mean").collect()}
    for g, v in _groups(rows).items():
        v = np.array(v)
        assert got[g] == pytest.approx(v[v >= np.quantile(v, 1 - top)].mean())


def test_box_summary(spark):
    rows, df = _values(spark)
    got = {r.grp: r for r in radix.box_summary(df, "value", by=["grp"]).collect()}
    for g, v in _groups(rows).items():
        v = np.array(v)
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        reach = 1.5 * (q3 - q1)
        inside = v[(v >= q1 - reach) & (v <= q3 + reach)]
        r = got[g]
        assert (r.n, r.outliers) == (len(v), len(v) - len(inside))
        assert [r.q1, r.median, r.q3, r.whisker_low, r.whisker_high] == pytest.approx(
            [q1, q2, q3, inside.min(), inside.max()]
        )


@pytest.mark.parametrize("shifts", [(40, 20, 0), (62, 40, 20, 0)])
def test_one_group_of_distinct_values(spark, monkeypatch, shifts):
    monkeypatch.setattr(radix, "SHIFTS", shifts)
    rng = random.Random(3)
    values = [rng.random() * 3 for _ in range(4000)] + [0.25] * 500 + [1e9, -1e9]
    values += [1 + k * 2**-52 for k in range(600)]  # neighbours in the last bits
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    probs = (0.0, 0.1, 0.5, 0.55, 0.99, 1.0)
    got = radix.exact_quantiles(df, "v", by=["g"], probs=probs, names=list("abcdef")).first()
    for name, p in zip("abcdef", probs):
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-15)


def test_bits_are_those_of_the_double(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf]
    values += [s * f * 2.0**e for e in range(-1074, 1023, 7) for s in (1, -1) for f in (1.0, 1.9999999999999998, 1 + rng.random())]
    values += [math.nextafter(2.0**e, 0) for e in range(-1020, 1023, 11)] + [rng.gauss(0, 1) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", radix.order_bits(F.col("v")).alias("bits"))
    for r in df.collect():
        bits = struct.unpack(">q", struct.pack(">d", abs(r["v"])))[0]
        assert r["bits"] == (-bits if r["v"] < 0 else bits), r["v"]


def test_generated_code_of_the_passes_is_short_enough_to_be_compiled(spark):
    """The JVM interprets a method of over 8,000 bytes, which makes every pass many times slower."""
    df = spark.range(100).selectExpr("id % 3 AS g", "id * 0.5 AS a", "id * 0.25 AS b")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        points = radix._points(df, ["a", "b"], ["g"])
        counted = radix._count(points, radix._SLOT, radix.SHIFTS[0])
        held = points.withColumn("prefix", F.shiftright("bits", radix.SHIFTS[0])).join(
            counted.select("key", "measure", F.col("slot").alias("prefix")), ["key", "measure", "prefix"])
        for passed in (counted, held):
            stages = passed._jdf.queryExecution().debug().codegenToSeq()
            longest = max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
            assert 0 < longest < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_measures_share_their_passes_and_only_histograms_move(spark):
    df = spark.range(20_000).selectExpr("id % 3 AS g", "id * 0.5 AS a", "IF(id % 7 = 0, NULL, -id) AS b", "double('NaN') AS c")
    got = radix.quantiles(df, ["a", "b", "c"], by=["g"], probs=[0.5], names=["median"])
    found = {(r["g"], r["measure"]): r["median"] for r in got.collect()}
    assert len(found) == 6 and found[0, "a"] == 0.5 * 9999
    assert found[1, "b"] == np.median([-i for i in range(20_000) if i % 3 == 1 and i % 7])
    points = radix._points(df, ["a", "b", "c"], ["g"])
    assert radix.histogram(points).count() < 1500  # a slot holds many values
    assert radix.quantiles(df.limit(0), ["a"], by=["g"], probs=[0.5], names=["m"]).count() == 0
    assert radix.box_summary(df, "c", by=["g"]).count() == 0
