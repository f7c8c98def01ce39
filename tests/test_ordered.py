"""Two-level ordered operators against brute force, with chunks that split the groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dugout.operators import ordered

SCHEMA = "grp string, half int, pos long, value long"


def _rows(seed=1):
    rng = random.Random(seed)
    rows = []
    # one group holds most rows; one key is null
    for grp, half, n in [("hot", 1, 400), ("a", 1, 3), ("a", None, 5), (None, 2, 90), ("b", 2, 1)]:
        rows += [(grp, half, p, rng.randrange(-2, 5)) for p in rng.sample(range(2000), n)]
    return rows


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_running_totals(spark, width):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    out = ordered.running_totals(
        df, "value", by=["grp", "half"], order=["pos"], chunk=F.floor(F.col("pos") / width),
        running="running", remaining="remaining",
    )
    got = {(r.grp, r.half, r.pos): (r.running, r.remaining) for r in out.collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        group = sorted(r for r in rows if r[:2] == key)
        group = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])
        for i, r in enumerate(group):
            want[r[:3]] = (sum(x[3] for x in group[: i + 1]), sum(x[3] for x in group[i + 1:]))
    assert got == want


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_changed_since_previous(spark, width):
    rows = _rows(2)
    df = spark.createDataFrame(rows, SCHEMA)
    out = ordered.changed_since_previous(
        df, "value", by=["grp", "half"], order=["pos"], chunk=F.floor(F.col("pos") / width), flag="changed"
    )
    got = {(r.grp, r.half, r.pos): r.changed for r in out.collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        group = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])
        for before, r in zip([None, *group], group):
            want[r[:3]] = before is not None and before[3] != r[3]
    assert got == want


@pytest.mark.parametrize("slice_digits", [1, 3])
def test_hash_rank_is_dense_and_stable(spark, slice_digits):
    df = spark.range(1000).withColumn("grp", F.when(F.col("id") < 700, "hot").when(F.col("id") < 900, "b"))
    rank = lambda frame: {
        r.id: (r.grp, r.rank, r.group_size)
        for r in ordered.hash_rank(frame, ids=["id"], seed=3, by=["grp"], slice_digits=slice_digits).collect()
    }
    got = rank(df)
    assert got == rank(df.repartition(5, F.rand(1)))
    for grp, n in (("hot", 700), ("b", 200), (None, 100)):
        assert sorted(v[1] for v in got.values() if v[0] == grp) == list(range(1, n + 1))
        assert {v[2] for v in got.values() if v[0] == grp} == {n}


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


@pytest.mark.parametrize("width", [0.05, 1.0, 1000.0])
def test_exact_quantiles(spark, width):
    rows, df = _values(spark)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    names = [f"p{i}" for i in range(5)]
    got = {
        r.grp: [r[n] for n in names]
        for r in ordered.exact_quantiles(df, "value", by=["grp"], probs=probs, names=names, bin_width=width).collect()
    }
    want = {g: list(np.quantile(v, probs)) for g, v in _groups(rows).items()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-9)


@pytest.mark.parametrize("top", [0.5, 0.2])
def test_top_fraction_mean(spark, top):
    rows, df = _values(spark)
    got = {r.grp: r.mean for r in ordered.top_fraction_mean(df, "value", by=["grp"], top=top, name="mean").collect()}
    for g, v in _groups(rows).items():
        v = np.array(v)
        assert got[g] == pytest.approx(v[v >= np.quantile(v, 1 - top)].mean())


def test_box_summary(spark):
    rows, df = _values(spark)
    got = {r.grp: r for r in ordered.box_summary(df, "value", by=["grp"], bin_width=2.0).collect()}
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


def test_one_group_of_distinct_values_is_cut_finely(spark):
    rng = random.Random(3)
    values = [rng.random() * 3 for _ in range(4000)] + [0.25] * 500 + [1e9, -1e9]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = ordered.exact_quantiles(df, "v", by=["g"], probs=[0.0, 0.1, 0.5, 0.99, 1.0], names=list("abcde"), bin_width=100.0).first()
    ranked = sorted(values)
    for name, p in zip("abcde", (0.0, 0.1, 0.5, 0.99, 1.0)):
        at = (len(ranked) - 1) * p
        low, high = ranked[int(at)], ranked[min(len(ranked) - 1, int(at) + 1)]
        assert abs(got[name] - (low + (high - low) * (at - int(at)))) < 1e-9
    plan = ordered.exact_quantiles(df, "v", by=["g"], probs=[0.5], names=["m"], bin_width=100.0)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "sub#" in text.split("Window")[1]
