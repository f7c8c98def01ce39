"""Exact order statistics by radix selection: only histograms of leading bits are shuffled.

A double's bits, read as an ordered whole number, put values in order. Values are counted per group and leading
bits; only where a wanted rank falls on bits that several different values share are the next bits counted. Values are
never sorted or written out, a group that holds most of the rows is a histogram like any other, and all measures go
through the same passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.functions.columns import key_of, ratio, unpack_key
from dugout.sources.shared import materialize

#: bits that are left out on the first pass, the second and so on; the first leaves sixteen steps between powers of two
SHIFTS = (48, 30, 12, 0)
_BEFORE = (W.unboundedPreceding, -1)
_SLOT = ["key", "measure"]


def _size(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.abs(x))


def _guess(size: Column) -> Column:
    """Binary exponent of ``size``; may be off by one next to a power of two. -1022 for zero and what is too small."""
    exponent = F.coalesce(F.log2(size), F.lit(-1022.0))
    return F.greatest(F.lit(-1022), F.least(F.lit(1023.0), F.floor(exponent).cast("double")).cast("int"))


def _scaled(size: Column, guess: Column) -> Column:
    """``size`` over the power of two of its guess, which is exact: from 1 up to 2 where the guess is right."""
    return size / F.pow(F.lit(2.0), guess)


def _bits(x: Column, guess: Column, scaled: Column) -> Column:
    """The whole number of :func:`order_bits`; never null, so that joins on it need no filter that repeats it."""
    place = lambda e, m: (e + 1022).cast("long") * F.lit(1 << 52) + (m * F.lit(2.0**52)).cast("long")
    size = F.when(scaled == float("inf"), F.lit(2047 << 52)).when(scaled >= 2, place(guess + 1, scaled / 2)).when(
        (scaled < 1) & (guess > -1022), place(guess - 1, scaled * 2)).otherwise(place(guess, scaled))
    return F.coalesce(F.when(x < 0, F.negative(size)).otherwise(size), F.lit(0).cast("long"))


def order_bits(x: Column) -> Column:
    """Whole number in the order of the doubles: sign, exponent and 52 bits of fraction. 0.0 and -0.0 are equal.

    Made by arithmetic on powers of two, which is exact, so that it stays inside generated code.
    """
    size = _size(x)
    return _bits(x, _guess(size), _scaled(size, _guess(size)))


def _points(df: DataFrame, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(key, measure, v, bits): one row per measure that is there; null and NaN are missing.

    The bits are made in steps, each a column that the next ones use several times: as one expression they repeat their
    parts so often that the generated method is too long to be compiled.
    """
    measures = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in values])
    if len(values) == 1:
        rows = df.select(key_of(*by).alias("key"), F.lit(values[0]).alias("measure"), F.col(values[0]).cast("double").alias("v"))
    else:
        rows = df.select(key_of(*by).alias("key"), F.inline(measures))
    there = rows.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("size", _size(F.col("v")))
    placed = there.withColumn("guess", _guess(F.col("size"))).withColumn("scaled", _scaled(F.col("size"), F.col("guess")))
    return placed.select("key", "measure", "v", _bits(F.col("v"), F.col("guess"), F.col("scaled")).alias("bits"))


def _count(points: DataFrame, slots: Sequence[str], shift: int) -> DataFrame:
    return points.groupBy(*slots, F.shiftright("bits", shift).alias("slot")).agg(
        F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))


def histogram(points: DataFrame) -> DataFrame:
    """(key, measure, slot, n, total, low, high): the first pass, written because every later step reads it."""
    return materialize(_count(points, _SLOT, SHIFTS[0]), "histogram")


def _holding(counts: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Slots that hold a wanted rank, with the rank counted from the slot's first value."""
    along = W.partitionBy(*slots).orderBy("slot").rowsBetween(*_BEFORE)
    ranked = counts.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    inside = lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("n"))
    return ranked.withColumn("wanted", F.filter("wanted", inside)).where(F.size("wanted") > 0).select(
        *_SLOT, F.col("slot").alias("prefix"), "low", "high",
        F.transform("wanted", lambda w: w.withField("rank", w["rank"] - F.col("before"))).alias("wanted"))


def _quantiles(points: DataFrame, hist: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(key, measure, q0, q1, ..., at0, at1, ...): interpolated quantiles, and the smallest value not below each."""
    position = [(F.col("size") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), edge(pos).cast("long").alias("rank"),
                 (pos - F.floor(pos)).alias("frac"))
        for i, pos in enumerate(position) for side, edge in ((0, F.floor), (1, F.ceil))])
    sized = hist.withColumn("size", F.sum("n").over(W.partitionBy(*_SLOT))).withColumn("wanted", wanted)
    found, slots = [materialize(_holding(sized, _SLOT), "ranks")], [*_SLOT, "prefix"]
    for last, shift in zip(SHIFTS, SHIFTS[1:]):
        shared = found[-1].where("low < high")
        if shared.isEmpty():
            break
        rows = points.withColumn("prefix", F.shiftright("bits", last)).join(shared.select(*slots), slots)
        counts = _count(rows, slots, shift).join(shared.select(*slots, "wanted"), slots)
        found.append(materialize(_holding(counts, slots), "ranks"))
    hits = found[0].where("low = high")
    for more in found[1:]:
        hits = hits.unionByName(more.where("low = high"))
    hits = hits.select(*_SLOT, F.col("low").alias("value"), F.explode("wanted").alias("w"))
    pick = lambda i, side, c: F.max(F.when((F.col("w.i") == i) & (F.col("w.side") == side), c))
    sides = hits.groupBy(*_SLOT).agg(*[
        agg for i in range(len(probs)) for agg in (
            pick(i, 0, F.col("value")).alias(f"lo{i}"), pick(i, 1, F.col("value")).alias(f"hi{i}"),
            pick(i, 0, F.col("w.frac")).alias(f"f{i}"))])
    between = lambda i: F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise(
        F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}"))
    return sides.select(*_SLOT, *[between(i).alias(f"q{i}") for i in range(len(probs))], *[
        F.when(between(i) <= F.col(f"lo{i}"), F.col(f"lo{i}")).otherwise(F.col(f"hi{i}")).alias(f"at{i}")
        for i in range(len(probs))])


def quantiles(df: DataFrame, values: Sequence[str], *, by: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(by, measure, names): exact interpolated quantiles of several measures per group, in the same passes."""
    points = _points(df, values, by)
    found = _quantiles(points, histogram(points), probs)
    return unpack_key(found, "key", by, "measure", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])


def exact_quantiles(df: DataFrame, value: str, *, by: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(by, names): exact interpolated quantiles per group."""
    return quantiles(df, [value], by=by, probs=probs, names=names).drop("measure")


def _inside(points: DataFrame, hist: DataFrame, bounds: DataFrame) -> DataFrame:
    """(key, measure, n, n_in, total, least, most): the values from ``low_bound`` to ``high_bound`` of their group.

    Slots that lie on one side of a bound count as they are; only values of slots that a bound cuts are read again.
    """
    placed = hist.join(bounds, _SLOT)
    within = (F.col("low") >= F.col("low_bound")) & (F.col("high") <= F.col("high_bound"))
    beyond = (F.col("high") < F.col("low_bound")) | (F.col("low") > F.col("high_bound"))
    zero = F.lit(0).cast("long")
    parts = placed.where(within | beyond).select(
        *_SLOT, "n", F.when(within, F.col("n")).otherwise(zero).alias("n_in"), F.when(within, F.col("total")).alias("total"),
        F.when(within, F.col("low")).alias("least"), F.when(within, F.col("high")).alias("most"))
    cut = materialize(placed.where(~(within | beyond)).select(*_SLOT, "slot", "low_bound", "high_bound"), "cut_slots")
    if not cut.isEmpty():
        rows = points.withColumn("slot", F.shiftright("bits", SHIFTS[0])).join(cut, [*_SLOT, "slot"])
        value = F.when((F.col("v") >= F.col("low_bound")) & (F.col("v") <= F.col("high_bound")), F.col("v"))
        parts = parts.unionByName(rows.groupBy(*_SLOT).agg(
            F.count("*").alias("n"), F.count(value).alias("n_in"), F.sum(value).alias("total"), F.min(value).alias("least"),
            F.max(value).alias("most")))
    return parts.groupBy(*_SLOT).agg(
        F.sum("n").alias("n"), F.sum("n_in").alias("n_in"), F.sum("total").alias("total"), F.min("least").alias("least"),
        F.max("most").alias("most"))


def top_fraction_mean(df: DataFrame, value: str, *, by: Sequence[str], top: float, name: str) -> DataFrame:
    """Mean of the values at or above the ``1 - top`` quantile of their group."""
    points = _points(df, [value], by)
    hist = histogram(points)
    cut = _quantiles(points, hist, [1.0 - top]).select(*_SLOT, F.col("at0").alias("low_bound"), F.lit(float("inf")).alias("high_bound"))
    found = _inside(points, hist, materialize(cut, "cut"))
    return unpack_key(found, "key", by, ratio(F.col("total"), F.col("n_in")).alias(name))


def box_summary(df: DataFrame, value: str, *, by: Sequence[str]) -> DataFrame:
    """Median, hinges, whiskers (extremes within 1.5 IQR of the hinges) and outlier count."""
    points = _points(df, [value], by)
    hist = histogram(points)
    reach = F.lit(1.5) * (F.col("q2") - F.col("q0"))
    hinges = materialize(_quantiles(points, hist, [0.25, 0.5, 0.75]).select(
        *_SLOT, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
        (F.col("q0") - reach).alias("low_bound"), (F.col("q2") + reach).alias("high_bound")), "hinges")
    found = _inside(points, hist, hinges.select(*_SLOT, "low_bound", "high_bound")).join(hinges, _SLOT)
    return unpack_key(
        found, "key", by, "n", F.col("least").alias("whisker_low"), "q1", "median", "q3", F.col("most").alias("whisker_high"),
        (F.col("n") - F.col("n_in")).alias("outliers"))
