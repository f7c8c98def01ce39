"""Ordered computations that stay distributed when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Everything here
works in two levels instead: rows are ordered inside a (key, chunk) pair, where the
chunk is a monotone slice of the ordering column or value, and a small per-chunk table
carries the totals from one chunk to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.functions.columns import key_of, ratio, sum_or_zero, unpack_key
from dugout.sources.shared import materialize

_BEFORE = (W.unboundedPreceding, -1)


def _reversed(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() for c in order]


def sum_of_later_rows(value: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Sum over the rows after the current one.

    Read backwards with an ``unbounded preceding`` frame: that frame is updated row by
    row, while an ``unbounded following`` frame is recomputed from scratch for each row.
    """
    w = W.partitionBy(*keys).orderBy(*_reversed(order)).rowsBetween(*_BEFORE)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def running_totals(
    df: DataFrame,
    value: str,
    *,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    running: str,
    remaining: str,
) -> DataFrame:
    """Running sum (inclusive) and remaining sum (exclusive) of ``value`` inside ``by``.

    ``order`` must be a total order and ``chunk`` a number that never decreases along it.
    """
    rows = df.withColumns({"__key": key_of(*by), "__chunk": chunk})
    per_chunk = rows.groupBy("__key", "__chunk").agg(sum_or_zero(F.col(value)).alias("__sum"))
    along = W.partitionBy("__key").orderBy(F.col("__chunk").asc()).rowsBetween(*_BEFORE)
    whole = W.partitionBy("__key")
    # Only keys that span several chunks need a carry; the others keep the default 0.
    carries = (
        per_chunk
        .withColumn("__before", F.coalesce(F.sum("__sum").over(along), F.lit(0)))
        .withColumn("__after", F.sum("__sum").over(whole) - F.col("__before") - F.col("__sum"))
        .where((F.col("__before") != 0) | (F.col("__after") != 0))
        .drop("__sum")
    )
    pair = ["__key", "__chunk"]
    local = (
        rows
        .withColumn("__rest", sum_of_later_rows(value, pair, order))
        .withColumn("__all", F.sum(value).over(W.partitionBy(*pair)))
    )
    carried = local.join(carries, pair, "left")
    return carried.withColumns({
        running: F.col("__all") - F.col("__rest") + F.coalesce("__before", F.lit(0)),
        remaining: F.col("__rest") + F.coalesce("__after", F.lit(0)),
    }).drop("__key", "__chunk", "__rest", "__all", "__before", "__after")


def changed_since_previous(
    df: DataFrame, value: str, *, by: Sequence[str], order: Sequence[str], chunk: Column, flag: str
) -> DataFrame:
    """True where ``value`` differs from the previous row of ``by``; the first row is false."""
    rows = df.withColumns({"__key": key_of(*by), "__chunk": chunk})
    pair = ["__key", "__chunk"]
    # The last value of each chunk is what the first row of the next chunk compares with.
    last = rows.groupBy(*pair).agg(
        F.max_by(F.struct(value), F.struct(*order)).alias("__last")
    )
    along = W.partitionBy("__key").orderBy("__chunk")
    carries = (
        last.withColumn("__carry", F.lag("__last").over(along))
        .where(F.col("__carry").isNotNull()).drop("__last")
    )
    local = rows.withColumn(
        "__prev", F.lag(F.struct(value)).over(W.partitionBy(*pair).orderBy(*order))
    )
    previous = F.coalesce("__prev", "__carry")
    return (
        local.join(carries, pair, "left")
        .withColumn(flag, F.when(previous.isNull(), F.lit(False)).otherwise(previous[value] != F.col(value)))
        .drop("__key", "__chunk", "__prev", "__carry")
    )


def hash_rank(
    df: DataFrame,
    *,
    ids: Sequence[str],
    seed: int,
    by: Sequence[str] = (),
    rank: str = "rank",
    size: str = "group_size",
    slice_digits: int = 4,
) -> DataFrame:
    """Reproducible shuffled 1..n rank inside ``by``, plus the group size.

    Rows are ordered by ``md5(ids ':' seed)``; ``ids`` must identify a row. The first
    ``slice_digits`` hex digits of the digest split every group into even slices,
    so neither a global sort nor one large group reaches a single task: with the default,
    a slice holds 1/65536 of its group.
    """
    rows = df.withColumns({"__key": key_of(*by), "__digest": shuffle_digest(ids, seed)})
    rows = rows.withColumn("__slice", F.substring("__digest", 1, slice_digits))
    pair = ["__key", "__slice"]
    along = W.partitionBy("__key").orderBy("__slice").rowsBetween(*_BEFORE)
    offsets = (
        rows.groupBy(*pair).agg(F.count("*").alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(along), F.lit(0)))
        .withColumn(size, F.sum("__n").over(W.partitionBy("__key")))
        .drop("__n")
    )
    inside = W.partitionBy(*pair).orderBy("__digest", *ids)
    return (
        rows.withColumn("__pos", F.row_number().over(inside).cast("long"))
        .join(offsets, pair)
        .withColumn(rank, F.col("__pos") + F.col("__offset"))
        .drop("__key", "__slice", "__digest", "__pos", "__offset")
    )


def shuffle_digest(ids: Sequence[str], seed: int) -> Column:
    """The digest that puts rows in a reproducible shuffled order."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ids])
    return F.md5(F.concat(text, F.lit(f":{seed}")))


#: rows of one group that may be sorted to find the digest at a rank
SORTED_ROWS = 10_000


def digest_cut(
    df: DataFrame, digest: Column, wanted: Column, *, by: Sequence[str] = (), digits: int = 3, sorted_rows: int = SORTED_ROWS
) -> DataFrame:
    """(key, cut): per group the digest at rank ``wanted``, so that ``digest <= cut`` takes that many rows.

    Histograms of leading digits are refined where they hold the rank, until few rows are left to sort; only
    histograms and those few rows are shuffled. ``wanted`` is an expression of the group size ``n``. A cut of
    rank 0 is empty, one of rank ``n`` is above every digest. Equal digests stay on one side, the lower one.
    """
    rows = df.select(key_of(*by).alias("key"), digest.alias("digest"))
    size, start, cuts = None, 0, []
    while True:
        part = F.substring("digest", start + 1, digits)
        open_rows = rows if size is None else rows.join(size.select("key", "prefix"), "key").where(
            F.col("digest").startswith(F.col("prefix")))
        counts = open_rows.groupBy("key", part.alias("part")).agg(F.count("*").alias("held"))
        along = W.partitionBy("key").orderBy("part").rowsBetween(*_BEFORE)
        if size is None:
            counts = counts.withColumn("n", F.sum("held").over(W.partitionBy("key"))).withColumn("rank", wanted.cast("long"))
            counts = counts.withColumn("prefix", F.lit("")).withColumn("before", F.lit(0).cast("long"))
        else:
            counts = counts.join(size.drop("held"), "key")
        slices = counts.withColumn("before", F.col("before") + F.coalesce(F.sum("held").over(along), F.lit(0)))
        seen = Observation()
        slices = slices.select("key", F.concat("prefix", "part").alias("prefix"), "rank", "before", "held").where(
            ((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("held")))
            | ((F.col("rank") <= 0) & (F.col("before") == 0)))
        # A slice that is needed whole is cut above all of its digests; rank 0 is cut below all digests.
        whole = F.col("rank") == F.col("before") + F.col("held")
        left = F.max(F.when(~whole & (F.col("rank") > 0), F.col("held"))).alias("most")
        slices = materialize(slices.observe(seen, left), "slices")
        cuts.append(slices.where(whole | (F.col("rank") <= 0)).select(
            "key", F.when(F.col("rank") <= 0, F.lit("")).otherwise(F.concat("prefix", F.lit("~"))).alias("cut")))
        size, start = slices.where(~whole & (F.col("rank") > 0)), start + digits
        most = seen.get["most"]
        if most is None or most <= sorted_rows or start >= 32:
            break
    last = rows.join(size, "key").where(F.col("digest").startswith(F.col("prefix"))).groupBy("key").agg(
        F.element_at(F.sort_array(F.collect_list("digest")), F.any_value(F.col("rank") - F.col("before")).cast("int")).alias("cut")
    ) if most is not None and start < 32 else size.select("key", F.col("prefix").alias("cut"))
    for found in cuts:
        last = last.unionByName(found)
    return materialize(last, "cuts")


# --- exact order statistics ---------------------------------------------------------


def value_counts(df: DataFrame, value: str, *, by: Sequence[str], bin_width: float) -> DataFrame:
    """(key, bin, value, n): repeated values collapse before anything is shuffled or sorted.

    Every later step reads this table, so it is written once to the shared folder.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .select(
            key_of(*by).alias("key"),
            F.floor(F.col(value) / F.lit(float(bin_width))).alias("bin"),
            F.col(value).cast("double").alias("value"),
        )
        .groupBy("key", "bin", "value").agg(F.count("*").alias("n"))
    )
    return materialize(counts, "values")


def _ranked_bins(counts: DataFrame) -> DataFrame:
    along = W.partitionBy("key").orderBy("bin").rowsBetween(*_BEFORE)
    return (
        counts.groupBy("key", "bin").agg(F.sum("n").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .withColumn("total", F.sum("n").over(W.partitionBy("key")))
    )


#: sub-bins into which a bin that holds a wanted rank is cut before any of its values are sorted
SUB_BINS = 1000


def _holding_rank(bins: DataFrame, wanted: Column) -> DataFrame:
    """Bins that contain a wanted rank; ``before`` and ``n`` say which ranks a bin holds."""
    inside = lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("n"))
    return bins.withColumn("wanted", F.filter(wanted, inside)).where(F.size("wanted") > 0)


def _quantiles(counts: DataFrame, bins: DataFrame, probs: Sequence[float], bin_width: float) -> DataFrame:
    """(key, q0, q1, ...) with linear interpolation between order statistics.

    Bins that hold a wanted rank are counted again in finer bins, and only the fine bins that hold
    one are sorted value by value. A group of many distinct values thus never meets in one task.
    """
    position = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"),
                 edge(pos).cast("long").alias("rank"), (pos - F.floor(pos)).alias("frac"))
        for i, pos in enumerate(position)
        for side, edge in ((0, F.floor), (1, F.ceil))
    ])
    coarse = _holding_rank(bins, wanted).select("key", "bin", F.col("before").alias("bin_before"), "wanted")
    part = (F.col("value") / F.lit(float(bin_width)) - F.col("bin")) * F.lit(float(SUB_BINS))
    rows = counts.join(coarse, ["key", "bin"]).withColumn(
        "sub", F.greatest(F.lit(0), F.least(F.lit(SUB_BINS - 1), F.floor(part).cast("int"))))
    along_bins = W.partitionBy("key", "bin").orderBy("sub").rowsBetween(*_BEFORE)  # at most SUB_BINS rows
    fine = rows.groupBy("key", "bin", "sub").agg(
        F.sum("n").alias("n"), F.any_value("bin_before").alias("bin_before"), F.any_value("wanted").alias("wanted")
    ).withColumn("before", F.col("bin_before") + F.coalesce(F.sum("n").over(along_bins), F.lit(0)))
    targets = _holding_rank(fine, F.col("wanted")).select("key", "bin", "sub", "before", "wanted")
    along = W.partitionBy("key", "bin", "sub").orderBy("value").rowsBetween(*_BEFORE)
    hits = (
        rows.drop("bin_before", "wanted").join(targets, ["key", "bin", "sub"])
        .withColumn("lo", F.col("before") + F.coalesce(F.sum("n").over(along), F.lit(0)))
        .withColumn("hi", F.col("lo") + F.col("n"))
        .select("key", "value", "lo", "hi", F.explode("wanted").alias("w"))
        .where((F.col("w.rank") >= F.col("lo")) & (F.col("w.rank") < F.col("hi")))
    )
    pick = lambda i, side, c: F.max(F.when((F.col("w.i") == i) & (F.col("w.side") == side), c))
    found = hits.groupBy("key").agg(*[
        agg
        for i in range(len(probs))
        for agg in (
            pick(i, 0, F.col("value")).alias(f"lo{i}"),
            pick(i, 1, F.col("value")).alias(f"hi{i}"),
            pick(i, 0, F.col("w.frac")).alias(f"f{i}"),
        )
    ])
    return found.select("key", *[
        (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}")).alias(f"q{i}")
        for i in range(len(probs))
    ])


def exact_quantiles(
    df: DataFrame, value: str, *, by: Sequence[str], probs: Sequence[float], names: Sequence[str],
    bin_width: float,
) -> DataFrame:
    """Exact interpolated quantiles per group.

    ``bin_width`` only steers the work: each group is cut into bins of that width, and
    only the bins holding a wanted rank are sorted.
    """
    counts = value_counts(df, value, by=by, bin_width=bin_width)
    found = _quantiles(counts, _ranked_bins(counts), probs, bin_width)
    return unpack_key(found, "key", by, *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])


def _with_group_scalars(counts: DataFrame, bins: DataFrame, scalars: DataFrame) -> DataFrame:
    """Bring per-group scalars to the value rows through (key, bin), which spreads a hot group."""
    return counts.join(bins.select("key", "bin").join(scalars, "key"), ["key", "bin"])


def top_fraction_mean(
    df: DataFrame, value: str, *, by: Sequence[str], top: float, name: str, bin_width: float = 0.5
) -> DataFrame:
    """Mean of the values at or above the ``1 - top`` quantile of their group."""
    counts = value_counts(df, value, by=by, bin_width=bin_width)
    bins = _ranked_bins(counts)
    cut = _quantiles(counts, bins, [1.0 - top], bin_width)
    kept = _with_group_scalars(counts, bins, cut).where(F.col("value") >= F.col("q0"))
    means = kept.groupBy("key").agg(
        ratio(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias(name)
    )
    return unpack_key(means, "key", by, name)


def box_summary(df: DataFrame, value: str, *, by: Sequence[str], bin_width: float) -> DataFrame:
    """Median, hinges, whiskers (extremes within 1.5 IQR of the hinges) and outlier count."""
    counts = value_counts(df, value, by=by, bin_width=bin_width)
    bins = _ranked_bins(counts)
    hinges = _quantiles(counts, bins, [0.25, 0.5, 0.75], bin_width)
    reach = F.lit(1.5) * (F.col("q2") - F.col("q0"))
    fences = hinges.withColumns({"low": F.col("q0") - reach, "high": F.col("q2") + reach})
    rows = _with_group_scalars(counts, bins, fences)
    inside = (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
    out = rows.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max("q0").alias("q1"),
        F.max("q1").alias("median"),
        F.max("q2").alias("q3"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        sum_or_zero(F.when(~inside, F.col("n"))).alias("outliers"),
    )
    return unpack_key(out, "key", by, "n", "whisker_low", "q1", "median", "q3", "whisker_high", "outliers")
