"""Season statistics that are kept up to date, delivery by delivery.

State cells and batter totals are sums of integers, so they can be stored per game and added. A delivery brings whole
games. Its plays are reduced to partials per game; a game that is known already is taken back first, by its stored
partials with the sign turned. Both go to the ledger, and their sum moves the season tables. No play of an earlier
delivery is read again.

Published below a base (:mod:`dugout.sources.publish`), all with one switch:

* ``game_cells-<n>``, ``game_totals-<n>``: signed partials per game of delivery n, the ledger
* ``cells``, ``totals``: the sums per season, what :func:`state_cells` and :func:`batter_totals` give for all plays

A game is known by its season and the ``game`` columns, null being a value like others. Its half-innings lie inside it, so
the game columns must be among those of the half-inning. Expected sums are doubles, which signed corrections do
not restore exactly; they are not kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.functions.columns import null_safe_join
from dugout.operators.batting import BATTER, batter_totals
from dugout.operators.runvalue import LEAGUE, state_cells
from dugout.sources import publish as P
from dugout.sources.shared import materialize

CELLS, TOTALS = "cells", "totals"
_CELL = ("play_result", "outs", "post_outs")
_CELL_SUMS = ("plays", "runs", "runs_to_end")
_PLAYERS = tuple(c for c in BATTER if c not in LEAGUE)


def _signed(df: DataFrame, sums: Sequence[str]) -> DataFrame:
    return df.withColumns({c: -F.col(c) for c in sums})


def _add_up(df: DataFrame, keys: Sequence[str], sums: Sequence[str], rows: str) -> DataFrame:
    """Sums per key; keys of which nothing is left (``rows`` is 0) go."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(F.col(rows) != 0)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _ledger(spark: SparkSession, base: str, parts: dict, name: str) -> list[DataFrame]:
    return [P.read_published(spark, base, n) for n in sorted(parts) if n.startswith(f"game_{name}-")]


def _of_games(frames: list[DataFrame], games: DataFrame, bounds, keys: Sequence[str], sums, rows) -> list[DataFrame]:
    """What the ledger holds of these games, as at most one row per key."""
    if not frames:
        return []
    seasons, first, low, high, unknown = bounds
    # The filter reaches the scans: row groups of other seasons or dates are not read.
    near = F.col(first).between(F.lit(low), F.lit(high)) if low is not None else F.lit(False)
    near = near | F.col(first).isNull() if unknown else near
    season = F.col("season").isin([s for s in seasons if s is not None])
    season = season | F.col("season").isNull() if None in seasons else season
    known = null_safe_join(_union([f.where(season & near) for f in frames]), games, games.columns, "left_semi")
    return [_add_up(known, keys, sums, rows)]


def apply_delivery(
    plays: DataFrame, base: str, delivery: str, *,
    game: Sequence[str], half_inning: Sequence[str], order: Sequence[str], chunk: Column,
) -> bool:
    """Bring the statistics below ``base`` up to date with whole games; False if ``delivery`` is in them already.

    A game replaces what an earlier delivery said about it; one whose plays have no result any more leaves nothing. A run
    that stops leaves the earlier statistics, and of two runs at once the second fails.
    """
    if not game or not set(game) <= set(half_inning):
        raise ValueError("the columns of a game must be among those of a half-inning")
    spark = plays.sparkSession
    number, parts, notes = P.published(spark, base)
    done = notes.get("deliveries", [])
    if delivery in done:
        return False
    by = [*LEAGUE, *game]
    games = materialize(plays.select(*by).distinct(), "games")
    found = games.agg(F.collect_set("season"), F.min(game[0]), F.max(game[0]), F.max(F.col(game[0]).isNull()),
                      F.max(F.col("season").isNull())).first()
    bounds = [*found[0], *([None] if found[4] else [])], game[0], found[1], found[2], bool(found[3])

    cells = state_cells(plays, half_inning=[c for c in half_inning if c not in game], order=order, chunk=chunk, by=by)
    totals = batter_totals(plays, [*by, *_PLAYERS], expected=False)
    kinds = {
        CELLS: (cells, _CELL, _CELL_SUMS, "plays"),
        TOTALS: (totals, _PLAYERS, [c for c in totals.columns if c not in (*by, *_PLAYERS)], "all_total_pa"),
    }
    run, staged = uuid.uuid4().hex, {}
    for name, (partials, key, sums, rows) in kinds.items():
        old = _of_games(_ledger(spark, base, parts, name), games, bounds, [*by, *key], sums, rows)
        change = _union([partials, *[_signed(o, sums) for o in old]])
        ledger = f"game_{name}-{number + 1:08d}"
        # In order of the games, so that later deliveries can skip row groups.
        change = _add_change(change, [*by, *key], sums).sortWithinPartitions(*by)
        staged[ledger] = P.stage(change, base, ledger, run=run)
        moved = P._load(spark, base, staged[ledger])
        before = [P.read_published(spark, base, name)] if name in parts else []
        columns = [*LEAGUE, *key, *sums]
        after = _add_up(_union([f.select(*columns) for f in [*before, moved]]), [*LEAGUE, *key], sums, rows)
        staged[name] = P.stage(after, base, name, run=run)
    P.switch(spark, base, number, {**parts, **staged}, {**notes, "deliveries": [*done, delivery]})
    return True


def _add_change(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Net change per key; keys that stay as they are need no row."""
    changed = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in sums])
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(changed)


def standing(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``CELLS`` or ``TOTALS`` of all deliveries so far."""
    return P.read_published(spark, base, name)


def compact(spark: SparkSession, base: str) -> int:
    """Merge the ledgers of all deliveries into one; returns how many tables went. The statistics stay the same."""
    number, parts, notes = P.published(spark, base)
    run, merged, gone = uuid.uuid4().hex, {}, []
    for name in (CELLS, TOTALS):
        frames = _ledger(spark, base, parts, name)
        if len(frames) < 2:
            continue
        sums = _CELL_SUMS if name == CELLS else [
            c for c in P.read_published(spark, base, TOTALS).columns if c not in BATTER]
        keys = [c for c in frames[0].columns if c not in sums]
        gone += [n for n in parts if n.startswith(f"game_{name}-")]
        table = f"game_{name}-{number + 1:08d}"
        merged[table] = P.stage(_add_change(_union(frames), keys, sums), base, table, run=run)
    if merged:
        P.switch(spark, base, number, {**{n: p for n, p in parts.items() if n not in gone}, **merged}, notes)
    return len(gone) - len(merged)
