"""From scored pitches to player lines, weights, league averages and plus statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout import schema as S
from dugout.functions.scoring import LinearModel, add_class_probabilities
from dugout.operators import batting, indexing, quality, runvalue
from dugout.operators.clean import attach, batted_balls, deduplicate, is_batted_ball, with_dense_id
from dugout.operators.levels import seasons_of
from dugout.operators.model import fit_multinomial_per
from dugout.session import side_by_side
from dugout.sources.csv_tree import read_csv_tree
from dugout.sources.shared import materialize
from dugout.sources.tables import union_sources, write_csv, write_season_table

CONTACT = ("exit_speed", "angle")


def fit_outcome_models(
    pitches: DataFrame, seasons: Sequence[int], features: Sequence[str] = CONTACT, **options
) -> dict[object, LinearModel]:
    """One softmax model of the batted-ball outcome per season."""
    return fit_multinomial_per(
        batted_balls(pitches), "season", list(seasons), features, "outcome", S.OUTCOMES, **options
    )


def score_pitches(pitches: DataFrame, models: LinearModel | Mapping[object, LinearModel]) -> DataFrame:
    """Expected values on the batted balls, null on every other pitch; no join back."""
    key = None if isinstance(models, LinearModel) else "season"
    scored = add_class_probabilities(
        pitches, models, batting.HIT_PROBABILITIES, model_key=key, where=is_batted_ball()
    )
    return batting.expected_per_ball(scored)


@dataclass(frozen=True)
class SeasonStatistics:
    """Season results from two tables: batter totals and out-state cells.

    Everything is derived on first use. The league tables have one row per season; they are
    written out before a join, so the planner knows how small they are and broadcasts them
    instead of shuffling the players by season.
    """

    totals: DataFrame
    cells: DataFrame
    minimum: int = S.MIN_PLATE_APPEARANCES
    reference_season: int | None = None
    baseline_season: int | None = None

    @cached_property
    def values(self) -> DataFrame:
        return runvalue.run_values(self.cells)

    @cached_property
    def weights(self) -> DataFrame:
        return runvalue.linear_weights(self.values, reference_season=self.reference_season)

    @cached_property
    def weights_row(self) -> DataFrame:
        return materialize(runvalue.weights_row(self.weights), "weights")

    @cached_property
    def players(self) -> DataFrame:
        line = batting.batting_line(self.totals, minimum=self.minimum)
        return batting.add_weighted_on_base(line, self.weights_row)

    @cached_property
    def league_m1(self) -> DataFrame:
        return materialize(indexing.league_average(self.players), "league")

    @cached_property
    def league_m2(self) -> DataFrame:
        return materialize(
            batting.add_weighted_on_base(batting.league_line(self.totals), self.weights_row), "league"
        )

    @cached_property
    def plus_m1(self) -> DataFrame:
        return indexing.plus_stats(self.players, self.league_m1, baseline_season=self.baseline_season)

    @cached_property
    def plus_m2(self) -> DataFrame:
        return indexing.plus_stats(self.players, self.league_m2, baseline_season=self.baseline_season)

    @cached_property
    def checks(self) -> DataFrame:
        return runvalue.sanity_checks(self.values)


def season_statistics(
    scored: DataFrame, *, half_inning: Sequence[str], order: Sequence[str], chunk: Column, **options
) -> SeasonStatistics:
    """Reduce the pitches in two passes, side by side; everything after them is small.

    ``options``: ``minimum``, ``reference_season`` (whose run values to use) and
    ``baseline_season`` (whose league to index against).
    """
    totals, cells = side_by_side(scored.sparkSession, materialize, [
        batting.batter_totals(scored),
        runvalue.state_cells(scored, half_inning=half_inning, order=order, chunk=chunk),
    ])
    return SeasonStatistics(totals, cells, **options)


def with_contact_quality(plus: DataFrame, pitches: DataFrame, minimum: int = S.MIN_PLATE_APPEARANCES) -> DataFrame:
    line = quality.hit_quality(pitches, minimum=minimum)
    return attach(
        plus, line.select("season", "batter", "hard_hit_percentage", "avg_exit_speed", "avg_angle"),
        ["season", "batter"],
    )


#: result tables of a run, each written as CSV files below the output folder
RESULT_TABLES = ("players", "league_m2", "plus_m2", "weights")


def ingest_seasons(
    spark: SparkSession, roots: Mapping[int, str], table: str, schema: T.StructType | None = None, **options
) -> DataFrame:
    """Read the CSV tree of each season into the season table, exact repeats dropped.

    Every game file is delivered once per team, so the files hold most rows twice. Seasons already in
    the table are replaced, others stay. Returns what could not be used: (season, reason, file_path, record).
    """
    rejected = []
    for season, root in roots.items():
        tree = read_csv_tree(spark, root, schema, **options)
        rows = deduplicate(tree.rows).withColumn("season", F.lit(season))
        write_season_table(rows, table)
        rejected.append(tree.quarantine.select(F.lit(season).alias("season"), "*"))
    return union_sources(rejected)


def run_seasons(
    pitches: DataFrame,
    out: str,
    *,
    half_inning: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    models: LinearModel | Mapping[object, LinearModel] | None = None,
    id_columns: Sequence[str] = (),
    **options,
) -> SeasonStatistics:
    """From pitches as delivered to result files: deduplicate, number, fit, score, summarise, write.

    ``id_columns`` identify a pitch and give it a dense ``pitch_id``; leave them out when the pitches have
    an id. ``models`` skips the fit. The pitches are written once, since fits and statistics read them.
    """
    unique = deduplicate(pitches)
    if id_columns:
        unique = with_dense_id(unique, id_columns)
    unique = materialize(unique, "pitches")
    if models is None:
        models = fit_outcome_models(unique, seasons_of(unique))
    stats = season_statistics(
        score_pitches(unique, models), half_inning=half_inning, order=order, chunk=chunk, **options)
    side_by_side(pitches.sparkSession, lambda name: write_csv(getattr(stats, name), f"{out}/{name}"), RESULT_TABLES)
    return stats
