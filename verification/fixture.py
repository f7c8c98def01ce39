"""Maps the given tables onto the shapes the operators expect.

The SQL text is the same for Spark and for the comparison engine. ``props`` is always
``{"k": n}``, so the number is cut out by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dugout import schema as S
from dugout.functions.columns import minute_chunk
from dugout.functions.scoring import LinearModel

SEASONS = (2023, 2024)
MINIMUM = 25  # plate appearances per season and batter, in place of 130
HALF_INNING = ("game_date", "game_no", "inning", "top_bottom")
ORDER = ("ts", "pitch_id")


def chunk():
    return minute_chunk("ts", 60)


PLAYS = """
SELECT event_id AS pitch_id, ts, CAST(ts AS DATE) AS game_date,
  CAST(FLOOR(user_id / 15) AS INT) AS game_no,
  CASE WHEN day(ts) <= 15 THEN 2023 ELSE 2024 END AS season,
  CAST(FLOOR(hour(ts) / 8) AS INT) + 1 AS inning,
  CASE WHEN user_id % 2 = 0 THEN 'Top' ELSE 'Bottom' END AS top_bottom,
  user_id AS batter,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(FLOOR(event_id / 3) AS INT) % 3 END AS outs,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END ELSE 0 END AS outs_on_play,
  CASE WHEN event_id % 4 = 0 THEN NULL
       WHEN event_type = 'error'  THEN CASE WHEN k % 6 = 0 THEN 'FieldersChoice' WHEN k % 6 = 1 THEN 'Error' ELSE 'Out' END
       WHEN event_type = 'signup' THEN 'Walk'
       WHEN event_type = 'view'   THEN CASE WHEN k % 2 = 0 THEN 'StrikeoutLooking' ELSE 'StrikeoutSwinging' END
       WHEN event_type = 'click'  THEN CASE WHEN k % 5 = 0 THEN 'Double' WHEN k % 5 = 1 THEN 'Sacrifice' ELSE 'Single' END
       ELSE CASE WHEN k % 4 = 0 THEN 'Triple' WHEN k % 4 = 1 THEN 'HomeRun' ELSE 'Out' END END AS play_result,
  CASE WHEN event_id % 11 = 0 THEN NULL
       WHEN event_type = 'purchase' AND k % 4 = 1 THEN 1 + k % 3
       WHEN event_type = 'purchase' AND k % 4 = 0 THEN k % 3
       WHEN event_type = 'click' THEN k % 2 ELSE 0 END AS runs_scored,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 50.0 + least(value, 65.0) END AS exit_speed,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(k AS DOUBLE) - 40 END AS angle,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST((user_id * 7 + k) % 90 AS DOUBLE) - 45 END AS direction
FROM (SELECT *, CAST(substr(props, 7, length(props) - 7) AS INT) AS k FROM events) e
"""

#: the same plays with the column set of a season table
PITCH_LOG = f"""
SELECT season, pitch_id, game_date AS date,
  lpad(CAST(hour(ts) AS STRING), 2, '0') || ':' || lpad(CAST(minute(ts) AS STRING), 2, '0') || ':'
    || lpad(CAST(second(ts) AS STRING), 2, '0') AS time,
  CAST(pitch_id % 6 AS INT) + 1 AS pa_of_inning,
  'P' || CAST((batter * 31 + game_no) % 40 AS STRING) AS pitcher,
  'T' || CAST(game_no % 8 AS STRING) AS pitcher_team,
  CASE WHEN batter % 3 = 0 THEN 'Left' ELSE 'Right' END AS pitcher_throws,
  'B' || CAST(batter AS STRING) AS batter,
  CASE WHEN batter % 4 = 0 THEN 'Left' ELSE 'Right' END AS batter_side,
  'T' || CAST((game_no + 1) % 8 AS STRING) AS batter_team,
  play_result, outs, outs_on_play, runs_scored, inning, top_bottom,
  'G' || CAST(game_no AS STRING) AS game_id, exit_speed, angle, direction
FROM ({PLAYS}) p
"""

# Pinned models: literal coefficients used by both engines.
OUTCOME_MODEL = LinearModel(
    ("exit_speed", "angle"), S.OUTCOMES,
    (0.0, -2.0, -4.0, -6.0, -9.0),
    ((0.0, 0.0), (0.015, -0.004), (0.03, 0.006), (0.035, 0.01), (0.07, 0.02)),
)
FLAG_LABELS = ("A", "N", "R")
FLAG_FEATURES = ("l_quantity", "l_discount", "l_tax")
FLAG_MODEL = LinearModel(
    FLAG_FEATURES, FLAG_LABELS, (0.0, 0.2, -0.1),
    ((0.0, 0.0, 0.0), (0.01, 1.5, -2.0), (-0.005, 2.0, 3.0)),
)
FLAG_NAMES = {"A": "p_a", "N": "p_n", "R": "p_r"}
BOARD_MODEL = LinearModel(
    ("ba", "ops", "k_percentage", "bb_percentage"), ("Affiliated", "DNP", "Independent"),
    (0.0, 2.0, 1.0), ((0.0, 0.0, 0.0, 0.0), (-3.0, -1.0, 2.0, -1.0), (-1.0, -0.5, 0.5, 0.25)),
)
HORIZON_MODELS = {
    year: LinearModel(
        ("obp", "slg", "k_percentage", "bb_percentage"), S.TARGET_LEVELS,
        (0.0, 0.3 + shift, 0.1, -0.4, 1.0),
        ((0.0, 0.0, 0.0, 0.0), (1.0, 0.5, -1.0, 0.2), (1.5, 0.8, -2.0, 0.4), (2.0, 1.0 + shift, -3.0, 0.6),
         (-1.0, -0.5, 1.0, -0.2)),
    )
    for year, shift in ((2025, 0.0), (2026, 0.25), (2027, 0.5))
}
BINARY_WEIGHTS = {
    "is_single": (-3.0, 0.02, 0.004), "is_double": (-4.0, 0.02, 0.006),
    "is_triple": (-5.0, 0.03, 0.01), "is_home_run": (-7.0, 0.05, 0.02),
}

PRIORITY_RANKS = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
PRIORITY_LEVELS = {"1-URGENT": "MLB", "2-HIGH": "AAA", "3-MEDIUM": "AA", "4-NOT SPECIFIED": "A+", "5-LOW": "Mex"}
#: horizons that are projected: the level after one, two and three seasons
HORIZONS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over_events(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events)", "FROM {events})"), events=table(spark, sf_dir, "events"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_events(spark, sf_dir, PLAYS)


def pitch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_events(spark, sf_dir, PITCH_LOG)
