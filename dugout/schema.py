"""Value sets, label orders and schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Play results by role.
SINGLE, DOUBLE, TRIPLE, HOME_RUN = "Single", "Double", "Triple", "HomeRun"
HITS = (SINGLE, DOUBLE, TRIPLE, HOME_RUN)
WALK = "Walk"
STRIKEOUTS = ("StrikeoutSwinging", "StrikeoutLooking")
OUT = "Out"
ERROR = "Error"
SACRIFICE = "Sacrifice"
FIELDERS_CHOICE = "FieldersChoice"

#: results that never count as a ball put in play
NOT_IN_PLAY = (WALK, *STRIKEOUTS)
#: results that do not count as an at-bat
NOT_AT_BAT = (WALK, SACRIFICE)
#: results that are only usable when the ball was tracked
NEEDS_TRACKING = (*HITS, ERROR, SACRIFICE, FIELDERS_CHOICE)
#: results that carry a linear weight
WEIGHTED = (WALK, *HITS)

# Batted-ball classes; the first one is the model baseline.
NOT_A_HIT = "Not a Hit"
OUTCOMES = (NOT_A_HIT, *HITS)

# Competition levels.
TARGET_LEVELS = ("A+", "AA", "AAA", "MLB", "Other")
AFFILIATED = ("A", "A+", "AA")
INDEPENDENT = ("Amer", "Atl", "PL", "FL", "Mex", "Foreign")
DID_NOT_PLAY = "DNP"

# Thresholds.
MIN_PLATE_APPEARANCES = 130
HARD_HIT_SPEED = 95.0
OUTS_PER_HALF_INNING = 3

PITCH_COLUMNS = (
    "date", "time", "pa_of_inning", "pitcher", "pitcher_team", "pitcher_throws",
    "batter", "batter_side", "batter_team", "play_result", "outs_on_play",
    "exit_speed", "angle", "direction",
)
PLAY_COLUMNS = (
    "date", "time", "play_result", "outs", "outs_on_play", "runs_scored",
    "inning", "top_bottom", "game_id",
)

#: declared schema of a season table, used when there is nothing to infer it from
SEASON_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("time", T.StringType()),
    T.StructField("pa_of_inning", T.IntegerType()),
    T.StructField("pitcher", T.StringType()),
    T.StructField("pitcher_team", T.StringType()),
    T.StructField("pitcher_throws", T.StringType()),
    T.StructField("batter", T.StringType()),
    T.StructField("batter_side", T.StringType()),
    T.StructField("batter_team", T.StringType()),
    T.StructField("play_result", T.StringType()),
    T.StructField("outs", T.IntegerType()),
    T.StructField("outs_on_play", T.IntegerType()),
    T.StructField("runs_scored", T.IntegerType()),
    T.StructField("inning", T.IntegerType()),
    T.StructField("top_bottom", T.StringType()),
    T.StructField("game_id", T.StringType()),
    T.StructField("exit_speed", T.DoubleType()),
    T.StructField("angle", T.DoubleType()),
    T.StructField("direction", T.DoubleType()),
])
