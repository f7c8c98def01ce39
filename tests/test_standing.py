"""Statistics kept up to date by deliveries equal those of a full run."""

import pytest
from pyspark.sql import functions as F

from dugout.functions.columns import minute_chunk
from dugout.operators import batting, runvalue
from dugout.plans import standing
from dugout.sources import publish
from tests.test_runvalue import SCHEMA, _plays

def _how():
    return {"half_inning": ["game", "inning"], "order": ["ts", "pitch_id"], "chunk": minute_chunk("ts", 60)}


def _rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def plays(spark):
    df = spark.createDataFrame(_plays(3), SCHEMA).selectExpr(
        "*", "IF(pitch_id % 5 = 0, NULL, pitch_id % 4) AS inning", "pitch_id % 7 AS batter",
        "CAST(90 AS DOUBLE) AS exit_speed", "IF(pitch_id % 3 = 0, NULL, CAST(10 AS DOUBLE)) AS angle")
    return df.cache()


def _deliver(df, base, name):
    return standing.apply_delivery(df, base, name, game=["game"], **_how())


def _check(spark, base, now):
    assert _rows(standing.standing(spark, base, "cells")) == _rows(runvalue.state_cells(now, **_how()))
    assert _rows(standing.standing(spark, base, "totals")) == _rows(batting.batter_totals(now, expected=False))


def test_deliveries_add_up_to_a_full_run(spark, plays, tmp_path):
    base = str(tmp_path / "standing")
    assert _deliver(plays.where("game = 'hot' AND pitch_id % 2 = 0"), base, "a")
    assert _deliver(plays.where("game = 'g1'"), base, "b")
    _check(spark, base, plays.where("game = 'g1' OR game = 'hot' AND pitch_id % 2 = 0"))
    # The hot game comes again, whole, with the games that have no name.
    assert _deliver(plays.where("game = 'hot' OR game IS NULL"), base, "c")
    assert not _deliver(plays.where("game = 'hot'"), base, "a")
    assert _deliver(plays.where("game = 'g2'"), base, "d")
    _check(spark, base, plays)
    assert all(publish.verify(spark, base).values())
    assert standing.compact(spark, base) == 6 and standing.compact(spark, base) == 0
    # After merging, corrections still find the games.
    gone = plays.withColumn("play_result", F.expr("IF(game = 'hot', NULL, play_result)"))
    assert _deliver(gone.where("game = 'hot' OR game IS NULL"), base, "e")
    _check(spark, base, gone)


def test_an_equal_game_changes_nothing(spark, plays, tmp_path):
    base = str(tmp_path / "standing")
    _deliver(plays, base, "a")
    _deliver(plays, base, "b")
    _check(spark, base, plays)
    assert publish.read_published(spark, base, "game_cells-00000002").count() == 0


def test_empty_deliveries(spark, plays, tmp_path):
    base = str(tmp_path / "standing")
    assert _deliver(plays.limit(0), base, "a")
    assert standing.standing(spark, base, "cells").count() == 0
    assert _deliver(plays, base, "b") and _deliver(plays.limit(0), base, "c")
    _check(spark, base, plays)


def test_a_delivery_that_stops_changes_nothing(spark, plays, tmp_path, monkeypatch):
    base, first = str(tmp_path / "standing"), plays.where("game = 'g1'")
    _deliver(first, base, "a")
    with monkeypatch.context() as m:
        m.setattr(standing.P, "switch", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            _deliver(plays.where("game = 'hot'"), base, "b")
    _check(spark, base, first)
    assert _deliver(plays.where("game = 'hot'"), base, "b")


def test_games_must_hold_their_half_innings(plays, tmp_path):
    with pytest.raises(ValueError):
        standing.apply_delivery(plays, str(tmp_path), "a", game=["batter"], **_how())
