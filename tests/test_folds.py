"""Cross-validation fits from shared passes."""

import pytest
from pyspark.sql import functions as F

from dugout.operators import clean, folds, model
from tests.conftest import SF
from verification import fixture as X

SETS = {"speed": ("exit_speed",), **model.FEATURE_SETS}


@pytest.fixture(scope="module")
def balls(spark):
    return model.kfold(clean.batted_balls(X.plays(spark, SF.replace("0.001", "0.01"))), ["pitch_id"], k=3).cache()


def test_equal_to_separate_fits(balls):
    together = folds.fit_folds_together(balls, k=3, feature_sets=SETS)
    apart = model.fit_folds(balls, k=3, feature_sets=SETS)
    assert together.converged and together.passes <= 14 and len(apart) == 36
    for a, b in zip(sorted(together.fits), sorted(apart)):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-6, abs=1e-6)


def test_losses_of_the_fits(balls):
    fits = folds.fit_folds_together(balls, k=3).fits
    losses = {tuple(r)[:2]: r["log_loss"] for r in model.score_folds(balls, fits).collect()}
    expected = {tuple(r)[:2]: r["log_loss"] for r in model.cross_validated_logloss(balls, k=3).collect()}
    assert losses == pytest.approx(expected, abs=1e-8)


def test_an_outcome_that_does_not_occur_is_reported(balls):
    some = balls.where("play_result <> 'Triple'")
    with pytest.warns(model.NotConverged):
        got = folds.fit_folds_together(some, k=3, feature_sets={"speed": ("exit_speed",)}, max_passes=12)
    assert not got.converged and got.passes == 12 and len(got.fits) == 12


def test_a_constant_feature_has_no_effect_of_its_own(balls):
    rows = balls.withColumn("one", F.lit(2.0))
    with_it = folds.fit_folds_together(rows, k=3, feature_sets={"s": ("exit_speed", "one")})
    without = folds.fit_folds_together(rows, k=3, feature_sets={"s": ("exit_speed",)})
    for a, b in zip(with_it.fits, without.fits):
        assert a[4] == pytest.approx(b[4], abs=1e-6) and a[3] + 2 * a[5] == pytest.approx(b[3], abs=1e-5)


def test_no_training_rows(balls):
    for rows in (balls.limit(0), balls.where("fold = 1")):
        with pytest.raises(ValueError):
            folds.fit_folds_together(rows, k=3)
