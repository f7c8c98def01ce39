"""Ids that stay over deliveries."""

import pytest

from dugout.sources import ledger, publish


def _deliver(spark, base, rows):
    df = spark.createDataFrame(rows, "batter string, outs int, other string").repartition(3)
    new = ledger.extend_ledger(df, base, ["batter", "outs"])
    found = {}
    for r in ledger.with_ledger_id(df, base, ["batter", "outs"]).collect():
        found.setdefault((r["batter"], r["outs"]), set()).add(r["pitch_id"])
    assert all(len(ids) == 1 for ids in found.values())
    return new, {k: min(v) for k, v in found.items()}


def test_three_deliveries(spark, tmp_path):
    base = str(tmp_path / "ledger")
    first = [(f"b{i}", i % 3, "x") for i in range(50)] + [(None, 1, "n"), (None, None, "n"), ("", 1, "e")]
    n, ids = _deliver(spark, base, first + first[:20])
    assert n == 53 and sorted(ids.values()) == list(range(1, 54))
    n, more = _deliver(spark, base, first[:10] + [(f"c{i}", None, "y") for i in range(30)])
    assert n == 30 and all(more[k] == ids[k] for k in ids if k in more)
    assert sorted(v for k, v in more.items() if k not in ids) == list(range(54, 84))
    n, again = _deliver(spark, base, first)  # late repeats
    assert n == 0 and again == ids and publish.published(spark, base)[0] == 2
    assert all(publish.verify(spark, base).values())


def test_empty_deliveries_and_unknown_rows(spark, tmp_path):
    base, schema = str(tmp_path / "ledger"), "batter string, outs int"
    assert ledger.extend_ledger(spark.createDataFrame([], schema), base, ["batter", "outs"]) == 0
    row = spark.createDataFrame([("Ann", 1)], schema)
    assert ledger.with_ledger_id(row, base, ["batter", "outs"]).first()["pitch_id"] is None
    assert ledger.extend_ledger(row, base, ["batter", "outs"]) == 1


def test_a_delivery_that_stops_gives_no_ids(spark, tmp_path, monkeypatch):
    base, row = str(tmp_path / "ledger"), spark.range(5)
    with monkeypatch.context() as m:
        m.setattr(ledger.P, "switch", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            ledger.extend_ledger(row, base, ["id"])
    assert ledger.read_ledger(spark, base).count() == 0
    assert ledger.extend_ledger(row, base, ["id"]) == 5
