"""Deliveries, and results that appear whole or not at all."""

import os

import pytest
from pyspark.sql import types as T

from dugout.sources import incremental, publish

SCHEMA = T.StructType([T.StructField("batter", T.StringType()), T.StructField("outs", T.IntegerType())])


@pytest.fixture
def tree(tmp_path):
    class Tree:
        roots = {2023: str(tmp_path / "2023"), 2024: str(tmp_path / "2024")}
        base = str(tmp_path / "table")

        def put(self, season, name, *rows):
            path = tmp_path / str(season) / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("batter,outs\n" + "".join(f"{b},{o}\n" for b, o in rows))
            return path

    return Tree()


def _rows(spark, tree):
    return sorted(tuple(r) for r in incremental.read_seasons(spark, tree.base).select("season", "batter", "outs").collect())


def test_three_deliveries(spark, tree):
    run = lambda: incremental.ingest_deliveries(spark, tree.roots, tree.base, SCHEMA)
    tree.put(2023, "home/a.csv", ("Ann", 1), ("Bob", 2))
    tree.put(2023, "away/a.csv", ("Bob", 2), ("Cy", 0))
    first = run()
    assert (first.number, first.listed, first.read, first.gone, first.seasons) == (1, 2, 2, 0, (2023,))
    assert _rows(spark, tree) == [(2023, "Ann", 1), (2023, "Bob", 2), (2023, "Cy", 0)]
    old = publish.published(spark, tree.base)[1]["season=2023"]

    tree.put(2024, "b.csv", ("Dee", 1), ("Ann", 1))
    second = run()
    assert (second.read, second.seasons) == (1, (2024,))
    assert publish.published(spark, tree.base)[1]["season=2023"] == old  # not rewritten

    os.remove(tree.put(2023, "home/a.csv"))  # Bob stays: the other team delivers the play too
    changed = tree.put(2024, "b.csv", ("Dee", 1), ("Eve", 2))
    os.utime(changed, (2e9, 2e9))
    third = run()
    assert (third.read, third.gone, third.seasons) == (1, 2, (2023, 2024))
    assert _rows(spark, tree) == [(2023, "Bob", 2), (2023, "Cy", 0), (2024, "Dee", 1), (2024, "Eve", 2)]


def test_a_rerun_without_change_reads_nothing(spark, tree, monkeypatch):
    touched = tree.put(2023, "a.csv", ("Ann", 1))
    tree.put(2023, "b.csv", ("Bob", 1))
    incremental.ingest_deliveries(spark, tree.roots, tree.base, SCHEMA)
    before = publish.published(spark, tree.base)
    with monkeypatch.context() as m:
        for name in ("read_csv_tree", "file_digests"):
            m.setattr(incremental, name, lambda *a, **k: pytest.fail("read a file"))
        again = incremental.ingest_deliveries(spark, tree.roots, tree.base, SCHEMA)
    assert (again.listed, again.read, again.seasons) == (2, 0, ()) and publish.published(spark, tree.base) == before
    os.utime(touched, (2e9, 2e9))  # another time, the same content: no season is rewritten
    later = incremental.ingest_deliveries(spark, tree.roots, tree.base, SCHEMA)
    assert (later.read, later.seasons) == (0, ())
    with monkeypatch.context() as m:
        m.setattr(incremental, "file_digests", lambda *a, **k: pytest.fail("read a file"))
        incremental.ingest_deliveries(spark, tree.roots, tree.base, SCHEMA)
    assert _rows(spark, tree) == [(2023, "Ann", 1), (2023, "Bob", 1)]


def test_a_run_that_stops_before_the_switch_leaves_the_earlier_table(spark, tree, monkeypatch):
    tree.put(2023, "a.csv", ("Ann", 1))
    incremental.ingest_deliveries(spark, tree.roots, tree.base, SCHEMA)
    tree.put(2023, "b.csv", ("Bob", 1))
    with monkeypatch.context() as m:
        m.setattr(incremental.P, "switch", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            incremental.ingest_deliveries(spark, tree.roots, tree.base, SCHEMA)
    assert _rows(spark, tree) == [(2023, "Ann", 1)] and all(publish.verify(spark, tree.base).values())
    assert publish.remove_unpublished(spark, tree.base) == 2
    done = incremental.ingest_deliveries(spark, tree.roots, tree.base, SCHEMA)
    assert done.read == 1 and _rows(spark, tree) == [(2023, "Ann", 1), (2023, "Bob", 1)]


def test_nulls_repeats_and_rejected_records(spark, tree):
    path = tree.put(2023, "a.csv", ("NA", "NA"), ("NA", "NA"), ("Ann", 1))
    path.write_text(path.read_text() + "only one\n")
    done = incremental.ingest_deliveries(spark, tree.roots, tree.base, SCHEMA)
    assert [(r["season"], r["reason"]) for r in done.quarantine.collect()] == [(2023, "ragged row")]
    found = incremental.read_seasons(spark, tree.base, [2023]).select("batter", "outs").collect()
    assert sorted(map(str, map(tuple, found))) == ["('Ann', 1)", "(None, None)"]
    with pytest.raises(KeyError):
        incremental.read_seasons(spark, tree.base, [2024])


def test_tables_appear_together(spark, tmp_path, monkeypatch):
    base, df = str(tmp_path / "out"), spark.range(5).selectExpr("id", "id / 3 AS share", "if(id > 2, 'x,\"y', NULL) AS name")
    assert publish.published(spark, base) == (0, {}, {})
    assert publish.publish({"a": df, "b": df.limit(2)}, base, format="csv") == 1
    broken = df.selectExpr("id", "raise_error('stopped') AS name")
    with pytest.raises(Exception, match="stopped"):
        publish.publish({"a": df.limit(1), "b": broken}, base)
    read = lambda name: publish.read_published(spark, base, name)
    assert sorted(map(tuple, read("a").collect())) == sorted(map(tuple, df.collect())) and read("b").count() == 2
    assert publish.publish({"b": df.limit(3)}, base) == 2
    assert read("a").count() == 5 and read("b").count() == 3 and publish.verify(spark, base) == {"a": True, "b": True}


def test_two_runs_at_once_and_tables_that_a_format_cannot_hold(spark, tmp_path):
    base, df = str(tmp_path / "out"), spark.range(3)
    publish.publish({"a": df}, base)
    with pytest.raises(publish.Conflict):
        publish.switch(spark, base, 0, {})
    with pytest.raises(ValueError, match="survive"):
        publish.publish({"a": df.selectExpr("concat('two\\nlines', id) AS s")}, base, format="csv")
    assert publish.published(spark, base)[0] == 1 and publish.read_published(spark, base, "a").count() == 3


def test_a_damaged_table_is_noticed(spark, tmp_path):
    base = str(tmp_path / "out")
    publish.publish({"a": spark.range(10).coalesce(1), "b": spark.range(2)}, base, format="csv")
    _, parts, _ = publish.published(spark, base)
    folder = tmp_path / "out" / parts["a"].folder
    target = next(folder.glob("part-*.csv"))
    target.write_text(target.read_text().replace("7", "8"))
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    assert publish.verify(spark, base) == {"a": False, "b": True}
