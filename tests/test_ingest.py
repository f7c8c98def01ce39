"""CSV trees, season tables and round trips."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout import schema as S
from dugout.functions.columns import normalize_names, snake_case
from dugout.sources import csv_tree, tables
from dugout.sources.shared import materialize, shared_dir

SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("batter", T.StringType()), T.StructField("outs", T.IntegerType()),
    T.StructField("exit_speed", T.DoubleType()), T.StructField("is_end", T.BooleanType()),
])


def _tree(tmp_path):
    (tmp_path / "x" / "deep").mkdir(parents=True)
    (tmp_path / "a.csv").write_text(
        "Date,Batter,Outs,ExitSpeed,IsEnd\n2023-05-01,Ann,1,90.5,TRUE\n2023-05-02,NA,NA,,FALSE\n"
    )
    (tmp_path / "x" / "deep" / "b.csv").write_text(
        "Batter,Extra,ExitSpeed,Date,Outs\nBob,zzz,fast,2023-06-01,2.0\nCy,yyy,NaN,June,two\n\"Dee, Jr\",q,101,2023-06-03,0\n"
    )
    (tmp_path / "x" / "c.csv").write_text("\x00\x01garbage\nmore garbage\n")
    (tmp_path / "x" / "notes.txt").write_text("Date,Batter\nno,no\n")
    return str(tmp_path)


def test_tree_is_conformed(spark, tmp_path):
    tree = csv_tree.read_csv_tree(spark, _tree(tmp_path), SCHEMA)
    assert tree.rows.schema.simpleString() == SCHEMA.simpleString()
    got = sorted((tuple(r) for r in tree.rows.collect()), key=str)
    day = lambda m, d: dt.date(2023, m, d)
    assert got == sorted([
        (day(5, 1), "Ann", 1, 90.5, True), (day(5, 2), None, None, None, False),
        (day(6, 1), "Bob", 2, None, None), (None, "Cy", None, None, None), (day(6, 3), "Dee, Jr", 0, 101.0, None),
    ], key=str)
    bad = tree.quarantine.collect()
    assert {r.reason for r in bad} == {"unknown layout"} and len(bad) == 2
    assert all(r.file_path.endswith("c.csv") for r in bad)


def test_schema_comes_from_the_first_file(spark, tmp_path):
    rows = csv_tree.read_csv_tree(spark, _tree(tmp_path)).rows
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema.fields] == [
        ("date", "date"), ("batter", "string"), ("outs", "int"), ("exit_speed", "double"), ("is_end", "boolean")
    ]
    assert rows.count() == 5


def test_clock_times_stay_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,x\n19:05:32,1\n19:05:40,2\n")
    assert dict(csv_tree.infer_schema(spark, str(tmp_path / "a.csv")).jsonValue()["fields"][0])["type"] == "string"


@pytest.mark.parametrize("make", [True, False])
def test_empty_tree_has_the_declared_schema(spark, tmp_path, make):
    folder = tmp_path / "season"
    if make:
        folder.mkdir()
    tree = csv_tree.read_csv_tree(spark, str(folder))
    assert tree.rows.schema == S.SEASON_SCHEMA and tree.rows.count() == 0 and tree.quarantine.count() == 0


def test_season_overwrite_keeps_other_seasons(spark, tmp_path):
    path = str(tmp_path / "pitches")
    old = spark.createDataFrame([(2023, "a"), (2024, "b"), (2024, "c")], "season int, batter string")
    tables.write_season_table(old, path)
    tables.write_season_table(old.where("season = 2024").limit(1).withColumn("batter", F.lit("new")), path)
    assert sorted(tuple(r) for r in tables.read_season_table(spark, path).select("season", "batter").collect()) == [
        (2023, "a"), (2024, "new")
    ]
    pruned = tables.extract(tables.read_season_table(spark, path), 2024, ["batter"])
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "ReadSchema: struct<batter:string>" in plan


def test_csv_round_trip_keeps_nulls_and_dots(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 0.1), (None, None, None), ("NA", 3, 1e-9)], "`Top/Bottom` string, Outs int, ExitSpeed double")
    path = str(tmp_path / "out")
    tables.write_csv(df, path)
    back = tables.read_csv(spark, path, df.schema)
    assert back.columns == ["top_bottom", "outs", "exit_speed"]
    # the text "NA" is the null marker of the format
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted([("x", 1, 0.1), (None, None, None), (None, 3, 1e-9)], key=str)


def test_names():
    given = {
        "Top/Bottom": "top_bottom", "Top.Bottom": "top_bottom", "2024.Level": "level_2024", "ExitSpeed": "exit_speed",
        "PAofInning": "pa_of_inning", "K_percentage": "k_percentage", " Game ID ": "game_id", "GameID": "game_id",
        "xWOBA_plus": "xwoba_plus", "wOBA": "woba", "xHomeRuns": "x_home_runs", "Avg_ExitSpeed_50": "avg_exit_speed_50",
        "Total_PA": "total_pa", "x1B": "x1b",
    }
    assert {n: snake_case(n) for n in given} == given


def test_normalize(spark):
    assert normalize_names(spark.createDataFrame([(1, 2)], "`2022.level` int, xWOBA int")).columns == ["level_2022", "xwoba"]


def test_shared_dir_follows_the_session(spark, tmp_path):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()).rstrip("/")
    df = materialize(spark.range(5).withColumn("k", F.struct("id")), "t")
    assert df.count() == 5 and df.columns == ["id", "k"]


class _Session:
    """The few parts of a session that decide on the shared folder."""

    def __init__(self, setting, checkpoint, warehouse, master="spark://x"):
        self.master = master
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.conf["spark.sql.warehouse.dir"] = warehouse
        self.sparkContext = self
        self._checkpoint = checkpoint

    def getCheckpointDir(self):
        return self._checkpoint


def test_shared_dir_rules():
    assert shared_dir(_Session("hdfs:/shared/", "file:/x", "hdfs:/house")) == "hdfs:/shared"
    assert shared_dir(_Session(None, "hdfs:/other", "hdfs:/house")) == "hdfs:/other"
    assert shared_dir(_Session(None, None, "hdfs:/house/")) == "hdfs:/house/checkpoints"
    assert shared_dir(_Session(None, None, "file:/house", "local[4]")) == "file:/house/checkpoints"
    for own in ("file:/house", "/house"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(_Session(None, None, own))


def _accounted(tree):
    return tree.rows.count(), [tuple(r) for r in tree.quarantine.orderBy("reason", "record").collect()]


def test_quarantined_records_are_not_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("batter,outs,note\nAnn,1,x\nBob,2,y,extra\nCy\n\"D, E\",0,\"a,b\"\n")
    schema = T.StructType([T.StructField("batter", T.StringType()), T.StructField("outs", T.IntegerType())])
    tree = csv_tree.read_csv_tree(spark, str(tmp_path), schema)
    assert sorted(tuple(r) for r in tree.rows.collect()) == [("Ann", 1), ("D, E", 0)]
    assert [(r.reason, r.record) for r in tree.quarantine.orderBy("record").collect()] == [
        ("ragged row", "Bob,2,y,extra"), ("ragged row", "Cy")]


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('batter,outs\n"Two\nLines",0\nAnn,1\n')
    (tmp_path / "b.csv").write_text('extra,outs,batter\n"p\nq",2,"Three\n\nLines"\n')
    schema = T.StructType([T.StructField("batter", T.StringType()), T.StructField("outs", T.IntegerType())])
    tree = csv_tree.read_csv_tree(spark, str(tmp_path), schema, multi_line=True)
    assert sorted(tuple(r) for r in tree.rows.collect()) == [
        ("Ann", 1), ("Three\n\nLines", 2), ("Two\nLines", 0)]
    assert tree.quarantine.count() == 0


def _damage(spark, tmp_path):
    """Two written files of 200,000 rows, one byte flipped in one of them; its checksum no longer fits."""
    df = spark.range(200_000).selectExpr("id AS pitch_id", "'B' || id AS batter")
    for name in ("good", "bad"):
        tables.write_csv(df.coalesce(1), str(tmp_path / name))
    target = next((tmp_path / "bad").glob("part-*.csv"))
    raw = bytearray(target.read_bytes())
    raw[len(raw) // 2] ^= 1
    target.write_bytes(raw)
    return target.name


def test_a_damaged_file_is_left_out_whole_and_listed(spark, tmp_path):
    name = _damage(spark, tmp_path)
    schema = T.StructType([T.StructField("pitch_id", T.LongType()), T.StructField("batter", T.StringType())])
    rows, bad = _accounted(csv_tree.read_csv_tree(spark, str(tmp_path), schema, skip_damaged=True))
    assert rows == 200_000
    assert [(r[0], r[1].endswith(name), r[2]) for r in bad] == [("damaged file", True, None)]


def test_a_damaged_file_is_an_error_by_default(spark, tmp_path):
    from pyspark.errors import PySparkException

    _damage(spark, tmp_path)
    with pytest.raises((PySparkException, Exception), match="(?i)checksum|corrupt|FAILED_READ_FILE"):
        csv_tree.read_csv_tree(spark, str(tmp_path)).rows.count()


def test_other_errors_are_not_taken_for_an_empty_folder(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        csv_tree.read_csv_tree(spark, "nosuchscheme://x/y")


def test_one_scan_whatever_the_number_of_layouts(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.csv").write_text(",".join(["batter", *[f"c{k}" for k in range(i)]]) + "\nAnn" + ",1" * i + "\n")
    tree = csv_tree.read_csv_tree(spark, str(tmp_path), SCHEMA)
    plan = tree.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and tree.rows.count() == 6


def test_extracts_are_read_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text("batter,Angle,ExitSpeed\nAnn,12.5,90\nNA,,101\n")
    schema = T.StructType([T.StructField("Batter", T.StringType()), T.StructField("ExitSpeed", T.DoubleType()),
                           T.StructField("Angle", T.DoubleType()), T.StructField("outs", T.IntegerType())])
    got = tables.read_csv(spark, str(tmp_path), schema)
    assert got.columns == ["batter", "exit_speed", "angle", "outs"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == [("Ann", 90.0, 12.5, None), (None, 101.0, None, None)]


def test_paths_say_where_they_are(spark):
    from dugout.sources.shared import new_path

    path = new_path(spark, "x")  # the shared folder of these tests is given without a scheme
    assert path.startswith("file:/") and "/dugout/x-" in path


def test_written_tables_can_be_removed(spark, tmp_path, monkeypatch):
    from dugout.sources import shared

    monkeypatch.setattr(shared, "_WRITTEN", {})
    path = materialize(spark.range(3)).inputFiles()[0]
    assert shared.remove_written(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
