"""One entry per operator: the Spark query and, where it exists, the SQL definition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout import schema as S
from dugout.functions import columns as C
from dugout.functions.scoring import LinearModel, add_class_probabilities, binary_probability
from dugout.operators import batting, clean, evaluate, folds, indexing, levels, model, ordered, quality, radix, runvalue, smooth
from dugout.plans import projection, season, standing
from dugout.session import side_by_side
from dugout.sources import csv_tree, incremental, ledger, publish, tables
from dugout.sources.shared import new_path
from verification import fixture as X
from verification import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = O.DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits: sums of doubles depend on their order."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def query(name: str, sql: str | None = None, digits: int = O.DIGITS):
    """``digits`` is lower where values are around 100 and carry as many more digits of noise."""
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _half_innings() -> dict:
    return {"half_inning": X.HALF_INNING, "order": X.ORDER, "chunk": X.chunk()}


def _scored(spark, d) -> DataFrame:
    return season.score_pitches(X.plays(spark, d), X.OUTCOME_MODEL)


def _cells(spark, d) -> DataFrame:
    return runvalue.state_cells(X.plays(spark, d), **_half_innings())


def _weights(spark, d) -> DataFrame:
    return runvalue.linear_weights(runvalue.run_values(_cells(spark, d)))


def _statistics(spark, d, **options) -> season.SeasonStatistics:
    return season.season_statistics(_scored(spark, d), minimum=X.MINIMUM, **_half_innings(), **options)


def _lines(spark, d) -> DataFrame:
    return batting.batting_line(batting.batter_totals(_scored(spark, d)), minimum=X.MINIMUM)


# --- sources ------------------------------------------------------------------------

INGEST_SCHEMA = T.StructType([
    T.StructField("pitch_id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("batter", T.StringType()),
    T.StructField("play_result", T.StringType()),
    T.StructField("outs", T.IntegerType()),
    T.StructField("exit_speed", T.DoubleType()),
    T.StructField("angle", T.DoubleType()),
])
INGEST_COLUMNS = " ".join(f.name for f in INGEST_SCHEMA.fields)


def _write_tree(spark, d) -> str:
    """CSV tree from the pitch log: a reference layout, a drifted one and an unreadable one."""
    root = new_path(spark, "tree")
    log = X.pitch_log(spark, d)
    tables.write_csv(
        log.where(F.col("pitch_id") % 3 != 1).select(*INGEST_COLUMNS.split()).withColumnsRenamed(
            {"pitch_id": "PitchID", "play_result": "PlayResult", "exit_speed": "ExitSpeed"}
        ).withColumnRenamed("PitchID", "pitch_id"),
        f"{root}/a_reference",
    )
    drifted = log.where((F.col("pitch_id") % 3 == 1) & (F.col("pitch_id") % 7 != 0)).select(
        F.when(F.col("pitch_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("exit_speed").cast("string")).alias("ExitSpeed"),
        F.when(F.col("pitch_id") % 8 == 0, F.lit("soon")).otherwise(F.col("date").cast("string")).alias("Date"),
        "pitcher", "batter", F.col("play_result").alias("PlayResult"),
        F.concat(F.col("outs").cast("string"), F.lit(".0")).alias("Outs"), "pitch_id",
    )
    tables.write_csv(drifted, f"{root}/b_drifted")
    broken = log.where((F.col("pitch_id") % 3 == 1) & (F.col("pitch_id") % 7 == 0))
    broken.select(F.concat(F.lit("###"), F.col("pitch_id").cast("string"))).write.csv(f"{root}/c_broken")
    return root


_TREE_SQL = f"""{O.LOG}, tree AS (
  SELECT pitch_id,
    CASE WHEN pitch_id % 3 = 1 AND pitch_id % 8 = 0 THEN NULL ELSE date END AS date, batter, play_result, outs,
    CASE WHEN pitch_id % 3 = 1 AND pitch_id % 5 = 0 THEN NULL ELSE exit_speed END AS exit_speed,
    CASE WHEN pitch_id % 3 = 1 THEN NULL ELSE angle END AS angle
  FROM log WHERE pitch_id % 3 <> 1 OR pitch_id % 7 <> 0)"""


@query("ingest_csv_tree", O.final(_TREE_SQL, "tree", "pitch_id batter play_result", "exit_speed angle"))
def _(spark, d):
    rows = csv_tree.read_csv_tree(spark, _write_tree(spark, d)).rows  # schema taken from the first file
    return rows.select(F.col("pitch_id").cast("long").alias("pitch_id"), "batter", "play_result", "exit_speed", "angle")


@query("ingest_conform", O.final(_TREE_SQL, "tree", "pitch_id date batter play_result outs", "exit_speed angle"))
def _(spark, d):
    return csv_tree.read_csv_tree(spark, _write_tree(spark, d), INGEST_SCHEMA).rows


@query("ingest_quarantine", f"""WITH {O.LOG}
SELECT 'unknown layout' AS reason, count(*) AS n FROM log WHERE pitch_id % 3 = 1 AND pitch_id % 7 = 0
UNION ALL SELECT 'ragged row', count(*) FROM log WHERE pitch_id % 11 = 0""")
def _(spark, d):
    root = _write_tree(spark, d)
    surplus = F.when(F.col("pitch_id") % 11 == 0, F.lit("surplus"))  # concat_ws leaves nulls out
    ragged = X.pitch_log(spark, d).select(
        F.concat_ws(",", F.col("pitch_id").cast("string"), "batter", F.lit("Out"), surplus)
        .alias("pitch_id,batter,play_result")
    )
    ragged.write.option("header", True).option("sep", "|").csv(f"{root}/d_ragged")
    found = csv_tree.read_csv_tree(spark, root, INGEST_SCHEMA).quarantine
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query("schema_lattice", f"""WITH {O.LOG}, kept AS (SELECT *, pitch_id % 3 = 1 AS drifted FROM log WHERE pitch_id % 3 <> 1 OR pitch_id % 7 <> 0),
cells AS (
  SELECT 'pitch_id' AS name, CAST(pitch_id AS VARCHAR) AS v FROM kept
  UNION ALL SELECT 'batter', batter FROM kept
  UNION ALL SELECT 'play_result', play_result FROM kept
  UNION ALL SELECT 'pitcher', pitcher FROM kept WHERE drifted
  UNION ALL SELECT 'angle', CAST(angle AS VARCHAR) FROM kept WHERE NOT drifted
  UNION ALL SELECT 'date', CASE WHEN drifted AND pitch_id % 8 = 0 THEN 'soon' ELSE CAST(date AS VARCHAR) END FROM kept
  UNION ALL SELECT 'outs', CAST(outs AS VARCHAR) || CASE WHEN drifted THEN '.0' ELSE '' END FROM kept
  UNION ALL SELECT 'exit_speed', CASE WHEN drifted AND pitch_id % 5 = 0 THEN 'n/a' ELSE CAST(exit_speed AS VARCHAR) END FROM kept),
kinds AS (
  SELECT name, CASE
    WHEN regexp_full_match(v, '[+-]?(0|[1-9][0-9]*)') THEN CASE WHEN TRY_CAST(v AS INT) IS NOT NULL THEN 1 ELSE 2 END
    WHEN regexp_full_match(v, '[+-]?((0|[1-9][0-9]*)([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 4
    WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 16 ELSE 32 END AS kind
  FROM cells WHERE v IS NOT NULL)
SELECT name, CASE bit_or(kind) WHEN 1 THEN 'int' WHEN 2 THEN 'bigint' WHEN 3 THEN 'bigint' WHEN 16 THEN 'date'
    ELSE CASE WHEN bit_or(kind) < 8 THEN 'double' ELSE 'string' END END AS type, count(*) AS filled
FROM kinds GROUP BY name""")
def _(spark, d):
    rows = csv_tree.read_csv_tree(spark, _write_tree(spark, d), types="all").rows
    filled = rows.agg(*[F.count(f.name).alias(f.name) for f in rows.schema.fields])
    return filled.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).alias("filled"))
        for f in rows.schema.fields])))


def _deliver(log: DataFrame, root: str, name: str) -> None:
    columns = INGEST_COLUMNS.split()
    log.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", tables.NULL_TEXT).csv(f"{root}/{name}")


@query("ingest_deliveries", f"""WITH {O.LOG}
SELECT season, pitch_id, date, batter, outs FROM log WHERE pitch_id % 4 <> 3 AND (season = {X.SEASONS[0]} OR pitch_id % 4 <> 1)""")
def _(spark, d):
    base, log = new_path(spark, "deliveries"), X.pitch_log(spark, d)
    roots = {s: f"{base}/in/{s}" for s in X.SEASONS}
    part = lambda s, k: log.where((F.col("season") == s) & (F.col("pitch_id") % 4 == k))
    for s in X.SEASONS:  # every play is delivered by both teams
        for team in ("home", "away"):
            _deliver(part(s, 0), roots[s], f"{team}_0")
            _deliver(part(s, 1), roots[s], f"{team}_1")
            _deliver(part(s, 3).limit(100), roots[s], f"{team}_3")
    incremental.ingest_deliveries(spark, roots, f"{base}/table", INGEST_SCHEMA)
    late = X.SEASONS[1]
    for s in X.SEASONS:  # files that changed: other plays under the name of a delivered folder
        _deliver(part(s, 2), roots[s], "home_3")
        _deliver(part(s, 2), roots[s], "away_3")
    for team in ("home", "away"):  # files that are empty now hold no plays any more
        _deliver(part(late, 1).limit(0), roots[late], f"{team}_1")
    incremental.ingest_deliveries(spark, roots, f"{base}/table", INGEST_SCHEMA)
    return incremental.read_seasons(spark, f"{base}/table").select("season", "pitch_id", "date", "batter", "outs")


@query("pitch_id_ledger", f"""WITH {O.LOG}, first AS (
  SELECT date, time, pitcher, batter, game_id, inning, top_bottom, min(CASE WHEN pitch_id % 3 = 0 THEN 1 WHEN pitch_id % 3 = 1 THEN 2 ELSE 3 END) AS d
  FROM log GROUP BY ALL)
SELECT d AS delivery, count(*) AS plays, count(*) AS ids, 1 + coalesce(sum(count(*)) OVER (
    ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_id,
  (sum(count(*)) OVER (ORDER BY d))::BIGINT AS last_id
FROM first GROUP BY d""")
def _(spark, d):
    base, log = new_path(spark, "ledger"), X.pitch_log(spark, d)
    key = ["date", "time", "pitcher", "batter", "game_id", "inning", "top_bottom"]
    third = F.col("pitch_id") % 3
    for late in (third == 0, third <= 1, third >= 0):  # every delivery repeats the earlier ones
        ledger.extend_ledger(log.where(late), base, key)
    plays = ledger.with_ledger_id(log.withColumn("delivery", (third + 1).cast("int")), base, key, "id")
    known = plays.groupBy(*key).agg(F.min("delivery").alias("delivery"), F.min("id").alias("id"), F.count_distinct("id").alias("n"))
    return known.groupBy("delivery").agg(
        F.count("*").alias("plays"), F.sum("n").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("published_results", f"""WITH {O.PLAYERS}
SELECT 'players' AS name, count(*) AS n, CAST(sum(total_pa) AS BIGINT) AS pa FROM players
UNION ALL SELECT 'weights', count(*), count(m3_weight) FROM weights""")
def _(spark, d):
    base, stats = new_path(spark, "results"), _statistics(spark, d)
    publish.publish({"players": stats.players.limit(1), "weights": stats.weights}, base)
    publish.publish({"players": stats.players}, base, format="csv")
    assert all(publish.verify(spark, base).values())
    size = lambda name, total: publish.read_published(spark, base, name).agg(
        F.lit(name).alias("name"), F.count("*").alias("n"), total.cast("long").alias("pa"))
    return size("players", F.sum("total_pa")).unionByName(size("weights", F.count("m3_weight")))


_DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


@query("ingest_multiline", """
SELECT doc_id, nullif(text, '') AS text, lang FROM documents
UNION ALL SELECT o_orderkey, o_comment, o_orderpriority FROM (
  SELECT o_orderkey, 'said "' || o_orderstatus || '",' || chr(10) || chr(10) || 'then ' || o_orderdate AS o_comment,
    o_orderpriority FROM orders WHERE o_orderkey % 3 = 0)""")
def _(spark, d):
    root = new_path(spark, "quoted")
    options = {"header": True, "escape": '"', "nullValue": tables.NULL_TEXT, "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}
    X.table(spark, d, "documents").select("doc_id", "text", "lang").write.options(**options).csv(f"{root}/a")
    orders = X.table(spark, d, "orders").where(F.col("o_orderkey") % 3 == 0).select(
        F.col("o_orderpriority").alias("lang"), F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit('said "'), "o_orderstatus", F.lit('",\n\nthen '), F.col("o_orderdate").cast("string")).alias("text"))
    orders.write.options(**options).csv(f"{root}/b")  # another order of columns
    return csv_tree.read_csv_tree(spark, root, _DOCUMENT_SCHEMA, multi_line=True).rows


@query("union_sources", """
SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, CAST(NULL AS DOUBLE), o_orderpriority FROM orders WHERE o_orderkey % 2 <> 0""")
def _(spark, d):
    orders = X.table(spark, d, "orders")
    even = F.col("o_orderkey") % 2 == 0
    return tables.union_sources([
        orders.where(even).select("o_orderkey", "o_totalprice"),
        orders.where(~even).select("o_orderkey", "o_orderpriority"),
    ])


def _season_table(spark, d) -> str:
    """Season table written twice: the second write replaces only the season it holds."""
    path = new_path(spark, "pitches")
    log = X.pitch_log(spark, d)
    tables.write_season_table(log, path)
    tables.write_season_table(log.where(F.col("season") == X.SEASONS[1]), path)
    return path


@query("season_table", f"""WITH {O.LOG}
SELECT season, batter, count(*) AS n, count(play_result) AS results, CAST(sum(pitch_id) AS BIGINT) AS id_sum
FROM log GROUP BY season, batter""")
def _(spark, d):
    return tables.read_season_table(spark, _season_table(spark, d)).groupBy("season", "batter").agg(
        F.count("*").alias("n"), F.count("play_result").alias("results"), F.sum("pitch_id").alias("id_sum")
    )


@query("extract_pitches", O.final(
    O.LOG, f"log WHERE season = {X.SEASONS[0]}", " ".join(S.PITCH_COLUMNS[:-3]), " ".join(S.PITCH_COLUMNS[-3:])))
def _(spark, d):
    return tables.extract_pitches(tables.read_season_table(spark, _season_table(spark, d)), X.SEASONS[0])


@query("extract_plays", O.final(O.LOG, f"log WHERE season = {X.SEASONS[1]}", " ".join(S.PLAY_COLUMNS)))
def _(spark, d):
    return tables.extract_plays(tables.read_season_table(spark, _season_table(spark, d)), X.SEASONS[1])


@query("csv_roundtrip", O.final(O.LOG, "log", " ".join(S.PLAY_COLUMNS), "exit_speed angle"))
def _(spark, d):
    path = new_path(spark, "extract")
    names = {"play_result": "PlayResult", "top_bottom": "Top/Bottom", "game_id": "GameID", "exit_speed": "ExitSpeed"}
    out = X.pitch_log(spark, d).select(*S.PLAY_COLUMNS, "exit_speed", "angle").withColumnsRenamed(names)
    tables.write_csv(out, path)
    back = tables.read_csv(spark, path, out.schema)
    return back


@query("load_profiles", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    base = new_path(spark, "workbook")
    sheet = X.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    tables.write_sheet(sheet.toDF(*[c.upper() for c in sheet.columns]), base, "2024 m1")
    return tables.read_sheet(spark, base, "2024 m1")


# --- cleaning -----------------------------------------------------------------------


@query("dedup_rows", O.final(O.PLAYS, "(SELECT DISTINCT * FROM (SELECT * FROM plays UNION ALL SELECT * FROM plays))",
                             "pitch_id season batter play_result outs runs_scored", "exit_speed angle direction"))
def _(spark, d):
    plays = X.plays(spark, d)
    return clean.deduplicate(plays.unionAll(plays)).select(
        "pitch_id", "season", "batter", "play_result", "outs", "runs_scored", "exit_speed", "angle", "direction"
    )


@query("pitch_id_dense", """
SELECT event_id, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || ':0'), event_id) AS row_id FROM events""")
def _(spark, d):
    return clean.with_dense_id(X.table(spark, d, "events").select("event_id"), ["event_id"], name="row_id")


@query("batted_balls", O.final(O.BALLS, "balls", "season pitch_id play_result outcome", "exit_speed angle"))
def _(spark, d):
    return clean.batted_balls(X.plays(spark, d)).select(
        "season", "pitch_id", "play_result", "exit_speed", "angle", "outcome"
    )


@query("hit_indicators", f"""WITH {O.PLAYS}
SELECT pitch_id, {", ".join(f"CAST(CASE WHEN play_result IS NULL THEN NULL WHEN play_result = '{r}' THEN 1 ELSE 0 END AS DOUBLE) AS {n}"
       for r, n in zip(S.HITS, model.OUTCOME_FLAGS))} FROM plays""")
def _(spark, d):
    return clean.hit_indicators(X.plays(spark, d)).select("pitch_id", *model.OUTCOME_FLAGS)


@query("outcome_label", f"""WITH {O.PLAYS}
SELECT pitch_id, CASE play_result WHEN 'Single' THEN 'Single' WHEN 'Double' THEN 'Double'
  WHEN 'Triple' THEN 'Triple' WHEN 'HomeRun' THEN 'HomeRun' ELSE 'Not a Hit' END AS outcome FROM plays""")
def _(spark, d):
    return X.plays(spark, d).select("pitch_id", clean.outcome_label().alias("outcome"))


@query("tracked_results", f"""WITH {O.PLAYS}
SELECT pitch_id, play_result FROM plays WHERE play_result IS NOT NULL
  AND NOT (play_result IN ({O.TRACK}) AND (exit_speed IS NULL OR angle IS NULL))""")
def _(spark, d):
    return clean.tracked_results(X.plays(spark, d)).select("pitch_id", "play_result")


@query("distinct_results", f"WITH {O.PLAYS} SELECT DISTINCT play_result FROM plays")
def _(spark, d):
    return clean.distinct_values(X.plays(spark, d), "play_result")


def _customer_with_gap(spark, d) -> DataFrame:
    return X.table(spark, d, "customer").withColumn("nickname", F.lit(None).cast("string"))


@query("null_profile", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM (SELECT *, NULL AS nickname FROM customer)"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "nickname")))
def _(spark, d):
    return clean.null_profile(_customer_with_gap(spark, d))


@query("drop_empty_columns", "SELECT * FROM customer")
def _(spark, d):
    return clean.drop_empty_columns(_customer_with_gap(spark, d))


@query("normalize_names", "SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS level_2024 FROM nation")
def _(spark, d):
    return C.normalize_names(X.table(spark, d, "nation").toDF("NationKey", "Nation.Name", "2024.Level"))


@query("attach_lookup", f"""WITH {O.PLAYS}
SELECT pitch_id, batter, CASE WHEN batter % 7 = 3 THEN NULL ELSE 22 + batter % 15 END AS age FROM plays""")
def _(spark, d):
    plays = X.plays(spark, d)
    return clean.attach(plays.select("pitch_id", "batter"), _ages(plays), ["batter"])


def _ages(plays: DataFrame) -> DataFrame:
    known = plays.select("batter").distinct().where(F.col("batter") % 7 != 3)
    return known.withColumn("age", F.lit(22) + F.col("batter") % 15)


@query("pa_boundary", f"""WITH {O.LOG}, dated AS (
  SELECT l.*, p.ts, p.game_no, p.game_date FROM log l JOIN ({X.PLAYS}) p USING (pitch_id))
SELECT pitch_id, coalesce(pa_of_inning <> lag(pa_of_inning) OVER (
  PARTITION BY game_date, game_no, inning, top_bottom ORDER BY ts, pitch_id), FALSE) AS is_new_pa FROM dated""")
def _(spark, d):
    counted = X.plays(spark, d).withColumn("pa_of_inning", (F.col("pitch_id") % 6).cast("int") + 1)
    return clean.plate_appearance_changes(counted, **_half_innings()).select("pitch_id", "is_new_pa")


# --- batting ------------------------------------------------------------------------


@query("plate_appearances", f"""WITH {O.PLAYS}
SELECT season, batter, count(*) AS total_pa FROM plays WHERE play_result IS NOT NULL GROUP BY season, batter""")
def _(spark, d):
    return batting.plate_appearances(X.plays(spark, d))


@query("qualified_batters", f"WITH {O.PLAYS}, {O.QUALIFIED} SELECT * FROM qualified")
def _(spark, d):
    return batting.qualified_batters(X.plays(spark, d), minimum=X.MINIMUM)


@query("qualified_pitches", f"""WITH {O.PLAYS}, {O.QUALIFIED}
SELECT p.season, p.batter, pitch_id, play_result FROM plays p
WHERE EXISTS (SELECT 1 FROM qualified q WHERE q.season = p.season AND q.batter IS NOT DISTINCT FROM p.batter)""")
def _(spark, d):
    return batting.qualified_pitches(X.plays(spark, d), minimum=X.MINIMUM).select(
        "season", "batter", "pitch_id", "play_result"
    )


@query("batting_line", O.final(O.LINES, "lines", f"season batter {O.LINE_PLAIN}", O.LINE_RATES))
def _(spark, d):
    totals = batting.batter_totals(X.plays(spark, d), expected=False)
    return batting.batting_line(totals, minimum=X.MINIMUM, expected=False)


@query("expected_line", O.final(O.LINES, "lines", "season batter total_pa", O.LINE_EXPECTED))
def _(spark, d):
    return _lines(spark, d).select("season", "batter", "total_pa", *batting.EXPECTED_COLUMNS)


@query("league_totals", O.final(f"{O.SCORED}, {O.LEAGUE}", "league", f"season {O.LINE_PLAIN}", O.LINE_RATES))
def _(spark, d):
    return batting.league_line(batting.batter_totals(X.plays(spark, d), expected=False), expected=False)


@query("score_joinback", O.final(O.SCORED, "scored", "season pitch_id", "x1b x2b x3b xhr xba xslg"))
def _(spark, d):
    return _scored(spark, d).select("season", "pitch_id", "x1b", "x2b", "x3b", "xhr", "xba", "xslg")


@query("expected_per_ball", O.final(O.SCORED, f"scored WHERE {O.BATTED}", "pitch_id", "xba xslg"))
def _(spark, d):
    return _scored(spark, d).where(clean.is_batted_ball()).select("pitch_id", "xba", "xslg")


# --- run values ---------------------------------------------------------------------


@query("running_runs", f"WITH {O.PLAYS}, {O.RUNS} SELECT pitch_id, r AS runs, cumulative_runs FROM runs")
def _(spark, d):
    return runvalue.running_runs(X.plays(spark, d), **_half_innings()).select(
        "pitch_id", F.col("runs").cast("int").alias("runs"), "cumulative_runs"
    )


@query("runs_to_end", f"WITH {O.PLAYS}, {O.RUNS} SELECT pitch_id, runs_to_end FROM runs")
def _(spark, d):
    return runvalue.running_runs(X.plays(spark, d), **_half_innings()).select("pitch_id", "runs_to_end")


@query("run_expectancy", O.final(f"{O.PLAYS}, {O.STATES}", "re", "season outs", "avg_runs_to_end"))
def _(spark, d):
    return runvalue.run_expectancy(_cells(spark, d))


for _method in ("m1", "m3"):
    @query(f"run_values_{_method}", O.final(f"{O.PLAYS}, {O.RUN_VALUES}", "run_values", "season play_result plays", _method))
    def _(spark, d, method=_method):
        return runvalue.run_values(_cells(spark, d)).select("season", "play_result", "plays", method)


def _stand(spark, d) -> str:
    """Statistics of all plays from four deliveries; the second brings right what the first had wrong, the last is a repeat."""
    base, plays = new_path(spark, "standing"), X.plays(spark, d)
    third = F.col("game_no") % 3
    wrong = plays.where((third == 1) & (F.col("pitch_id") % 2 == 0)).withColumn("runs_scored", F.lit(3))
    second = plays.where(third == 1)
    for name, part in (("1", plays.where(third == 0).unionByName(wrong)), ("2", second), ("3", plays.where(third == 2)),
                       ("2", second)):
        standing.apply_delivery(part, base, name, game=("game_date", "game_no"), **_half_innings())
    return base


@query("standing_run_values", O.final(f"{O.PLAYS}, {O.RUN_VALUES}", "run_values", "season play_result plays", "m1 m3"))
def _(spark, d):
    values = runvalue.run_values(standing.standing(spark, _stand(spark, d), standing.CELLS))
    return values.select("season", "play_result", "plays", "m1", "m3")


@query("standing_batting_line", O.final(O.LINES, "lines", f"season batter {O.LINE_PLAIN}", O.LINE_RATES))
def _(spark, d):
    totals = standing.standing(spark, _stand(spark, d), standing.TOTALS)
    return batting.batting_line(totals, minimum=X.MINIMUM, expected=False)


@query("run_values_m2", O.final(f"{O.PLAYS}, {O.RUN_VALUES}", "run_values", "season play_result", "m2"))
def _(spark, d):
    return runvalue.run_values_by_state(_cells(spark, d))


_WEIGHT_COLUMNS = "league_obp m2_centred m2_unscaled_woba m2_weight m3_centred m3_unscaled_woba m3_weight"


@query("woba_weights", O.final(f"{O.PLAYS}, {O.WEIGHTS}", "weights", "season play_result", _WEIGHT_COLUMNS))
def _(spark, d):
    return _weights(spark, d).select("season", "play_result", *_WEIGHT_COLUMNS.split())


@query("woba_weights_reference_season",
       O.final(f"{O.PLAYS}, {O.REFERENCE_WEIGHTS}", "weights", "season play_result", _WEIGHT_COLUMNS))
def _(spark, d):
    values = runvalue.run_values(_cells(spark, d))
    weights = runvalue.linear_weights(values, reference_season=X.SEASONS[0])
    return weights.select("season", "play_result", *_WEIGHT_COLUMNS.split())


@query("sanity_checks", f"""WITH {O.PLAYS}, {O.RUN_VALUES}, v AS (
  SELECT season, max(m3) FILTER (WHERE play_result = 'HomeRun') AS hr, max(m3) FILTER (WHERE play_result = 'Triple') AS tr,
    max(m3) FILTER (WHERE play_result = 'Double') AS db, max(m3) FILTER (WHERE play_result = 'Single') AS sg,
    max(m3) FILTER (WHERE play_result = 'Walk') AS wk, max(m3) FILTER (WHERE play_result = 'Out') AS ot,
    max(m3) FILTER (WHERE play_result = 'StrikeoutLooking') AS kl,
    max(m3) FILTER (WHERE play_result = 'StrikeoutSwinging') AS ks FROM run_values GROUP BY season)
SELECT season, 'home_run_above_triple' AS "check", hr > tr AS passed FROM v
UNION ALL SELECT season, 'triple_above_double', tr > db FROM v
UNION ALL SELECT season, 'double_above_single', db > sg FROM v
UNION ALL SELECT season, 'single_above_walk', sg > wk FROM v
UNION ALL SELECT season, 'strikeouts_alike', abs(kl - ks) < 0.05 FROM v
UNION ALL SELECT season, 'strikeout_near_out', abs((kl + ks) / 2 - ot) < 0.05 FROM v""")
def _(spark, d):
    return runvalue.sanity_checks(runvalue.run_values(_cells(spark, d)))


# --- players and indexes ------------------------------------------------------------


@query("woba_players", O.final(O.PLAYERS, "players", "season batter total_pa", "woba xwoba"))
def _(spark, d):
    return _statistics(spark, d).players.select("season", "batter", "total_pa", "woba", "xwoba")


@query("leaderboard", O.final(O.PLAYERS, "players", "season batter", "xwoba x_home_runs") + " ORDER BY 3 DESC, 1, 2")
def _(spark, d):
    players = _statistics(spark, d).players
    return batting.leaderboard(players.select("season", "batter", "xwoba", "x_home_runs"), "xwoba", "season", "batter")


@query("league_avg_m1", O.final(O.LEAGUE_M1, "league_m1", "season", " ".join(O.STATS)))
def _(spark, d):
    return _statistics(spark, d).league_m1


@query("league_avg_m2", O.final(O.LEAGUES, "league_m2", f"season {O.LINE_PLAIN}", " ".join(O.STATS)))
def _(spark, d):
    return _statistics(spark, d).league_m2.select("season", *O.LINE_PLAIN.split(), *O.STATS)


@query("plus_stats_m1", O.final(f"{O.LEAGUE_M1}, {O.plus('league_m1')}", "plus", "season batter", O.PLUS_COLUMNS, 6), 6)
def _(spark, d):
    return _statistics(spark, d).plus_m1.select("season", "batter", *O.PLUS_COLUMNS.split())


@query("plus_stats_m1_baseline_season",
       O.final(f"{O.LEAGUE_M1}, {O.plus('league_m1', f'l.season = {X.SEASONS[0]}')}", "plus", "season batter", O.PLUS_COLUMNS, 6), 6)
def _(spark, d):
    plus = _statistics(spark, d, baseline_season=X.SEASONS[0]).plus_m1
    return plus.select("season", "batter", *O.PLUS_COLUMNS.split())


@query("plus_stats_m2", O.final(f"{O.LEAGUES}, {O.plus('league_m2')}", "plus", "season batter", O.PLUS_COLUMNS, 6), 6)
def _(spark, d):
    return _statistics(spark, d).plus_m2.select("season", "batter", *O.PLUS_COLUMNS.split())


@query("season_run", O.final(f"{O.LEAGUES}, {O.plus('league_m2')}", "plus", "season batter", O.PLUS_COLUMNS, 6), 6)
def _(spark, d):
    """The doubled delivery through the season table to the result files, read back by name."""
    plays, table, out = X.plays(spark, d), new_path(spark, "delivered"), new_path(spark, "results")
    tables.write_season_table(plays.unionAll(plays), table)
    stats = season.run_seasons(
        tables.read_season_table(spark, table), out, models=X.OUTCOME_MODEL, minimum=X.MINIMUM, **_half_innings())
    back = tables.read_csv(spark, f"{out}/plus_m2", stats.plus_m2.schema)
    return back.select("season", "batter", *O.PLUS_COLUMNS.split())


@query("simple_index", O.final(f"""{O.PLAYERS}, indexed AS (
  SELECT season, batter, xwoba / (SELECT avg(xwoba) FROM players) AS xwoba_plus FROM players)""",
    "indexed", "season batter", "xwoba_plus"))
def _(spark, d):
    return indexing.simple_index(_statistics(spark, d).players, "xwoba").select("season", "batter", "xwoba_plus")


# --- contact quality ----------------------------------------------------------------

_QUALITY_ONLY = """quality AS (
  SELECT p.season, p.batter, count(*) FILTER (WHERE exit_speed >= 95) AS total_hard_hits,
    count(*) AS total_batted_balls, avg(exit_speed) AS avg_exit_speed, avg(angle) AS avg_angle,
    CAST(count(*) FILTER (WHERE exit_speed >= 95) AS DOUBLE) / count(*) AS hard_hit_percentage
  FROM plays p JOIN qualified q ON q.season = p.season AND q.batter = p.batter
  WHERE exit_speed IS NOT NULL GROUP BY p.season, p.batter)"""
_QUALITY = f"{O.PLAYS}, {O.QUALIFIED}, {_QUALITY_ONLY}"


@query("hit_quality", O.final(_QUALITY, "quality", "season batter total_hard_hits total_batted_balls",
                              "avg_exit_speed avg_angle hard_hit_percentage", 8), 8)
def _(spark, d):
    return quality.hit_quality(X.plays(spark, d), minimum=X.MINIMUM)


@query("top_half_mean", O.final(f"""{_QUALITY}, medians AS (
  SELECT season, batter, quantile_cont(exit_speed, 0.5) AS cut FROM plays
  WHERE exit_speed IS NOT NULL GROUP BY season, batter),
fast AS (
  SELECT p.season, p.batter, avg(exit_speed) AS avg_exit_speed_top
  FROM plays p JOIN medians m ON m.season = p.season AND m.batter = p.batter WHERE exit_speed >= cut
  GROUP BY p.season, p.batter),
joined AS (SELECT q.season, q.batter, avg_exit_speed_top, avg_angle FROM quality q JOIN fast USING (season, batter))""",
    "joined", "season batter", "avg_exit_speed_top avg_angle", 8), 8)
def _(spark, d):
    return quality.top_half_quality(X.plays(spark, d), minimum=X.MINIMUM)


@query("profile_enrich", O.final(f"""{O.PLAYERS}, {_QUALITY_ONLY},
enriched AS (SELECT p.season, p.batter, p.woba, q.hard_hit_percentage, q.avg_exit_speed, q.avg_angle
  FROM players p LEFT JOIN quality q USING (season, batter))""",
    "enriched", "season batter", "woba hard_hit_percentage avg_exit_speed avg_angle", 8), 8)
def _(spark, d):
    players = _statistics(spark, d).players
    return season.with_contact_quality(players, X.plays(spark, d), X.MINIMUM).select(
        "season", "batter", "woba", "hard_hit_percentage", "avg_exit_speed", "avg_angle"
    )


_TREND = [("exit_speed", 50, 115), ("angle", -40, 60)]


@query("binned_trend", O.final(f"""{O.SCORED}, trend AS (
  """ + "\n  UNION ALL ".join(
    f"""SELECT season, '{x}' AS x, '{y}' AS y, CASE WHEN {x} < {lo} THEN 0 WHEN {x} >= {hi} THEN 21
      ELSE CAST(floor(20 * (({x} - {lo}) / {float(hi - lo)})) AS BIGINT) + 1 END AS bin, count(*) AS n,
      avg({x}) AS mean_x, avg({y}) AS mean_y, stddev_samp({y}) AS sd_y
    FROM scored WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2, 3, 4"""
    for x, lo, hi in _TREND for y in ("xba", "xslg")) + ")",
    "trend", "season x y bin n", "mean_x mean_y sd_y", 8), 8)
def _(spark, d):
    xs = {x: (lo, hi) for x, lo, hi in _TREND}
    return quality.binned_trend(_scored(spark, d), xs, ("xba", "xslg"), bins=20, by=["season"])


#: bins, positions and share of points of the smooth curves
_SMOOTH = {"bins": 240, "points": 40, "span": 0.75}

_SMOOTH_SQL = f"""{O.SCORED}, points AS (
  """ + "\n  UNION ALL ".join(
    f"""SELECT season, '{x}' AS x, '{y}' AS y, {lo} + (b - 0.5) * w AS centre, b AS bin, (v - ({lo})) / w - (b - 0.5) AS u, r, w
    FROM (SELECT season, {x} AS v, {y} AS r, CAST({hi - lo} AS DOUBLE) / {_SMOOTH["bins"]} AS w,
      CASE WHEN {x} < {lo} THEN 0 WHEN {x} >= {hi} THEN {_SMOOTH["bins"] + 1}
        ELSE CAST(floor({_SMOOTH["bins"]} * (({x} - ({lo})) / {float(hi - lo)})) AS BIGINT) + 1 END AS b FROM scored
      WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""
    for x, lo, hi in _TREND for y in ("xba", "xslg")) + f"""),
bins AS (
  SELECT season, x, y, bin, any_value(centre) AS c, any_value(w) AS w, count(*) AS n, sum(u) AS x1, sum(u * u) AS x2,
    sum(u * u * u) AS x3, sum(u * u * u * u) AS x4, sum(r) AS y0, sum(r * u) AS y1, sum(r * u * u) AS y2, sum(r * r) AS yy
  FROM points GROUP BY season, x, y, bin),
placed AS (SELECT *, c + w * x1 / n AS mean FROM bins),
ends AS (
  SELECT season, x, y, min(mean) AS first, max(mean) AS last, floor(sum(n) * {_SMOOTH["span"]} + 1e-5) AS wanted
  FROM placed GROUP BY season, x, y),
grid AS (
  SELECT season, x, y, wanted, k, first + k * ((last - first) / {_SMOOTH["points"] - 1}) AS x_at
  FROM ends, range(0, {_SMOOTH["points"]}) g(k)),
far AS (
  SELECT p.*, g.k, g.x_at, g.wanted, abs(mean - g.x_at) AS distance,
    sum(n) OVER (PARTITION BY season, x, y, g.k ORDER BY abs(mean - g.x_at), bin ROWS UNBOUNDED PRECEDING) AS held
  FROM placed p JOIN grid g USING (season, x, y)),
reach AS (
  SELECT season, x, y, k, min(distance) FILTER (WHERE held >= wanted) AS h FROM far GROUP BY season, x, y, k),
weighted AS (
  SELECT f.*, h, (c - x_at) / h AS a, w / h AS s,
    CASE WHEN distance < h THEN pow(1 - pow(distance / h, 3), 3) ELSE 0 END AS q FROM far f JOIN reach USING (season, x, y, k)),
moved AS (
  SELECT season, x, y, k, any_value(x_at) AS x_at, any_value(h) AS bandwidth, CAST(sum(n) FILTER (WHERE q > 0) AS BIGINT) AS n,
    sum(q * n) AS m0, sum(q * (a * n + s * x1)) AS m1, sum(q * (a * a * n + 2 * a * s * x1 + s * s * x2)) AS m2,
    sum(q * (a ** 3 * n + 3 * a * a * s * x1 + 3 * a * s * s * x2 + s ** 3 * x3)) AS m3,
    sum(q * (a ** 4 * n + 4 * a ** 3 * s * x1 + 6 * a * a * s * s * x2 + 4 * a * s ** 3 * x3 + s ** 4 * x4)) AS m4,
    sum(q * y0) AS t0, sum(q * (a * y0 + s * y1)) AS t1, sum(q * (a * a * y0 + 2 * a * s * y1 + s * s * y2)) AS t2,
    sum(q * yy) AS tt
  FROM weighted GROUP BY season, x, y, k),
solved AS (
  SELECT *, m0 * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3) + m2 * (m1 * m3 - m2 * m2) AS det,
    t0 * (m2 * m4 - m3 * m3) - m1 * (t1 * m4 - t2 * m3) + m2 * (t1 * m3 - t2 * m2) AS d0,
    m0 * (t1 * m4 - t2 * m3) - t0 * (m1 * m4 - m2 * m3) + m2 * (m1 * t2 - m2 * t1) AS d1,
    m0 * (m2 * t2 - m3 * t1) - m1 * (m1 * t2 - m2 * t1) + t0 * (m1 * m3 - m2 * m2) AS d2
  FROM moved),
curve AS (
  SELECT season, x, y, k, x_at, bandwidth, n, d0 / det AS fit,
    sqrt(greatest(tt - (d0 * t0 + d1 * t1 + d2 * t2) / det, 0) / m0) AS spread FROM solved)"""


@query("smooth_trend", O.final(_SMOOTH_SQL, "curve", "season x y n", "x_at bandwidth fit spread", 6), 6)
def _(spark, d):
    xs = {x: (lo, hi) for x, lo, hi in _TREND}
    moments = smooth.bin_moments(_scored(spark, d), xs, ("xba", "xslg"), bins=_SMOOTH["bins"], by=["season"])
    return smooth.smooth_trend(moments, points=_SMOOTH["points"], span=_SMOOTH["span"], by=["season"])


@query("binned_scatter", f"""WITH {O.SCORED}
SELECT season, CASE WHEN exit_speed < 50 THEN 0 WHEN exit_speed >= 115 THEN 21
    ELSE CAST(floor(20 * ((exit_speed - 50) / 65.0)) AS BIGINT) + 1 END AS x_bin,
  CASE WHEN xba < 0 THEN 0 WHEN xba >= 1 THEN 21 ELSE CAST(floor(20 * xba) AS BIGINT) + 1 END AS y_bin, count(*) AS n
FROM scored WHERE exit_speed IS NOT NULL AND xba IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, d):
    return quality.binned_scatter(
        _scored(spark, d), "exit_speed", "xba", x_range=(50, 115), y_range=(0, 1), bins=20, by=["season"]
    )


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount")


@query("measure_quantiles", O.final(
    "q AS (" + " UNION ALL ".join(f"""SELECT l_returnflag, '{c}' AS measure, quantile_cont({c}, 0.05) AS low,
      quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.95) AS high FROM lineitem GROUP BY l_returnflag"""
                              for c in _MEASURES) + ")", "q", "l_returnflag measure", "low median high", 6), 6)
def _(spark, d):
    return radix.quantiles(X.table(spark, d, "lineitem"), _MEASURES, by=["l_returnflag"], probs=[0.05, 0.5, 0.95],
                           names=["low", "median", "high"])


@query("price_box", O.final(f"""h AS (
  SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
    quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_returnflag),
boxes AS (
  SELECT l.l_returnflag, count(*) AS n, h.q1, h.median, h.q3,
    min(l_extendedprice) FILTER (WHERE l_extendedprice >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
    max(l_extendedprice) FILTER (WHERE l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM lineitem l JOIN h USING (l_returnflag) GROUP BY l.l_returnflag, h.q1, h.median, h.q3)""",
    "boxes", "l_returnflag n outliers", "whisker_low q1 median q3 whisker_high", 6), 6)
def _(spark, d):
    return radix.box_summary(X.table(spark, d, "lineitem"), "l_extendedprice", by=["l_returnflag"])


@query("box_summary", O.final("""h AS (
  SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
    quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY o_orderpriority),
boxes AS (
  SELECT o.o_orderpriority, count(*) AS n, h.q1, h.median, h.q3,
    min(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
    max(o_totalprice) FILTER (WHERE o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM orders o JOIN h USING (o_orderpriority) GROUP BY o.o_orderpriority, h.q1, h.median, h.q3)""",
    "boxes", "o_orderpriority n outliers", "whisker_low q1 median q3 whisker_high", 6), 6)
def _(spark, d):
    return ordered.box_summary(X.table(spark, d, "orders"), "o_totalprice", by=["o_orderpriority"], bin_width=500.0)


# --- levels -------------------------------------------------------------------------


@query("level_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return clean.value_frequencies(X.table(spark, d, "orders"), "o_orderpriority")


_LEVEL_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.PRIORITY_LEVELS.items()) + " END"


def _order_level() -> F.Column:
    return clean.recode(F.col("o_orderpriority"), {v: (k,) for k, v in X.PRIORITY_LEVELS.items()})


@query("level_label", f"""SELECT o_orderkey, CASE WHEN {_LEVEL_CASE} IN ({O.text_list(S.TARGET_LEVELS[:-1])})
  THEN {_LEVEL_CASE} ELSE 'Other' END AS target_level FROM orders""")
def _(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", levels.target_level(_order_level()).alias("target_level"))


@query("consolidate_levels", f"""SELECT o_orderkey,
  CASE WHEN {_LEVEL_CASE} IN ({O.text_list(S.AFFILIATED)}) THEN 'Affiliated' ELSE {_LEVEL_CASE} END AS level_fine,
  CASE WHEN {_LEVEL_CASE} IN ({O.text_list(S.AFFILIATED)}) THEN 'Affiliated'
       WHEN {_LEVEL_CASE} IN ({O.text_list(S.INDEPENDENT)}) THEN 'Independent' ELSE {_LEVEL_CASE} END AS level_coarse
FROM orders""")
def _(spark, d):
    return X.table(spark, d, "orders").select(
        "o_orderkey", levels.consolidate_affiliated(_order_level()).alias("level_fine"),
        levels.consolidate_levels(_order_level()).alias("level_coarse"),
    )


def _appearances(spark, d) -> DataFrame:
    return X.table(spark, d, "orders").select(
        F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season"),
        F.col("o_orderpriority").alias("level"), F.lit(1).alias("pa"),
    )


def _season_levels(spark, d) -> DataFrame:
    appearances = _appearances(spark, d)
    roster = X.table(spark, d, "customer").select(F.col("c_custkey").alias("player"))
    return levels.season_level(
        appearances, roster, player="player", seasons=levels.seasons_of(appearances),
        ranks=X.PRIORITY_RANKS, minimum=2
    )


_RANK_CASE = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.PRIORITY_RANKS.items()) + " END"


@query("season_level", f"""WITH played AS (
  SELECT o_custkey AS player, year(o_orderdate) AS season, o_orderpriority AS level, count(*) AS pa
  FROM orders GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY player, season
    ORDER BY CASE WHEN pa >= 2 THEN 0 ELSE 1 END, CASE WHEN pa >= 2 THEN {_RANK_CASE} ELSE -pa END, {_RANK_CASE}) AS pick
  FROM played),
grid AS (SELECT c_custkey AS player, s.season FROM customer, (SELECT DISTINCT season FROM played) s)
SELECT g.player, CAST(g.season AS INT) AS season, coalesce(r.level, 'DNP') AS level
FROM grid g LEFT JOIN ranked r ON r.player = g.player AND r.season = g.season AND r.pick = 1""")
def _(spark, d):
    return _season_levels(spark, d)


# --- splits and folds ---------------------------------------------------------------


@query("kfold_assign", """SELECT o_orderkey, CAST((row_number() OVER (
  ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':425'), o_orderkey) - 1) % 5 + 1 AS INT) AS fold FROM orders""")
def _(spark, d):
    return model.kfold(X.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], seed=425)


@query("stratified_split", """SELECT o_orderkey, o_orderpriority, row_number() OVER (
  PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':425'), o_orderkey)
  <= ceil(0.8 * count(*) OVER (PARTITION BY o_orderpriority)) AS is_train FROM orders""")
def _(spark, d):
    return model.stratified_split(
        X.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], "o_orderpriority"
    )


# --- scoring with pinned coefficients -----------------------------------------------


def _binary(spark, d) -> DataFrame:
    balls = clean.batted_balls(X.plays(spark, d))
    return balls.withColumns({
        f"p_{y[3:]}": binary_probability(b[0], b[1:], ("exit_speed", "angle")) for y, b in X.BINARY_WEIGHTS.items()
    })


_P_BINARY = [f"p_{y[3:]}" for y in X.BINARY_WEIGHTS]
_BINARY = f"""{O.BALLS}, binary_scores AS (SELECT *, {", ".join(
    f"1 / (1 + exp(-({O.linear(b[0], b[1:], ('exit_speed', 'angle'))}))) AS p_{y[3:]}" for y, b in X.BINARY_WEIGHTS.items())}
  FROM balls)"""


@query("binary_score", O.final(_BINARY, "binary_scores", "pitch_id", " ".join(_P_BINARY)))
def _(spark, d):
    return _binary(spark, d).select("pitch_id", *_P_BINARY)


@query("binary_logloss", f"WITH {_BINARY}\n" + "\nUNION ALL ".join(
    f"""SELECT season, '{y}' AS outcome, round(avg(CASE WHEN {y} = 1 THEN -ln(p_{y[3:]}) ELSE -ln(1 - p_{y[3:]}) END), {O.DIGITS}) AS log_loss
FROM binary_scores GROUP BY season""" for y in X.BINARY_WEIGHTS))
def _(spark, d):
    losses = _binary(spark, d).groupBy("season").agg(*[
        F.avg(evaluate.binary_loss(F.col(y), F.col(f"p_{y[3:]}"))).alias(y) for y in X.BINARY_WEIGHTS
    ])
    rows = F.array(*[F.struct(F.lit(y).alias("outcome"), F.col(y).alias("log_loss")) for y in X.BINARY_WEIGHTS])
    return losses.select("season", F.inline(rows))


def _flags(spark, d) -> DataFrame:
    return add_class_probabilities(X.table(spark, d, "lineitem"), X.FLAG_MODEL, X.FLAG_NAMES)


_FLAGS = f"flags AS ({O.softmax('lineitem', X.FLAG_MODEL, X.FLAG_NAMES)})"
_CALLED = f"""{_FLAGS}, called AS (SELECT *, CASE WHEN p_a >= p_n AND p_a >= p_r THEN 'A'
  WHEN p_n >= p_r THEN 'N' ELSE 'R' END AS predicted FROM flags)"""


@query("multinomial_score", O.final(_FLAGS, "flags", "l_orderkey l_linenumber", "l_quantity p_a p_n p_r"))
def _(spark, d):
    return _flags(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "p_a", "p_n", "p_r")


def _called(spark, d) -> DataFrame:
    return X.table(spark, d, "lineitem").withColumn("predicted", X.FLAG_MODEL.predicted())


@query("predict_class", O.final(_CALLED, "called", "l_orderkey l_linenumber l_quantity predicted"))
def _(spark, d):
    return _called(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "predicted")


_ACTUAL = "CASE l_returnflag WHEN 'A' THEN p_a WHEN 'N' THEN p_n WHEN 'R' THEN p_r END"


@query("multiclass_logloss", f"""WITH {_FLAGS}
SELECT l_linestatus, round(-avg(ln({_ACTUAL} + 1e-15)), {O.DIGITS}) AS log_loss FROM flags GROUP BY l_linestatus""")
def _(spark, d):
    return evaluate.multiclass_logloss(_flags(spark, d), "l_returnflag", X.FLAG_NAMES, by=["l_linestatus"])


@query("model_deviance", f"""WITH {_FLAGS}, dev AS (SELECT -2 * sum(ln({_ACTUAL})) AS deviance FROM flags)
SELECT round(deviance, 3) AS deviance, 8 AS edf, round(deviance + 16, 3) AS aic FROM dev""")
def _(spark, d):
    found = evaluate.model_deviance(_flags(spark, d), "l_returnflag", X.FLAG_NAMES, len(X.FLAG_FEATURES))
    return found.select(F.round("deviance", 3).alias("deviance"), "edf", F.round("aic", 3).alias("aic"))


def _confusion(spark, d) -> DataFrame:
    return evaluate.confusion_counts(_called(spark, d), "l_returnflag", "predicted", X.FLAG_LABELS)


_GRID = ", ".join(f"('{r}', '{p}')" for r in X.FLAG_LABELS for p in X.FLAG_LABELS)
_CONFUSION = f"""{_CALLED}, confusion AS (
  SELECT g.reference, g.prediction, count(c.l_returnflag) AS n, (SELECT count(*) FROM called
    WHERE (l_returnflag IN ('A', 'N', 'R') AND predicted IN ('A', 'N', 'R')) IS NOT TRUE) AS dropped
  FROM (VALUES {_GRID}) g(reference, prediction)
  LEFT JOIN called c ON c.l_returnflag = g.reference AND c.predicted = g.prediction GROUP BY 1, 2)"""


@query("confusion_counts", O.final(_CONFUSION, "confusion", "reference prediction n dropped"))
def _(spark, d):
    return _confusion(spark, d)


@query("confusion_metrics", O.final(f"""{_CONFUSION}, sums AS (
  SELECT l.label, CAST(sum(n) FILTER (WHERE reference = label AND prediction = label) AS DOUBLE) AS tp,
    CAST(sum(n) FILTER (WHERE reference = label) AS DOUBLE) AS pos,
    CAST(sum(n) FILTER (WHERE prediction = label) AS DOUBLE) AS called, CAST(sum(n) AS DOUBLE) AS total,
    CAST(sum(n) FILTER (WHERE reference <> label AND prediction <> label) AS DOUBLE) AS tn
  FROM confusion, (VALUES ('A'), ('N'), ('R')) l(label) GROUP BY l.label),
metrics AS (
  SELECT label, tp / nullif(pos, 0) AS sensitivity, tn / nullif(total - pos, 0) AS specificity,
    tp / nullif(called, 0) AS positive_predictive_value, tn / nullif(total - called, 0) AS negative_predictive_value,
    pos / total AS prevalence, tp / total AS detection_rate, called / total AS detection_prevalence,
    (tp / nullif(pos, 0) + tn / nullif(total - pos, 0)) / 2 AS balanced_accuracy FROM sums)""", "metrics", "label",
    "sensitivity specificity positive_predictive_value negative_predictive_value prevalence detection_rate "
    "detection_prevalence balanced_accuracy"))
def _(spark, d):
    return evaluate.class_metrics(_confusion(spark, d))


_OVERALL = f"""{_CONFUSION}, refs AS (
  SELECT reference AS label, CAST(sum(n) AS DOUBLE) AS ref FROM confusion GROUP BY 1),
preds AS (SELECT prediction AS label, CAST(sum(n) AS DOUBLE) AS pred FROM confusion GROUP BY 1),
agreement AS (
  SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (WHERE reference = prediction) AS BIGINT) AS correct,
    max(dropped) AS dropped FROM confusion),
overall AS (
  SELECT n, correct, dropped, (SELECT max(ref) FROM refs) / n AS no_information_rate, CAST(correct AS DOUBLE) / n AS accuracy,
    (CAST(correct AS DOUBLE) / n - e) / (1 - e) AS kappa
  FROM agreement, (SELECT sum(ref * pred) / (SELECT CAST(n AS DOUBLE) * n FROM agreement) AS e FROM refs JOIN preds USING (label)))"""


@query("confusion_overall", O.final(_OVERALL, "overall", "n correct dropped", "no_information_rate accuracy kappa"))
def _(spark, d):
    return evaluate.overall_metrics(_confusion(spark, d))


@query("accuracy_p_value", f"""WITH {_OVERALL}, hits AS (
  SELECT n, no_information_rate AS r, unnest(range(correct, n + 1)) AS i FROM overall)
SELECT round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(r) + (n - i) * ln(1 - r))), 6) AS p_value
FROM hits""", 6)
def _(spark, d):
    return evaluate.accuracy_inference(evaluate.overall_metrics(_confusion(spark, d))).select("p_value")


# The bounds are the probabilities at which the tails of the binomial distribution hold 2.5 %; halving finds them.
_TAILS = f"""WITH RECURSIVE {_OVERALL}, terms AS MATERIALIZED (
  SELECT side, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) AS c, n
  FROM (SELECT n, 'lower' AS side, unnest(range(correct, n + 1)) AS i FROM overall
        UNION ALL SELECT n, 'upper', unnest(range(0, correct + 1)) FROM overall)),
search AS (
  SELECT 0 AS step, 'lower' AS side, CAST(0 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b
  UNION ALL SELECT 0, 'upper', CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL SELECT step + 1, s.side,
    CASE WHEN (t.tail < 0.025) = (s.side = 'lower') THEN (a + b) / 2 ELSE a END,
    CASE WHEN (t.tail < 0.025) = (s.side = 'lower') THEN b ELSE (a + b) / 2 END
  FROM search s JOIN LATERAL (
    SELECT sum(exp(c + i * ln((s.a + s.b) / 2) + (n - i) * ln(1 - (s.a + s.b) / 2))) AS tail
    FROM terms WHERE terms.side = s.side) t ON TRUE
  WHERE step < 40),
bounds AS (SELECT max((a + b) / 2) FILTER (WHERE side = 'lower') AS accuracy_lower,
  max((a + b) / 2) FILTER (WHERE side = 'upper') AS accuracy_upper FROM search WHERE step = 40),
tail AS (SELECT sum(exp(c + i * ln(no_information_rate) + (terms.n - i) * ln(1 - no_information_rate))) AS p_value
  FROM terms, overall WHERE side = 'lower')
SELECT n, correct, dropped, {", ".join(f"round({c}, 6) AS {c}" for c in (
    "no_information_rate", "accuracy", "kappa", "accuracy_lower", "accuracy_upper", "p_value"))}
FROM overall, bounds, tail"""


@query("confusion_inference", _TAILS, 6)
def _(spark, d):
    return evaluate.accuracy_inference(evaluate.overall_metrics(_confusion(spark, d)))


@query("select_model", f"WITH {_BINARY}, losses AS (" + "\nUNION ALL ".join(
    f"""SELECT season, '{y}' AS model, avg(CASE WHEN {y} = 1 THEN -ln(p_{y[3:]}) ELSE -ln(1 - p_{y[3:]}) END) AS log_loss
FROM binary_scores GROUP BY season""" for y in X.BINARY_WEIGHTS) + """)
SELECT l.season, l.model, round(l.log_loss, 9) AS log_loss FROM losses l
WHERE l.log_loss = (SELECT min(log_loss) FROM losses o WHERE o.season = l.season)""")
def _(spark, d):
    losses = _binary(spark, d).groupBy("season").agg(*[
        F.avg(evaluate.binary_loss(F.col(y), F.col(f"p_{y[3:]}"))).alias(y) for y in X.BINARY_WEIGHTS
    ])
    rows = F.array(*[F.struct(F.lit(y).alias("model"), F.col(y).alias("log_loss")) for y in X.BINARY_WEIGHTS])
    return evaluate.select_model(losses.select("season", F.inline(rows)), "model", "log_loss", by=["season"])


_LATEST = f"{O.LINES}, latest AS (SELECT * FROM lines WHERE season = {X.SEASONS[1]})"
_BOARD_NAMES = {"Affiliated": "affiliated", "DNP": "dnp", "Independent": "independent"}

for _label in ("Affiliated", "DNP"):
    @query(f"top5_{_label.lower()}", O.final(
        f"{_LATEST}, boards AS ({O.softmax('latest', X.BOARD_MODEL, _BOARD_NAMES)}), best AS ("
        f"SELECT batter, {_label.lower()} FROM boards ORDER BY {_label.lower()} DESC, batter LIMIT 5)",
        "best", "batter", _label.lower()))
    def _(spark, d, label=_label):
        latest = _lines(spark, d).where(F.col("season") == X.SEASONS[1])
        return projection.board(latest, X.BOARD_MODEL, label)


_P_LEVELS = [model.level_column(y, x) for y in X.HORIZON_MODELS for x in S.TARGET_LEVELS]


def _project_sql() -> str:
    source = "latest"
    for year, m in X.HORIZON_MODELS.items():
        source = f"({O.softmax(source, m, {x: model.level_column(year, x) for x in m.labels})})"
    return O.final(_LATEST, source, "batter", " ".join(_P_LEVELS))


@query("project_scores", _project_sql())
def _(spark, d):
    latest = _lines(spark, d).where(F.col("season") == X.SEASONS[1])
    return model.project_levels(latest, X.HORIZON_MODELS).select("batter", *_P_LEVELS)


# --- fitted models ----------------------------------------------


@query("cv_logloss")
def _(spark, d):
    balls = model.kfold(clean.batted_balls(X.plays(spark, d)), ["pitch_id"])
    return model.cross_validated_logloss(balls)


def _pinned_fits() -> list[tuple]:
    """Fits that do not depend on the data: another one for every fold, outcome and feature set."""
    return [
        (name, fold, y, b0 + 0.05 * fold, *(b1 + 0.001 * fold, b2, -0.002)[:len(features)])
        for name, features in model.FEATURE_SETS.items() for y, (b0, b1, b2) in X.BINARY_WEIGHTS.items() for fold in range(1, 6)
    ]


_FIT_ROWS = ", ".join(
    f"('{name}', {fold}, '{y}', {O.number(b0)}, {O.number(w[0])}, {O.number(w[1])}, {O.number(w[2] if len(w) > 2 else 0)})"
    for name, fold, y, b0, *w in _pinned_fits())


@query("cv_logloss_pinned", O.final(f"""{O.BALLS}, folded AS (
  SELECT *, CAST((row_number() OVER (ORDER BY md5(CAST(pitch_id AS VARCHAR) || ':42'), pitch_id) - 1) % 5 + 1 AS INT) AS fold
  FROM balls),
fits(model_set, fold, target, b0, b1, b2, b3) AS (VALUES {_FIT_ROWS}),
scored AS (
  SELECT model_set, target AS outcome, fold, CASE target WHEN 'is_single' THEN is_single WHEN 'is_double' THEN is_double
      WHEN 'is_triple' THEN is_triple ELSE is_home_run END AS hit,
    least(greatest(1 / (1 + exp(-(b0 + b1 * exit_speed + b2 * angle + b3 * direction))), 1e-15), 1 - 1e-15) AS p
  FROM folded JOIN fits USING (fold) WHERE direction IS NOT NULL),
per_fold AS (
  SELECT model_set, outcome, fold, avg(CASE WHEN hit = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS loss
  FROM scored GROUP BY model_set, outcome, fold),
means AS (SELECT model_set, outcome, avg(loss) AS log_loss FROM per_fold GROUP BY model_set, outcome)""",
    "means", "model_set outcome", "log_loss"))
def _(spark, d):
    """Cross-validated losses of given fits: everything of ``cv_logloss`` but the fits, which ``cv_fold_moments`` checks."""
    balls = model.kfold(clean.batted_balls(X.plays(spark, d)), ["pitch_id"])
    return model.score_folds(balls, _pinned_fits())


_SWEEP = {
    "all": X.FLAG_MODEL,
    "quantity": LinearModel(("l_quantity",), X.FLAG_LABELS, (0.0, 0.5, -0.5), ((0.0,), (0.01,), (-0.02,))),
    "rates": LinearModel(("l_discount", "l_tax"), X.FLAG_LABELS, (0.0, 0.1, 0.2), ((0.0, 0.0), (1.0, -1.0), (3.0, 2.0))),
}


@query("predictor_sweep_pinned", O.final(
    "losses AS (" + " UNION ALL ".join(
        f"""SELECT '{name}' AS predictor_set, avg(-ln(CASE l_returnflag WHEN 'A' THEN p_a WHEN 'N' THEN p_n ELSE p_r END)) AS log_loss
  FROM ({O.softmax("lineitem", m, X.FLAG_NAMES)})""" for name, m in _SWEEP.items()) + ")",
    "losses", "predictor_set", "log_loss"))
def _(spark, d):
    """Losses of given models: everything of ``predictor_sweep`` and ``multinomial_fit`` but the fits."""
    return model.sweep_losses(X.table(spark, d, "lineitem"), _SWEEP, "l_returnflag")


@query("multinomial_fit")
def _(spark, d):
    rows = X.table(spark, d, "lineitem")
    fitted, loss = model.train_multinomial(rows, X.FLAG_FEATURES, "l_returnflag", X.FLAG_LABELS)
    return fitted.coefficients(spark).withColumn("log_loss", F.lit(loss))


@query("coefficient_errors")
def _(spark, d):
    return evaluate.coefficient_errors(_flags(spark, d), X.FLAG_NAMES, X.FLAG_FEATURES)


# At the maximum of the likelihood, and only there, expected and observed class totals and
# feature totals agree. The fits below are checked on that.


@query("multinomial_fit_moments", """SELECT l_returnflag AS label, round(CAST(count(*) AS DOUBLE), 0) AS n, round(sum(l_quantity), 0) AS quantity,
  round(sum(l_tax), 2) AS tax FROM lineitem GROUP BY l_returnflag""")
def _(spark, d):
    rows = X.table(spark, d, "lineitem")
    fitted = model.fit_multinomial(rows, X.FLAG_FEATURES, "l_returnflag", X.FLAG_LABELS)
    scored = add_class_probabilities(rows, fitted, X.FLAG_NAMES)
    return _moments(scored, X.FLAG_NAMES, (), {"n": (F.lit(1.0), 0), "quantity": (F.col("l_quantity"), 0),
                                               "tax": (F.col("l_tax"), 2)})


def _moments(scored, names, by, terms) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(label).alias("label"), *[(F.col(p) * c).alias(t) for t, (c, _) in terms.items()])
        for label, p in names.items()
    ])
    return scored.select(*by, F.inline(rows)).groupBy(*by, "label").agg(*[
        F.round(F.sum(t), digits).alias(t) for t, (_, digits) in terms.items()
    ])


@query("outcome_models", f"""WITH {O.BALLS}
SELECT season, outcome AS label, round(CAST(count(*) AS DOUBLE), 0) AS n, round(sum(exit_speed), 2) AS exit_speed,
  round(sum(angle), 1) AS angle FROM balls WHERE outcome <> 'Not a Hit' GROUP BY season, outcome""")
def _(spark, d):
    """Expected hits of each season under its own fitted outcome model."""
    pitches = X.plays(spark, d)
    scored = season.score_pitches(pitches, season.fit_outcome_models(pitches, X.SEASONS))
    return _moments(scored.where(clean.is_batted_ball()), batting.HIT_PROBABILITIES, ("season",), {
        "n": (F.lit(1.0), 0), "exit_speed": (F.col("exit_speed"), 2), "angle": (F.col("angle"), 1)})


@query("binary_fit", f"""WITH {O.BALLS}, usable AS (SELECT * FROM balls WHERE direction IS NOT NULL)
""" + "\nUNION ALL ".join(
    f"""SELECT '{y}' AS label, round(sum({y}), 0) AS n, round(sum({y} * exit_speed), 2) AS exit_speed,
  round(sum({y} * direction), 1) AS direction FROM usable""" for y in model.OUTCOME_FLAGS))
def _(spark, d):
    features = model.FEATURE_SETS["WithDirection"]
    balls = clean.batted_balls(X.plays(spark, d))
    table = clean.hit_indicators(model.compress(balls, features, "play_result")).persist()
    fit = lambda y: (y, model.fit_binary(table, features, y))
    fits = dict(side_by_side(spark, fit, list(model.OUTCOME_FLAGS)))
    table.unpersist()
    scored = balls.dropna(subset=list(features)).withColumns({
        f"p_{y}": binary_probability(b, w, features) for y, (b, w) in fits.items()
    })
    return _moments(scored, {y: f"p_{y}" for y in fits}, (), {
        "n": (F.lit(1.0), 0), "exit_speed": (F.col("exit_speed"), 2), "direction": (F.col("direction"), 1)})


def _profiles(spark, d) -> DataFrame:
    """Player profiles with levels reached: batters are matched to customers by number."""
    pitches = X.plays(spark, d)
    stats = _statistics(spark, d)
    plus = season.with_contact_quality(stats.plus_m2, pitches, X.MINIMUM)
    top = quality.top_half_quality(pitches, minimum=X.MINIMUM).select("season", "batter", "avg_exit_speed_top")
    reached = _season_levels(spark, d).withColumn(
        "level", clean.recode(F.col("level"), {v: (k,) for k, v in X.PRIORITY_LEVELS.items()})
    )
    by_year = reached.groupBy(F.col("player").alias("batter")).agg(*[
        F.max(F.when(F.col("season") == s, F.col("level"))).alias(f"level_{s}")
        for s in levels.seasons_of(_appearances(spark, d))
    ])
    out = clean.attach(plus, top, ["season", "batter"])
    return clean.attach(clean.attach(out, _ages(pitches), ["batter"]), by_year, ["batter"])


FINE_LABELS = ("A+", "AA", "AAA", "DNP", "MLB", "Mex")
COARSE_LABELS = ("AAA", "Affiliated", "DNP", "Independent", "MLB")
#: predictor sets whose features are plain ratios, so that SQL can select the same training rows
MOMENT_SETS = {k: model.SEASON_SETS[k] for k in ("age", "traditional", "rates", "traditional_rates")}
#: the other sets: SQL selects their training rows by whether expected values and tracked balls exist
TRACKED_SETS = {k: v for k, v in model.SEASON_SETS.items() if k not in MOMENT_SETS}
#: players with every feature that is null where a fit leaves the row out; an index is null where its statistic is
_TRACKED = f"""{O.PLAYERS}, {_QUALITY_ONLY}, medians AS (
  SELECT season, batter, quantile_cont(exit_speed, 0.5) AS cut FROM plays
  WHERE exit_speed IS NOT NULL GROUP BY season, batter),
fast AS (
  SELECT p.season, p.batter, avg(exit_speed) AS avg_exit_speed_top
  FROM plays p JOIN medians m ON m.season = p.season AND m.batter = p.batter WHERE exit_speed >= cut
  GROUP BY p.season, p.batter),
tracked AS (
  SELECT p.*, p.xwoba AS xwoba_plus, f.avg_exit_speed_top, q.avg_angle, q.hard_hit_percentage
  FROM players p LEFT JOIN quality q USING (season, batter) LEFT JOIN fast f USING (season, batter))"""


def _season_models(spark, d, coarse: bool, sets=model.SEASON_SETS) -> projection.ModelReports:
    first = levels.seasons_of(_appearances(spark, d))[0]
    reached = F.col(f"level_{first}")
    profiles = _profiles(spark, d).where(F.col("season") == X.SEASONS[0])
    labelled = profiles.withColumn("level", levels.consolidate_levels(reached) if coarse else reached)
    return projection.report_models(
        labelled, ["batter"], "level", COARSE_LABELS if coarse else FINE_LABELS, predictor_sets=sets)


def _season_moments(spark, d, coarse: bool, sets=MOMENT_SETS) -> DataFrame:
    """Players expected in every class by each model over its own training rows."""
    found = _season_models(spark, d, coarse, sets)
    parts = []
    for name, m in found.models.items():
        names = {x: f"p_{i}" for i, x in enumerate(m.labels)}
        train = found.split.where("is_train").where(F.col("level").isin(*m.labels)).dropna(subset=list(m.features))
        scored = add_class_probabilities(train, m, names)
        parts.append(_moments(scored, names, (), {"n": (F.lit(1.0), 1)}).select(F.lit(name).alias("model"), "*"))
    return tables.union_sources(parts)


def _season_moments_sql(coarse: bool, sets=MOMENT_SETS, players: str = O.LINES, source: str = "lines") -> str:
    fine = "CASE r.level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.PRIORITY_LEVELS.items()) + " END"
    level = f"CASE WHEN c.c_custkey IS NULL THEN NULL ELSE coalesce({fine}, 'DNP') END"
    if coarse:
        groups = {S.AFFILIATED: "Affiliated", S.INDEPENDENT: "Independent"}
        for members, name in groups.items():
            listed = ", ".join(f"'{m}'" for m in members)
            level = f"CASE WHEN ({level}) IN ({listed}) THEN '{name}' ELSE ({level}) END"
    each = "\nUNION ALL ".join(
        f"""SELECT '{name}' AS model, level AS label, round(CAST(count(*) AS DOUBLE), 1) AS n FROM split
WHERE is_train AND level IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in columns)} GROUP BY level"""
        for name, columns in sets.items())
    return f"""WITH {players}, played AS (
  SELECT o_custkey AS player, o_orderpriority AS level, count(*) AS pa FROM orders
  WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders) GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY player
    ORDER BY CASE WHEN pa >= 2 THEN 0 ELSE 1 END, CASE WHEN pa >= 2 THEN {_RANK_CASE} ELSE -pa END, {_RANK_CASE}) AS pick
  FROM played),
base AS (
  SELECT l.*, CASE WHEN l.batter % 7 = 3 THEN NULL ELSE 22 + l.batter % 15 END AS age, {level} AS level
  FROM {source} l LEFT JOIN customer c ON c.c_custkey = l.batter
  LEFT JOIN ranked r ON r.player = l.batter AND r.pick = 1 WHERE l.season = {X.SEASONS[0]}),
split AS (
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY md5(CAST(batter AS VARCHAR) || ':425'), batter)
    <= ceil(0.8 * count(*) OVER (PARTITION BY level)) AS is_train FROM base)
{each}"""


@query("season_models_fine", _season_moments_sql(False))
def _(spark, d):
    return _season_moments(spark, d, coarse=False)


@query("season_models_coarse", _season_moments_sql(True))
def _(spark, d):
    return _season_moments(spark, d, coarse=True)


@query("season_models_fine_tracked", _season_moments_sql(False, TRACKED_SETS, _TRACKED, "tracked"))
def _(spark, d):
    return _season_moments(spark, d, coarse=False, sets=TRACKED_SETS)


@query("season_models_coarse_tracked", _season_moments_sql(True, TRACKED_SETS, _TRACKED, "tracked"))
def _(spark, d):
    return _season_moments(spark, d, coarse=True, sets=TRACKED_SETS)


@query("season_model_reports")
def _(spark, d):
    """Rates of every class and fit summary of every model on the fine labels."""
    found = _season_models(spark, d, coarse=False)
    return found.by_class.join(found.summary, "model")


def _horizons(spark, d) -> dict[int, str]:
    seasons = levels.seasons_of(_appearances(spark, d))[:X.HORIZONS]
    return {2025 + i: f"level_{s}" for i, s in enumerate(seasons)}


@query("predictor_sweep")
def _(spark, d):
    profiles = _profiles(spark, d).where(F.col("season") == X.SEASONS[0])
    first = levels.seasons_of(_appearances(spark, d))[0]
    labelled = profiles.withColumn("level", levels.consolidate_levels(F.col(f"level_{first}")))
    labels = ("AAA", "Affiliated", "DNP", "Independent", "MLB")
    return projection.compare_predictors(labelled, ["batter"], "level", labels)[1]


@query("project_levels")
def _(spark, d):
    profiles = _profiles(spark, d)
    training = profiles.where(F.col("season") == X.SEASONS[0])
    years = _horizons(spark, d)
    models, _ = projection.fit_horizons(training, years)
    target = profiles.where(F.col("season") == X.SEASONS[1])
    added = [model.level_column(y, x) for y, m in models.items() for x in m.labels]
    return model.project_levels(target, models).select("batter", *added)


@query("horizon_losses")
def _(spark, d):
    training = _profiles(spark, d).where(F.col("season") == X.SEASONS[0])
    return projection.fit_horizons(training, _horizons(spark, d))[1]


def _horizon_moments_sql(name: str = "Traditional", players: str = O.LINES, source: str = "lines") -> str:
    """Observed targets per horizon among the training players, the same rows the fits see."""
    fine = "CASE r.level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.PRIORITY_LEVELS.items()) + " END"
    named = ", ".join(f"'{x}'" for x in S.TARGET_LEVELS[:-1])
    usable = " AND ".join(f"l.{c} IS NOT NULL" for c in model.HORIZON_SETS[name])
    return f"""WITH {players}, seasons AS (
  SELECT season, row_number() OVER (ORDER BY season) AS nth FROM (SELECT DISTINCT year(o_orderdate) AS season FROM orders)),
played AS (
  SELECT o_custkey AS player, nth, o_orderpriority AS level, count(*) AS pa
  FROM orders JOIN seasons ON season = year(o_orderdate) WHERE nth <= {X.HORIZONS} GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY player, nth
    ORDER BY CASE WHEN pa >= 2 THEN 0 ELSE 1 END, CASE WHEN pa >= 2 THEN {_RANK_CASE} ELSE -pa END, {_RANK_CASE}) AS pick
  FROM played),
labelled AS (
  SELECT CAST(2024 + s.nth AS INT) AS year, CASE WHEN {fine} IN ({named}) THEN {fine} ELSE '{S.TARGET_LEVELS[-1]}' END AS label
  FROM {source} l JOIN seasons s ON s.nth <= {X.HORIZONS}
  LEFT JOIN ranked r ON r.player = l.batter AND r.nth = s.nth AND r.pick = 1
  WHERE l.season = {X.SEASONS[0]} AND {usable})
SELECT year, label, round(CAST(count(*) AS DOUBLE), 1) AS n FROM labelled GROUP BY year, label"""


def _horizon_moments(spark, d, name: str) -> DataFrame:
    training = _profiles(spark, d).where(F.col("season") == X.SEASONS[0])
    years = _horizons(spark, d)
    fitted, _ = projection.fit_horizons(
        training, years, predictor_sets={name: model.HORIZON_SETS[name]}, chosen=name)
    parts = []
    for year, m in fitted.items():
        names = {x: f"p_{i}" for i, x in enumerate(m.labels)}
        usable = training.dropna(subset=list(m.features))
        scored = add_class_probabilities(usable, m, names)
        parts.append(_moments(scored, names, (), {"n": (F.lit(1.0), 1)}).select(F.lit(year).alias("year"), "*"))
    return tables.union_sources(parts)


@query("horizon_moments", _horizon_moments_sql())
def _(spark, d):
    """Players expected in every target by the model of each horizon over its training rows."""
    return _horizon_moments(spark, d, "Traditional")


@query("horizon_moments_quality", _horizon_moments_sql("HitQuality", _TRACKED, "tracked"))
def _(spark, d):
    return _horizon_moments(spark, d, "HitQuality")


@query("horizon_moments_expected", _horizon_moments_sql("Expected", _TRACKED, "tracked"))
def _(spark, d):
    return _horizon_moments(spark, d, "Expected")


_CV_FOLD_MOMENTS = f"""WITH {O.BALLS}, folded AS (
  SELECT *, CAST((row_number() OVER (ORDER BY md5(CAST(pitch_id AS VARCHAR) || ':42'), pitch_id) - 1) % 5 + 1 AS INT) AS fold
  FROM balls)
""" + "\nUNION ALL ".join(
    f"""SELECT '{name}' AS model_set, h.fold AS held_out, '{y}' AS outcome, round(sum({y}), 1) AS hits,
  round(sum({y} * exit_speed) / sum({y}), 1) AS exit_speed
FROM folded f JOIN (SELECT DISTINCT fold FROM folded) h ON f.fold <> h.fold
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in features)} GROUP BY h.fold"""
    for name, features in model.FEATURE_SETS.items() for y in model.OUTCOME_FLAGS)


@query("cv_fold_moments", _CV_FOLD_MOMENTS)
def _(spark, d):
    """Hits, and their mean speed, that every cross-validation fit expects on the rows it was trained on."""
    balls = model.kfold(clean.batted_balls(X.plays(spark, d)), ["pitch_id"])
    parts = []
    for name, features in model.FEATURE_SETS.items():
        fits = [f for f in model.fit_folds(balls, feature_sets={name: features})]
        table = clean.hit_indicators(model.compress(balls, features, "fold", "play_result")).persist()
        for _, held_out, y, intercept, *weights in fits:
            p = binary_probability(intercept, weights, features) * F.col(model.WEIGHT)
            parts.append(table.where(F.col("fold") != held_out).agg(
                F.round(F.sum(p), 1).alias("hits"), F.round(F.sum(p * F.col("exit_speed")) / F.sum(p), 1).alias("exit_speed"),
            ).select(F.lit(name).alias("model_set"), F.lit(held_out).alias("held_out"), F.lit(y).alias("outcome"), "*"))
    return tables.union_sources(parts)


@query("cv_fold_moments_together", _CV_FOLD_MOMENTS)
def _(spark, d):
    """The same of fits that share their passes."""
    balls = model.kfold(clean.batted_balls(X.plays(spark, d)), ["pitch_id"])
    fits = folds.fit_folds_together(balls).fits
    numbers, parts = sorted({f[1] for f in fits}), []
    for name, features in model.FEATURE_SETS.items():
        table = clean.hit_indicators(model.compress(balls, features, "fold", "play_result"))
        schema = "fold int, model_set string, held_out int, outcome string, " + ", ".join(f"b{i} double" for i in range(len(features) + 1))
        models = F.broadcast(spark.createDataFrame(  # a row per fit and fold it was trained on
            [(fold, *f) for f in fits if f[0] == name for fold in numbers if fold != f[1]], schema))
        z = sum((F.col(f"b{i + 1}") * F.col(c) for i, c in enumerate(features)), F.col("b0"))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) * F.col(model.WEIGHT)
        parts.append(table.join(models, "fold").groupBy("model_set", "held_out", "outcome").agg(
            F.round(F.sum(p), 1).alias("hits"), F.round(F.sum(p * F.col("exit_speed")) / F.sum(p), 1).alias("exit_speed")))
    return tables.union_sources(parts)
