"""Plain SQL definitions, written from the definitions rather than from the Spark plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from dugout import schema as S
from dugout.functions.scoring import LinearModel
from verification import fixture as X

#: enough digits that averages over powers of two do not end on a half
DIGITS = 9


def text_list(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def final(ctes: str, source: str, plain: str, rounded: str = "", digits: int = DIGITS) -> str:
    """``plain`` columns as they are, ``rounded`` ones rounded, from ``source``."""
    columns = [*plain.split(), *[f"round({c}, {digits}) AS {c}" for c in rounded.split()]]
    head = f"WITH {ctes}\n" if ctes else ""
    return f"{head}SELECT {', '.join(columns)} FROM {source}"


def number(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def linear(intercept: float, weights: Sequence[float], features: Sequence[str]) -> str:
    return " + ".join([number(intercept), *[f"{number(w)} * {f}" for w, f in zip(weights, features)]])


def softmax(source: str, model: LinearModel, names: Mapping[str, str], where: str = "TRUE") -> str:
    """Query adding one probability column per class; null where not scored."""
    usable = " AND ".join([f"({where})", *[f"{f} IS NOT NULL" for f in model.features]])
    n = len(model.labels)
    z = ", ".join(
        f"CASE WHEN {usable} THEN {linear(b, w, model.features)} END AS z{i}"
        for i, (b, w) in enumerate(zip(model.intercepts, model.weights))
    )
    drop = ", ".join(f"z{i}" for i in range(n))
    peak = f"greatest({drop})"
    total = " + ".join(f"exp(z{i} - {peak})" for i in range(n))
    shares = ", ".join(
        f"exp(z{i} - {peak}) / ({total}) AS {names[x]}" for i, x in enumerate(model.labels) if x in names
    )
    return f"SELECT * EXCLUDE ({drop}), {shares} FROM (SELECT *, {z} FROM {source})"


HITS, TRACK = text_list(S.HITS), text_list(S.NEEDS_TRACKING)
STRIKEOUTS, NO_AB = text_list(S.STRIKEOUTS), text_list(S.NOT_AT_BAT)

PLAYS = f"plays AS ({X.PLAYS})"
LOG = f"log AS ({X.PITCH_LOG})"

BATTED = f"""play_result IS NOT NULL AND play_result NOT IN ('Walk', {STRIKEOUTS})
  AND exit_speed IS NOT NULL AND angle IS NOT NULL"""

BALLS = f"""{PLAYS}, balls AS (
  SELECT *, CAST(play_result = 'Single' AS INT) * CAST(1 AS DOUBLE) AS is_single,
    CAST(play_result = 'Double' AS INT) * CAST(1 AS DOUBLE) AS is_double,
    CAST(play_result = 'Triple' AS INT) * CAST(1 AS DOUBLE) AS is_triple,
    CAST(play_result = 'HomeRun' AS INT) * CAST(1 AS DOUBLE) AS is_home_run,
    CASE WHEN play_result IN ({HITS}) THEN play_result ELSE 'Not a Hit' END AS outcome
  FROM plays WHERE {BATTED})"""

SCORED = f"""{PLAYS}, probabilities AS (
  {softmax('plays', X.OUTCOME_MODEL, {'Single': 'x1b', 'Double': 'x2b', 'Triple': 'x3b', 'HomeRun': 'xhr'}, BATTED)}),
scored AS (SELECT *, x1b + x2b + x3b + xhr AS xba, x1b + 2 * x2b + 3 * x3b + 4 * xhr AS xslg FROM probabilities)"""

QUALIFIED = f"""qualified AS (
  SELECT season, batter, count(*) AS total_pa FROM plays WHERE play_result IS NOT NULL
  GROUP BY season, batter HAVING count(*) >= {X.MINIMUM})"""


def line_sql(source: str, by: str) -> str:
    """Batting line with plain and expected columns, grouped by ``by``."""
    count = lambda cond: f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"
    inner = f"""SELECT {by}, count(*) AS total_pa,
      {count(f"play_result NOT IN ({NO_AB})")} AS total_ab, {count("play_result = 'Walk'")} AS walks,
      {count(f"play_result IN ({STRIKEOUTS})")} AS strikeouts, {count(f"play_result IN ({HITS})")} AS hits,
      {count("play_result = 'Single'")} AS singles, {count("play_result = 'Double'")} AS doubles,
      {count("play_result = 'Triple'")} AS triples, {count("play_result = 'HomeRun'")} AS home_runs,
      {count("play_result = 'Error'")} AS errors,
      coalesce(sum(x1b), 0) AS x1b, coalesce(sum(x2b), 0) AS x2b, coalesce(sum(x3b), 0) AS x3b,
      coalesce(sum(xhr), 0) AS x_home_runs, coalesce(sum(xba), 0) AS sum_xba, coalesce(sum(xslg), 0) AS sum_xslg
    FROM {source} GROUP BY {by}"""
    return f"""SELECT *, CAST(hits + walks AS DOUBLE) / total_pa AS obp,
      CAST(hits AS DOUBLE) / nullif(total_ab, 0) AS ba,
      CAST(singles + 2 * doubles + 3 * triples + 4 * home_runs AS DOUBLE) / nullif(total_ab, 0) AS slg,
      CAST(hits + walks AS DOUBLE) / total_pa
        + CAST(singles + 2 * doubles + 3 * triples + 4 * home_runs AS DOUBLE) / nullif(total_ab, 0) AS ops,
      CAST(strikeouts AS DOUBLE) / total_pa AS k_percentage, CAST(walks AS DOUBLE) / total_pa AS bb_percentage,
      (walks + sum_xba) / total_pa AS xobp, sum_xba / nullif(total_ab, 0) AS xba,
      sum_xslg / nullif(total_ab, 0) AS xslg,
      (walks + sum_xba) / total_pa + sum_xslg / nullif(total_ab, 0) AS xops
    FROM ({inner})"""


LINES = f"""{SCORED}, {QUALIFIED}, kept AS (
  SELECT s.* FROM scored s JOIN qualified q ON s.season = q.season AND s.batter IS NOT DISTINCT FROM q.batter
  WHERE play_result IS NOT NULL
    AND NOT (play_result IN ({TRACK}) AND (exit_speed IS NULL OR angle IS NULL))),
lines AS ({line_sql('kept', 'season, batter')})"""

LEAGUE = f"league AS ({line_sql('(SELECT * FROM scored WHERE play_result IS NOT NULL)', 'season')})"

RUNS = f"""runs AS (
  SELECT *, outs + outs_on_play AS post_outs, coalesce(runs_scored, 0) AS r,
    CAST(sum(coalesce(runs_scored, 0)) OVER (
      PARTITION BY game_date, game_no, inning, top_bottom ORDER BY ts, pitch_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_runs,
    CAST(coalesce(sum(coalesce(runs_scored, 0)) OVER (
      PARTITION BY game_date, game_no, inning, top_bottom ORDER BY ts, pitch_id
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS runs_to_end
  FROM plays WHERE play_result IS NOT NULL)"""

STATES = f"""{RUNS}, re AS (SELECT season, outs, avg(runs_to_end) AS avg_runs_to_end FROM runs GROUP BY season, outs),
states AS (
  SELECT r.*, pre.avg_runs_to_end AS pre,
    CASE WHEN r.post_outs = 3 THEN 0 ELSE post.avg_runs_to_end END AS post
  FROM runs r LEFT JOIN re pre ON pre.season = r.season AND pre.outs IS NOT DISTINCT FROM r.outs
  LEFT JOIN re post ON post.season = r.season AND post.outs = r.post_outs)"""

RUN_VALUES = f"""{STATES}, per_state AS (
  SELECT season, outs, play_result, avg(runs_to_end + r) AS value FROM runs GROUP BY season, outs, play_result),
m2s AS (
  SELECT r.season, r.play_result, avg(p.value) AS m2
  FROM runs r JOIN per_state p ON p.season = r.season AND p.play_result = r.play_result
    AND p.outs IS NOT DISTINCT FROM r.outs GROUP BY r.season, r.play_result),
m13 AS (
  SELECT season, play_result, count(*) AS plays, avg(post - pre + r) AS m1,
    avg(runs_to_end + r + (post - pre)) AS m3 FROM states GROUP BY season, play_result),
run_values AS (SELECT m13.*, m2s.m2 FROM m13 JOIN m2s USING (season, play_result))"""


def weights_sql(values: str = "run_values") -> str:
    def method(m: str) -> str:
        return f"""v.{m} - (SELECT o.{m} FROM {values} o WHERE o.season = v.season AND o.play_result = 'Out') AS {m}_centred"""

    return f"""totals AS (
  SELECT season, count(*) AS pa,
    CAST(count(*) FILTER (WHERE play_result IN ({HITS}) OR play_result = 'Walk') AS DOUBLE) / count(*) AS league_obp
  FROM plays WHERE play_result IS NOT NULL GROUP BY season),
centred AS (SELECT v.season, v.play_result, v.plays, {method('m2')}, {method('m3')} FROM {values} v),
unscaled AS (
  SELECT c.season, sum(c.m2_centred * c.plays) / max(t.pa) AS m2_unscaled_woba,
    sum(c.m3_centred * c.plays) / max(t.pa) AS m3_unscaled_woba
  FROM centred c JOIN totals t USING (season)
  WHERE c.play_result IN ('Walk', {HITS}) GROUP BY c.season),
weights AS (
  SELECT c.season, c.play_result, c.m2_centred, c.m3_centred, t.league_obp, u.m2_unscaled_woba, u.m3_unscaled_woba,
    c.m2_centred * (t.league_obp / u.m2_unscaled_woba) AS m2_weight,
    c.m3_centred * (t.league_obp / u.m3_unscaled_woba) AS m3_weight
  FROM centred c JOIN totals t USING (season) JOIN unscaled u USING (season)),
w AS (
  SELECT season, max(m3_weight) FILTER (WHERE play_result = 'Walk') AS w_walk,
    max(m3_weight) FILTER (WHERE play_result = 'Single') AS w_single,
    max(m3_weight) FILTER (WHERE play_result = 'Double') AS w_double,
    max(m3_weight) FILTER (WHERE play_result = 'Triple') AS w_triple,
    max(m3_weight) FILTER (WHERE play_result = 'HomeRun') AS w_home_run
  FROM weights GROUP BY season)"""


WEIGHTS = f"{RUN_VALUES}, {weights_sql()}"
REFERENCE_WEIGHTS = f"""{RUN_VALUES}, taken AS (
  SELECT o.season, o.play_result, o.plays, s.m2, s.m3
  FROM run_values o JOIN run_values s ON s.play_result = o.play_result AND s.season = {X.SEASONS[0]}),
{weights_sql('taken')}"""


def on_base(source: str) -> str:
    actual = "w_single * singles + w_double * doubles + w_triple * triples + w_home_run * home_runs + w_walk * walks"
    likely = "w_single * x1b + w_double * x2b + w_triple * x3b + w_home_run * x_home_runs + w_walk * walks"
    return f"""SELECT l.*, ({actual}) / total_pa AS woba, ({likely}) / total_pa AS xwoba
    FROM {source} l JOIN w USING (season)"""


PLAYERS = f"{LINES}, {WEIGHTS}, players AS ({on_base('lines')})"
LEAGUES = f"{PLAYERS}, {LEAGUE}, league_m2 AS ({on_base('league')})"
STATS = ("xba", "xobp", "xslg", "xops", "k_percentage", "bb_percentage", "woba", "xwoba")
LEAGUE_M1 = (
    f"{PLAYERS}, league_m1 AS (SELECT season, " + ", ".join(f"avg({s}) AS {s}" for s in STATS)
    + " FROM players GROUP BY season)"
)


def plus(league: str, on: str = "l.season = p.season") -> str:
    shares = ", ".join(f"100 * (p.{s} / l.{s}) AS {s}_plus" for s in STATS)
    return f"plus AS (SELECT p.season, p.batter, {shares} FROM players p JOIN {league} l ON {on})"


PLUS_COLUMNS = " ".join(f"{s}_plus" for s in STATS)
LINE_PLAIN = "total_pa total_ab walks strikeouts hits singles doubles triples home_runs errors"
LINE_RATES = "obp ba slg ops k_percentage bb_percentage"
LINE_EXPECTED = "x1b x2b x3b x_home_runs xobp xba xslg xops"
