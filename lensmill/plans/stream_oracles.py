"""DuckDB SQL of the queries in streams.py."""

from __future__ import annotations

from lensmill.operators.registry import DEFAULT_MODEL
from lensmill.plans.oracles import FLAGGED, PIXELS, r6
from lensmill.plans.streams import ACTIVATIONS_SQL, BEGIN, ONE_SESSION_SQL, PART, READING, SHUTTER, WINDOW
from lensmill.streaming.store import CLEARS, FIELDS, SETS


def _walk(timely: str, window: int, fires_once: bool) -> str:
    """The fold of each session's frames, one a step; unless it fires once, answers come SHUTTER and READING after a shot."""
    answered = "FALSE" if fires_once else f"w.stage = 'capturing' AND f.t >= w.shot + {SHUTTER + READING}"
    good = "(w.s + (w.shot // 50)) % 3 <> 0"
    return f"""{FLAGGED.replace("WITH raw AS", "WITH RECURSIVE raw AS", 1)},
timely AS (SELECT session_id AS s, event_id, timestamp_ms AS t, is_valid AS v, CASE WHEN detected THEN tl_x END AS corner, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_ms, event_id) AS n FROM coded WHERE {timely}),
walk AS (
  SELECT DISTINCT s, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS fw, 'idle' AS was, 'idle' AS stage, CAST(NULL AS BIGINT) AS since, FALSE AS latch, CAST(NULL AS BIGINT) AS shot, FALSE AS forwarded FROM timely
  UNION ALL
  SELECT s, n, t, CASE WHEN forwarded THEN t ELSE fw END AS fw, was,
    CASE WHEN idle_again THEN 'idle' WHEN taken AND t - coalesce(since, t) >= {window} THEN 'capturing' WHEN taken AND since IS NULL THEN 'stabilizing' ELSE was END AS stage,
    CASE WHEN idle_again THEN NULL WHEN taken THEN coalesce(since, t) ELSE since END AS since, latch AND NOT idle_again AS latch,
    CASE WHEN taken AND t - coalesce(since, t) >= {window} THEN t ELSE shot END AS shot, forwarded
  FROM (
    SELECT *, forwarded AND was NOT IN ('capturing', 'completed') AND NOT v AS idle_again, forwarded AND was NOT IN ('capturing', 'completed') AND v AND NOT latch AS taken
    FROM (
      SELECT w.s, f.n, f.t, f.v, w.fw, w.shot, f.t - w.fw >= 66 AS forwarded, CASE WHEN {answered} THEN CASE WHEN {good} THEN 'completed' ELSE 'failed' END ELSE w.stage END AS was,
        CASE WHEN {answered} AND NOT {good} THEN NULL ELSE w.since END AS since, CASE WHEN {answered} THEN NOT {good} ELSE w.latch END AS latch
      FROM walk w JOIN timely f ON f.s = w.s AND f.n = w.n + 1) looked) judged),
moves AS (SELECT s, t, stage, CASE WHEN stage = 'capturing' THEN 1.0::DOUBLE ELSE 0 END AS progress FROM walk WHERE n > 0 AND stage <> was)"""


_LATE = f"timestamp_ms - {BEGIN} < {PART} AND event_id % 23 = 0"

SQL = {
    "stream_out_of_order": _walk(f"NOT ({_LATE})", 1000, True)
    + f""" SELECT s AS session_id, t AS timestamp_ms, stage, {r6("progress")} AS stability_progress FROM moves
UNION ALL SELECT session_id, timestamp_ms, 'late', NULL FROM coded WHERE {_LATE}""",
    "capture_loop": _walk("TRUE", WINDOW, False)
    + f""", shots AS (SELECT s, t AS shot, t + {SHUTTER} AS begun FROM moves WHERE stage = 'capturing'),
forwarded AS (SELECT w.s, w.t, f.corner FROM walk w JOIN timely f ON w.s = f.s AND w.n = f.n WHERE w.forwarded),
extracted AS MATERIALIZED (SELECT a.s, a.shot, a.begun, f.t AS frame_ms, f.corner FROM shots a ASOF LEFT JOIN forwarded f ON a.s = f.s AND a.begun > f.t)
SELECT s AS session_id, t AS timestamp_ms, stage, {r6("progress")} AS stability_progress, CAST(-1 AS BIGINT) AS frame_ms, -1.0::DOUBLE AS tl_x FROM moves
UNION ALL SELECT s, begun, 'processing', 0, coalesce(frame_ms, -1), coalesce(corner, -1) FROM extracted
UNION ALL SELECT s, begun + {READING}, CASE WHEN (s + (shot // 50)) % 3 <> 0 THEN 'completed' ELSE 'failed' END, 0, -1, -1 FROM extracted""",
}


def _touching(field: str) -> str:
    kinds = [f"'{k}'" for k in SETS if field in SETS[k] or field in CLEARS.get(k, ())]
    sets = [f"'{k}'" for k in SETS if field in SETS[k]]
    return f"coalesce(max_by(CASE WHEN kind IN ({', '.join(sets)}) THEN coalesce(value, '') ELSE '' END, timestamp_ms * 1000000000 + event_id) FILTER (kind IN ({', '.join(kinds)})), '') AS {field}"


SQL["store_latest"] = (
    FLAGGED
    + f""", told AS (
  SELECT session_id, event_id, timestamp_ms, 'guidance' AS kind, code AS value FROM coded
  UNION ALL SELECT session_id, event_id, timestamp_ms, 'stage', CASE WHEN event_id % 2 = 0 THEN 'stabilizing' ELSE 'idle' END FROM coded WHERE event_id % 3 = 0
  UNION ALL SELECT session_id, event_id, timestamp_ms + 10, 'result', 'r' || event_id FROM coded WHERE event_id % 5 = 0
  UNION ALL SELECT session_id, event_id, timestamp_ms + 20, 'error', 'e' || event_id FROM coded WHERE event_id % 7 = 0
  UNION ALL SELECT session_id, event_id, timestamp_ms + 30, 'reset', NULL FROM coded WHERE event_id % 41 = 0)
SELECT session_id, max(timestamp_ms) AS timestamp_ms, {", ".join(map(_touching, FIELDS))} FROM told GROUP BY session_id"""
)
SQL["stream_store"] = SQL["store_latest"]
SQL["throttle_one_session"] = f"""WITH RECURSIVE raw AS ({ONE_SESSION_SQL}), times AS (SELECT timestamp_ms AS t, min(event_id) AS event_id FROM raw GROUP BY timestamp_ms),
hops AS MATERIALIZED (SELECT a.t, b.t AS further FROM times a ASOF LEFT JOIN times b ON a.t + 66 <= b.t),
walk AS (SELECT min(t) AS t FROM times WHERE t >= 66 UNION ALL SELECT h.further AS t FROM walk w JOIN hops h ON h.t = w.t WHERE h.further IS NOT NULL)
SELECT CAST(1 AS BIGINT) AS session_id, event_id, t AS timestamp_ms FROM walk JOIN times USING (t)"""
SQL["motion_one_session"] = f"""{PIXELS}, b AS (SELECT *, lag(v) OVER (PARTITION BY x, y ORDER BY event_id) AS w FROM px)
SELECT CAST(1 AS BIGINT) AS session_id, event_id, {r6("avg(coalesce(abs(v - w), 0)) / 255")} AS motion_score FROM b GROUP BY event_id"""

_LOADS = f"""WITH RECURSIVE reg AS (SELECT DISTINCT 'm' || (p_partkey % 50) AS id FROM part), log AS ({ACTIVATIONS_SQL}),
walk AS (
  SELECT DISTINCT app_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS model_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS began_ms, CAST(NULL AS BIGINT) AS ended_ms,
    CAST(NULL AS VARCHAR) AS loaded, CAST(-1 AS BIGINT) AS ends, FALSE AS good, CAST(NULL AS VARCHAR) AS flying FROM log
  UNION ALL
  SELECT app_id, nth, seq, model_id, outcome, CASE WHEN outcome IN ('loaded', 'failed') THEN begins END AS began_ms, CASE WHEN outcome IN ('loaded', 'failed') THEN begins + load_ms END AS ended_ms,
    CASE WHEN outcome IN ('loaded', 'failed') THEN at_begin ELSE before END AS loaded, CASE WHEN outcome IN ('loaded', 'failed') THEN begins + load_ms WHEN flies THEN ends ELSE -1 END AS ends,
    CASE WHEN outcome IN ('loaded', 'failed') THEN succeeds ELSE good END AS good, CASE WHEN outcome IN ('loaded', 'failed') THEN model_id WHEN flies THEN flying END AS flying
  FROM (
    SELECT *, CASE WHEN NOT known THEN 'error' WHEN coalesce(before = model_id, FALSE) THEN 'noop' WHEN flies AND NOT good THEN 'rejected' WHEN flies AND flying = model_id THEN 'joined' WHEN succeeds THEN 'loaded' ELSE 'failed' END AS outcome,
      CASE WHEN flies THEN ends ELSE started_ms END AS begins, CASE WHEN flies THEN CASE WHEN good THEN flying ELSE before END ELSE before END AS at_begin
    FROM (
      SELECT l.*, w.ends, w.good, w.flying, l.model_id IN (SELECT id FROM reg) AS known, w.ends > l.started_ms AS flies,
        CASE WHEN w.flying IS NOT NULL AND w.good AND w.ends <= l.started_ms THEN w.flying ELSE w.loaded END AS before
      FROM walk w JOIN log l ON l.app_id = w.app_id AND l.nth = w.nth + 1) looked) judged),
runs AS (SELECT app_id, seq, model_id, outcome, began_ms, ended_ms FROM walk WHERE nth > 0)"""
SQL["registry_loads"] = f"{_LOADS} SELECT * FROM runs"
SQL["registry_loaded"] = f"""{_LOADS}, last_of AS (SELECT app_id, max_by(model_id, ended_ms) FILTER (outcome = 'loaded') AS loaded_id FROM runs GROUP BY app_id)
SELECT app_id, coalesce(loaded_id, '') AS loaded_id, coalesce(loaded_id, '{DEFAULT_MODEL["id"]}') AS active_id, loaded_id IS NOT NULL AS is_loaded FROM last_of"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
