"""The query of the life of audits, as a stream, and the same in SQL."""

from __future__ import annotations

from ..streaming import status as T
from ..streaming import streams

# Sign-ups ask for an audit, purchases complete it, errors make it fail; two days are its time.
KINDS = {"signup": "run", "purchase": "complete", "error": "failed"}
TIMEOUT = 2 * 86_400


def audit_status(spark, d):
    """Every change of every user's audits, from the events as a stream."""
    return T.run_status(streams._closed_events(spark, d, "click"), KINDS, TIMEOUT)


QUERIES = {f.__name__: f for f in (audit_status,)}
ORACLE_SQL = {
    "audit_status": f"""WITH RECURSIVE e AS (
  SELECT user_id AS key, event_id, ts::TIMESTAMP AS ts, CASE event_type WHEN 'signup' THEN 'run' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS kind,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
  FROM (SELECT DISTINCT user_id, event_id, ts, event_type FROM events WHERE event_type IN ('signup', 'purchase', 'error') AND user_id IS NOT NULL AND ts IS NOT NULL)
), s AS (
  SELECT key, 0::BIGINT AS k, NULL::BIGINT AS run_id, NULL::TIMESTAMP AS started, NULL::BIGINT AS over_id, NULL::TIMESTAMP AS over_at, NULL::BIGINT AS end_id, NULL::VARCHAR AS end_kind, NULL::TIMESTAMP AS now FROM e WHERE k = 1
  UNION ALL
  SELECT key, k, CASE WHEN kind = 'run' THEN coalesce(live_id, event_id) END, CASE WHEN kind = 'run' THEN coalesce(live, ts) END,
         CASE WHEN live IS NULL THEN run_id END, CASE WHEN live IS NULL THEN started + INTERVAL {TIMEOUT} SECOND END, CASE WHEN kind <> 'run' THEN live_id END, kind, ts
  FROM (SELECT e.*, s.run_id, s.started, CASE WHEN e.ts <= s.started + INTERVAL {TIMEOUT} SECOND THEN s.run_id END AS live_id, CASE WHEN e.ts <= s.started + INTERVAL {TIMEOUT} SECOND THEN s.started END AS live
        FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)
), last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1)
SELECT DISTINCT key, run_id, 'processing' AS status, started AS at FROM s WHERE run_id IS NOT NULL
UNION ALL SELECT key, over_id, 'timed out', over_at FROM s WHERE over_id IS NOT NULL
UNION ALL SELECT key, end_id, end_kind, now FROM s WHERE end_id IS NOT NULL
UNION ALL SELECT key, run_id, 'timed out', started + INTERVAL {TIMEOUT} SECOND FROM last WHERE run_id IS NOT NULL"""
}
