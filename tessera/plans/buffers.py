"""Queries over buffers that empty themselves, each with its SQL: a recursion over all sessions at once, an event a step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buffers as B
from ..operators.sessions import CORRECTED, DECIDED, PATTERNED
from ..sources import views as V
from .sessions import quoted

QUERIES, SQL = {}, {}

#: Settings for events that lie hours apart.
BURST, WITHIN, AGE, IDLE = 4, 172_800, 200_000, 86_400
MOST, KEEP = 12, 6


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def told(spark, d):
    """All events of the log, with contents, files and tools by arithmetic on their ids."""
    i = F.col("event_id")
    content = F.when(i % 29 == 3, "All tests passed").when(i % 23 == 5, "We should use one pattern").when(i % 11 == 2, "pattern and architecture").otherwise("working on it")
    tool = F.when(F.col("event_type") == "tool_output", F.when(i % 13 == 1, "pytest").otherwise("bash"))
    path = F.when(i % 3 == 0, F.concat(F.lit("src/m"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 604_800).cast("string")))
    return V.log(spark, d).select("session_id", "event_id", "ts", "event_type", "exit_code", content.alias("content"), tool.alias("tool_name"), path.alias("path"))


any_ = lambda patterns: " OR ".join(f"regexp_matches(content, {quoted(p)})" for p in patterns)
says = lambda phrase: f"contains(lower(content), {quoted(phrase)})"
TOLD = f"""{V.LOG_SQL}, told AS (SELECT session_id, event_id, ts, event_type, exit_code, CASE WHEN event_id % 29 = 3 THEN 'All tests passed' WHEN event_id % 23 = 5 THEN 'We should use one pattern' WHEN event_id % 11 = 2 THEN 'pattern and architecture' ELSE 'working on it' END AS content,
  CASE WHEN event_type = 'tool_output' THEN CASE WHEN event_id % 13 = 1 THEN 'pytest' ELSE 'bash' END END AS tool_name, CASE WHEN event_id % 3 = 0 THEN 'src/m' || CAST(floor(floor(epoch(ts)) / 604800) AS BIGINT) END AS path FROM log),
 ev AS MATERIALIZED (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS k, epoch_us(ts) / 1e6 AS t, event_type = 'tool_output' AS tool, path, exit_code,
  {any_(B.COMPLETE)} OR (event_type = 'tool_output' AND coalesce(exit_code = 0, false) AND regexp_matches(tool_name, {quoted(B.TEST_TOOLS)})) AS done, {" OR ".join(map(says, DECIDED))} AS decided, {" OR ".join(map(says, CORRECTED))} AS corrected,
  {" + ".join(f"CASE WHEN {says(p)} THEN {1 << i} ELSE 0 END" for i, p in enumerate(PATTERNED))} AS patterns FROM told)"""

C = B.Checkpoints
TRIGGERED = f"""WITH RECURSIVE {TOLD},
 s AS (SELECT DISTINCT session_id, 0::BIGINT AS k, 0::BIGINT AS event_id, 0::BIGINT AS n, NULL::BIGINT AS first_id, []::DOUBLE[] AS tools, []::BOOLEAN[] AS dones, []::VARCHAR[] AS paths, NULL::VARCHAR AS fired, 0::BIGINT AS buffer FROM ev UNION ALL
  SELECT session_id, k, event_id, n, first_id, tools, dones, paths, CASE WHEN n < {C.least} THEN NULL WHEN len(tools) >= {BURST} THEN 'tool_burst' WHEN list_contains(dones[-{C.recent}:], true) THEN 'task_complete'
   WHEN n >= {C.shifts} AND len(list_filter(paths[:-{C.recent + 1}], lambda p: p IS NOT NULL)) > 0 AND len(list_filter(paths[-{C.recent}:], lambda p: p IS NOT NULL)) > 0
    AND NOT list_has_any(list_filter(paths[:-{C.recent + 1}], lambda p: p IS NOT NULL), list_filter(paths[-{C.recent}:], lambda p: p IS NOT NULL)) THEN 'topic_shift' END AS fired, buffer FROM
   (SELECT e.session_id, e.k, e.event_id, CASE WHEN s.fired IS NULL THEN s.n + 1 ELSE 1 END AS n, CASE WHEN s.fired IS NULL AND s.n > 0 THEN s.first_id ELSE e.event_id END AS first_id,
     list_filter(list_concat(CASE WHEN s.fired IS NULL THEN s.tools ELSE [] END, CASE WHEN e.tool THEN [e.t] ELSE [] END), lambda x: x >= e.t - {WITHIN}) AS tools,
     list_append(CASE WHEN s.fired IS NULL THEN s.dones ELSE [] END, e.done) AS dones, list_append(CASE WHEN s.fired IS NULL THEN s.paths ELSE [] END, e.path) AS paths, s.buffer + CASE WHEN s.fired IS NULL THEN 0 ELSE 1 END AS buffer
    FROM s JOIN ev e ON e.session_id = s.session_id AND e.k = s.k + 1))
 SELECT session_id, CAST(buffer + 1 AS INTEGER) AS buffer, first_id, event_id, CAST(n AS INTEGER) AS n, coalesce(fired, 'end') AS trigger FROM s WHERE n > 0 QUALIFY fired IS NOT NULL OR row_number() OVER (PARTITION BY session_id ORDER BY k DESC) = 1"""


@query("buffer_triggers", TRIGGERED)
def buffer_triggers(spark, d):
    """Every session's buffers, and what ended them; its last with what the session leaves."""
    return B.checkpoints(told(spark, d), flush=True, burst=BURST, within=WITHIN)


A = B.Analyses
# A buffer that idles is emitted before the event that follows it: both are told by that event's step.
ANALYSED = f"""WITH RECURSIVE {TOLD},
 s AS (SELECT DISTINCT session_id, 0::BIGINT AS k, 0::BIGINT AS event_id, 0::BIGINT AS n, NULL::BIGINT AS first_id, 0::DOUBLE AS began, 0::DOUBLE AS t, false AS failed, false AS moment, 0::BIGINT AS patterns, NULL::VARCHAR AS fired, false AS idled FROM ev UNION ALL
  SELECT session_id, k, event_id, n, first_id, began, t, failed, moment, patterns, CASE WHEN n >= {A.most} THEN 'full' WHEN n < {A.least} THEN NULL WHEN t - began >= {AGE} THEN 'old' WHEN moment THEN 'moment' END AS fired, idled FROM
   (SELECT session_id, k, event_id, n, first_id, began, t, failed0 OR coalesce(exit_code <> 0, false) AS failed, moment0 OR decided OR corrected OR bit_count(patterns) >= 2 OR coalesce(failed0 AND exit_code = 0, false) AS moment, patterns, idled FROM
    (SELECT e.session_id, e.k, e.event_id, e.t, e.exit_code, e.decided, e.corrected, idle AS idled, CASE WHEN new THEN 1 ELSE n0 + 1 END AS n, CASE WHEN new THEN e.event_id ELSE first0 END AS first_id, CASE WHEN new THEN e.t ELSE began0 END AS began,
      NOT new AND failed00 AS failed0, NOT new AND moment00 AS moment0, CASE WHEN new THEN 0 ELSE patterns0 END | e.patterns AS patterns
     FROM (SELECT s.session_id, s.k, s.n AS n0, s.first_id AS first0, s.began AS began0, s.failed AS failed00, s.moment AS moment00, s.patterns AS patterns0, s.t AS t0, s.n = 0 OR s.fired IS NOT NULL AS empty FROM s) s
      JOIN (SELECT * FROM ev) e ON e.session_id = s.session_id AND e.k = s.k + 1, LATERAL (SELECT NOT s.empty AND e.t - s.t0 >= {IDLE} AS idle) i, LATERAL (SELECT s.empty OR i.idle AS new) w))),
 marked AS (SELECT *, lead(idled) OVER (PARTITION BY session_id ORDER BY k) AS idles FROM s WHERE k > 0),
 ends AS (SELECT session_id, k, first_id, event_id, n, CASE WHEN fired IS NOT NULL THEN fired WHEN idles THEN 'idle' WHEN idles IS NULL THEN 'end' END AS trigger FROM marked)
 SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY k) AS INTEGER) AS buffer, first_id, event_id, CAST(n AS INTEGER) AS n, trigger FROM ends WHERE trigger IS NOT NULL"""


@query("analysis_buffers", ANALYSED)
def analysis_buffers(spark, d):
    """Every session's buffers as they come to be analysed: full, old, with a learning moment, idle, or at the end."""
    return B.analyses(told(spark, d), age=AGE, idle=IDLE)


ROLLED = f"""WITH RECURSIVE keyed AS MATERIALIZED (SELECT user_id AS session_id, event_id, 'k' || (event_id * 7 % 31) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 s AS (SELECT DISTINCT session_id, 0::BIGINT AS k, 0::BIGINT AS event_id, []::VARCHAR[] AS seen, false AS new FROM keyed UNION ALL
  SELECT session_id, k, event_id, CASE WHEN NOT new THEN seen WHEN len(seen) + 1 > {MOST} THEN list_append(seen, key)[-{KEEP}:] ELSE list_append(seen, key) END AS seen, new FROM
   (SELECT e.session_id, e.k, e.event_id, s.seen, e.key, NOT list_contains(s.seen, e.key) AS new FROM s JOIN keyed e ON e.session_id = s.session_id AND e.k = s.k + 1))
 SELECT session_id, event_id FROM s WHERE new"""


@query("rolling_dedupe", ROLLED)
def rolling_dedupe(spark, d):
    """Events whose content is not among their session's last ones."""
    events = V.log(spark, d).select("session_id", "ts", "event_id", F.concat(F.lit("k"), F.col("event_id") * 7 % 31).alias("key"))
    return B.rolling(events, most=MOST, keep=KEEP)
