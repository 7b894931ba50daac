"""Queries over event synopses, tiers, levels, questions and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import events as E
from ..functions import text as X
from ..operators import conflicts as C
from ..operators import evaluation as Z
from ..operators import records as R
from ..operators import sessions as Y
from ..sources import views as V
from .records import TIER
from .sessions import STATEMENTS, quoted, rows, values

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


QUESTIONS = ("How many times did Caroline and Melanie visit the museum?", "When did Tom buy a dog?", "What is the colour of the house?", "Where did Ann go after the concert?")
PATHS = ("file: src/a.ts", "at lib/b.py:12", "import x from './c/d'", "see src/e.js now", "nothing", "path: ./x.json and at ./y.py:3")
ANSWERS = ("I think it works.", "Not sure, maybe, possibly wrong.", "It is parquet.", "Unclear.")


@query("query_signals", f"WITH {values(QUESTIONS)} SELECT id, regexp_matches(lower(text), 'how many|number of|times\\b|count\\b') AS counting, regexp_matches(lower(text), 'and|both|compare|versus|vs\\b|together|relationship|between') AS multi_hop, regexp_matches(lower(text), 'when|what date|what time|how long ago|before|after|during|last\\s+\\w+|next\\s+\\w+') AS temporal FROM t")
def query_signals(spark, d):
    return rows(spark, QUESTIONS, d).select("id", E.query_signals(F.col("text")).alias("s")).select("id", "s.counting", "s.multi_hop", "s.temporal")


DOUBTS = " + ".join(f"CAST(contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for p in X.DOUBT)


@query("level_upgrades", f"WITH {values(ANSWERS)}, n AS (SELECT id, {DOUBTS} AS n FROM t) SELECT id, (['minimal', 'task', 'deep'])[1 + CASE WHEN n >= 3 THEN 2 WHEN n >= 1 THEN 1 ELSE 0 END] AS level FROM n")
def level_upgrades(spark, d):
    return rows(spark, ANSWERS, d).select("id", E.upgraded_level(F.lit("minimal"), F.col("text")).alias("level"))


@query("level_recommended", f"WITH {values(QUESTIONS)} SELECT id, CASE WHEN regexp_matches(text, '(?i)architect|design|structure|history|evolution|all|everything') OR length(text) > 100 THEN 'deep' WHEN regexp_matches(text, '(?i)status|check|valid|still') OR length(text) < 20 THEN 'minimal' ELSE 'task' END AS level FROM t")
def level_recommended(spark, d):
    return rows(spark, QUESTIONS, d).select("id", E.recommended_level(F.col("text")).alias("level"))


@query(
    "tier_falls",
    f"""WITH {V.MEMORIES_SQL}, t AS (SELECT id, {TIER} AS tier, (['file_deleted', 'file_changed', 'time_decay', 'conflict'])[id // 7 % 4 + 1] AS reason FROM memories)
 SELECT id, tier, reason, CASE WHEN tier = 'grounded' AND reason IN ('file_deleted', 'time_decay') THEN 'observed' WHEN tier = 'grounded' AND reason IN ('file_changed', 'conflict') THEN 'inferred'
 WHEN tier = 'observed' AND reason = 'time_decay' THEN 'inferred' WHEN tier = 'observed' AND reason = 'conflict' THEN 'hypothesis' ELSE tier END AS falls_to FROM t""",
)
def tier_falls(spark, d):
    """What the tier of each memory falls to, the reason taken from its id."""
    tiered = R.with_tier(V.memories(spark, d), V.now())
    reason = V.nth(("file_deleted", "file_changed", "time_decay", "conflict"), F.floor(F.col("id") / 7) % 4)
    return tiered.select("id", "tier", reason.alias("reason")).select("id", "tier", "reason", E.downgraded_tier(F.col("tier"), F.col("reason")).alias("falls_to"))


@query("exit_codes", f"WITH {values(STATEMENTS)} SELECT id, CASE WHEN regexp_matches(text, '(?i)error|failed|command not found|permission denied|no such file') THEN 1 END AS exit_code FROM t")
def exit_codes(spark, d):
    return rows(spark, STATEMENTS, d).select("id", E.inferred_exit_code(F.lit("bash"), F.col("text")).alias("exit_code"))


def of_kind(text: str = "text") -> str:
    """The kind of an event by its text, in SQL."""
    any_ = lambda ps: " OR ".join(f"regexp_matches({text}, {quoted(p)})" for p in ps)
    return f"CASE WHEN {any_(X.ERROR)} THEN 'error' WHEN {any_(X.DIFF)} THEN 'diff' WHEN {any_(X.TESTS)} THEN 'test_summary' ELSE 'turn' END"


def first_sql(*patterns: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(text, {quoted(p)}) THEN regexp_extract(text, {quoted(p)}, 1) END" for p in patterns) + ")"


def count_of(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(text, {quoted(pattern)}) THEN CAST(regexp_extract(text, {quoted(pattern)}, 1) AS INTEGER) END"


SYNOPSES = rf"""WITH {values(STATEMENTS)}, k AS (SELECT id, text, {of_kind()} AS kind, length(text) AS n, len(string_split(text, chr(10))) AS lines, {count_of(E.PASSED)} AS good, {count_of(E.FAILED)} AS bad FROM t),
s AS (SELECT *, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fKB', floor(n * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.1fMB', floor(n * 10 / 1048576.0 + 0.5) / 10) END AS size,
 {first_sql(r"(?i)error[:\s]+(.+?)(?:\n|\z)", r"(?i)exception[:\s]+(.+?)(?:\n|\z)", r"(?i)failed[:\s]+(.+?)(?:\n|\z)", r"(?im)^(.+?error.+?)$")} AS said,
 {first_sql(r"(?im)error[:\s]+(.+?)$", r"(?im)exception[:\s]+(.+?)$", r"(?im)^(.+?error.+?)$")} AS wrong,
 regexp_extract_all(text, '(?m)^(?:diff|---|\+\+\+)\s+[ab]?/?(.+?)(?:\s|\z)', 1) AS files, len(regexp_extract_all(text, '(?m)^\+[^+]')) AS added, len(regexp_extract_all(text, '(?m)^-[^-]')) AS removed FROM k)
SELECT id, kind, sha256(CASE kind WHEN 'error' THEN 'Error: ' || substr(coalesce(said, text), 1, 100)
 WHEN 'test_summary' THEN CASE WHEN coalesce(good, 0) > 0 OR coalesce(bad, 0) > 0 THEN 'Tests: ' || coalesce(good, 0) || ' passed, ' || coalesce(bad, 0) || ' failed' WHEN regexp_matches(text, '(?i)all (?:tests? )?pass') THEN 'Tests: all passed' WHEN regexp_matches(text, '(?i)(?:test|tests) failed') THEN 'Tests: failed' ELSE 'Tests: ' || substr(text, 1, 80) END
 WHEN 'diff' THEN 'Diff: ' || coalesce(trim(files[1]), 'unknown') || ' (+' || added || '/-' || removed || ')' ELSE kind || ': ' || lines || ' lines, ' || size END) AS synopsis,
 CAST(lines AS INTEGER) AS line_count, CASE WHEN kind = 'error' THEN substr(trim(wrong), 1, 200) END AS error, CASE WHEN kind = 'test_summary' THEN good END AS passed, CASE WHEN kind = 'test_summary' THEN bad END AS failed FROM s"""


@query("event_synopses", SYNOPSES)
def event_synopses(spark, d):
    said = rows(spark, STATEMENTS, d).withColumn("kind", X.event_type(F.col("text")))
    none = F.lit(None).cast("string")
    parts = (F.col("text"), F.col("kind"), none, F.lit(None).cast("int"))
    made = said.select("id", "kind", F.sha2(E.synopsis(*parts, none), 256).alias("synopsis"), E.signals(*parts).alias("s"))
    return made.select("id", "kind", "synopsis", "s.line_count", "s.error", "s.passed", "s.failed")


PATHS_SQL = " UNION ALL ".join(f"SELECT id, unnest(regexp_extract_all(text, {quoted(p)}, 1)) AS path FROM t" for p in E.CODE_PATHS)


@query("code_paths", f"WITH {values(PATHS)}, f AS ({PATHS_SQL}) SELECT DISTINCT id, regexp_replace(path, '^\\./', '') AS path FROM f WHERE length(path) BETWEEN 3 AND 199")
def code_paths(spark, d):
    return rows(spark, PATHS, d).select("id", F.explode(E.code_paths(F.col("text"))).alias("path"))


WANTED = "w AS (SELECT session_id, count(*) AS n FROM turns GROUP BY 1), k AS (SELECT session_id FROM turns WHERE role = 'assistant' AND length(content) > 800)"


@query("session_recall", f"WITH {V.TURNS_SQL}, {WANTED}, q AS (SELECT session_id // 4 AS question_id, count(*) AS wanted, count(*) FILTER (session_id IN (SELECT session_id FROM k)) AS hits FROM w GROUP BY 1) SELECT question_id, round(hits / wanted::DOUBLE, 6) AS recall, hits > 0 AS hit FROM q")
def session_recall(spark, d):
    turns = V.turns(spark, d)
    question = F.floor(F.col("session_id") / 4).cast("long")
    wanted = turns.select("session_id").distinct().groupBy(question.alias("question_id")).agg(F.collect_list("session_id").alias("sessions"))
    found = turns.filter((F.col("role") == "assistant") & (F.length("content") > 800)).select(question.alias("question_id"), "session_id")
    return Z.session_recall(found, wanted).select("question_id", F.round("recall", 6).alias("recall"), "hit")


@query("run_comparison", f"""WITH {V.TURNS_SQL}, w AS (SELECT DISTINCT session_id FROM turns), r AS (SELECT cut, session_id // 4 AS question_id, count(*) AS wanted, count(*) FILTER (session_id IN (SELECT session_id FROM turns WHERE role = 'assistant' AND length(content) > cut)) AS hits FROM w, (VALUES (800), (1200)) c(cut) GROUP BY 1, 2),
 s AS (SELECT cut, avg(hits / wanted::DOUBLE) AS recall, avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM r GROUP BY 1), m AS (SELECT cut, unnest(['recall', 'hit_rate']) AS metric, unnest([recall, hit_rate]) AS v FROM s)
 SELECT a.metric, round(a.v, 6) AS baseline, round(b.v, 6) AS experiment, round(b.v - a.v, 6) AS delta FROM m a JOIN m b ON a.metric = b.metric AND a.cut = 800 AND b.cut = 1200""")
def run_comparison(spark, d):
    turns = V.turns(spark, d)
    question = F.floor(F.col("session_id") / 4).cast("long")
    wanted = turns.select("session_id").distinct().groupBy(question.alias("question_id")).agg(F.collect_list("session_id").alias("sessions"))
    found = lambda cut: turns.filter((F.col("role") == "assistant") & (F.length("content") > cut)).select(question.alias("question_id"), "session_id")
    runs = [Z.run_summary(Z.session_recall(found(cut), wanted)) for cut in (800, 1200)]
    return Z.compared(*runs, ("recall", "hit_rate")).select("metric", *(F.round(c, 6).alias(c) for c in ("baseline", "experiment", "delta")))


@query("dataset_statistics", "SELECT (SELECT count(*) FROM documents) AS memories, (SELECT count(DISTINCT t) FROM (SELECT unnest([lang, source]) AS t FROM documents)) AS topics, (SELECT count(*) FROM benchmark) AS queries, (SELECT avg(n) FROM (SELECT length(text) % 5 + 1 AS n FROM benchmark)) AS relevant_per_query")
def dataset_statistics(spark, d):
    docs = V.read(spark, d, "documents").select(F.array("lang", "source").alias("topics"))
    asked = V.read(spark, d, "benchmark").select(F.sequence(F.lit(0), (F.length("text") % 5).cast("int")).alias("relevant"))
    return Z.dataset_statistics(docs, asked)


@query("merge_groups")
def merge_groups(spark, d):
    return Z.merge_groups(C.similar_pairs(V.memories(spark, d)))


@query("conversational_search")
def conversational_search(spark, d):
    results = V.turns(spark, d).filter("role = 'assistant'").select((F.col("session_id") * 1000 + F.col("pos")).alias("id"), "session_id", (F.length("content") / 10_000.0).alias("score"))
    facts = spark.createDataFrame([(1, 900, "Caroline", "went_to", "Caroline went to the museum"), (2, 901, "Tom", "got", "Tom got a dog")], "id long, session_id long, subject string, predicate string, content string")
    return Z.conversational(results, facts, QUESTIONS[0]).select("place", "id", "session_id")


@query("events_of_session", f"WITH {V.LOG_SQL} SELECT event_id, event_type FROM log WHERE session_id = 7 AND event_type IN ('error', 'turn') ORDER BY ts DESC, event_id DESC LIMIT 20")
def events_of_session(spark, d):
    return Y.recent(V.log(spark, d), 20, session=7, types=("error", "turn")).select("event_id", "event_type")


@query("buffer_statistics", f"WITH {V.LOG_SQL} SELECT event_type, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY) AS last_day FROM log GROUP BY 1")
def buffer_statistics(spark, d):
    return Y.buffer_statistics(V.log(spark, d), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))


@query("previous_session", "SELECT user_id AS session_id, strftime(min(ts), '%Y-%m-%d') AS started FROM events GROUP BY 1 ORDER BY min(ts) DESC, user_id LIMIT 1 OFFSET 1")
def previous_session(spark, d):
    from ..operators import lifecycle

    s = V.log(spark, d).groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    return lifecycle.current_session(s, 2).select("session_id", F.date_format("started_at", "yyyy-MM-dd").alias("started"))


@query("known_hashes", "SELECT doc_id, substr(sha256(text), 1, 16) IN (SELECT substr(sha256(text), 1, 16) FROM documents WHERE doc_id % 3 = 0) AS known FROM documents")
def known_hashes(spark, d):
    from ..functions import text

    docs = V.read(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    seen = docs.filter("doc_id % 3 = 0").select(F.col("hash").alias("h")).distinct()
    return docs.join(seen, F.col("hash") == F.col("h"), "left").select("doc_id", F.col("h").isNotNull().alias("known"))
