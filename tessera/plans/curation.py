"""Queries over packs, disclosure, curation, facts and symbols, each with its SQL where SQL can express it.

Sessions are all conversations, and literal rows with the trigger words that their prose may lack.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions.events import CODE_PATHS, code_paths
from ..operators import context as P
from ..operators import curate as C
from ..operators import evidence as E
from ..operators import records as R
from ..operators import search as X
from ..operators import sessions as S
from ..sources import views as V
from .records import TOKENS
from .retrieval import HEAD, hybrid_sql, rerank_sql, searched
from .sessions import count_sql, quoted

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def by(df, key):
    """``df`` in order of a number, the greatest first, then by id: rank."""
    return df.withColumn("rank", F.struct((-key.cast("double")).alias("k"), F.col("id").alias("i")))


def pack_parts(spark, d, level):
    """The candidates of a level, as they are: their number is bounded by the pack (context.within_budget)."""
    m = V.memories(spark, d).withColumn("updated_at", F.col("created_at"))
    newest = F.unix_micros(F.col("created_at").cast("timestamp"))
    parts = {"constraint": by(R.active_constraints(m), newest), "warning": by(R.warnings(m), newest)}
    if level == "deep":
        parts["hot"] = by(R.heatmap(m, V.now(), 10), F.col("heat"))
        parts["query"] = by(X.planned(searched(spark, d, 50), P.S.PLANS["general"], V.now()), F.col("score"))
        parts["history"] = by(R.history_within(m, 3000), newest)
    return P.candidates(parts)


@query("pack_progressive")
def pack_progressive(spark, d):
    """The deep pack: constraints, warnings, hot, found, and past memories under one budget."""
    return P.progressive(pack_parts(spark, d, "deep"), "deep", budget=6000)


@query("pack_minimal")
def pack_minimal(spark, d):
    return P.progressive(pack_parts(spark, d, "minimal"), "minimal", budget=1500)


PACKED = f"""{HEAD}{hybrid_sql(50)}, {rerank_sql("general").replace(" SELECT id, round(", " , rr AS (SELECT id, round(", 1)}),
 limits AS (SELECT id, {TOKENS} + 20 AS tokens FROM memories WHERE status = 'active' AND object_type = 'constraint'),
 rq AS (SELECT m.id, {TOKENS} + 20 AS tokens, row_number() OVER (ORDER BY rr.score DESC, m.id) AS rank FROM rr JOIN memories m ON m.id = rr.id WHERE object_type <> 'constraint'),
 f AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS tokens, false AS included, CAST(60000 - (SELECT coalesce(sum(tokens), 0) FROM limits) AS BIGINT) AS remaining UNION ALL
  SELECT rq.rank, rq.id, CAST(rq.tokens AS BIGINT), rq.tokens <= f.remaining, CASE WHEN rq.tokens <= f.remaining THEN f.remaining - CAST(rq.tokens AS BIGINT) ELSE f.remaining END FROM f JOIN rq ON rq.rank = f.rank + 1)
 SELECT 'constraint' AS part, id, CAST(tokens AS BIGINT) AS tokens FROM limits UNION ALL SELECT 'relevant', id, tokens FROM f WHERE included"""


@query("pack_with_constraints", PACKED.replace("WITH ", "WITH RECURSIVE ", 1))
def pack_with_constraints(spark, d):
    m = V.memories(spark, d)
    hits = X.reranked(searched(spark, d, 50), V.now()).withColumn("score", F.round("score", 6))
    order = Window.orderBy(F.desc("score"), "id")  # at most 50 results
    return X.context_pack(m, hits.withColumn("rank", F.row_number().over(order)), 60_000)


@query(
    "disclosed",
    f"""WITH {V.MEMORIES_SQL}, n AS (SELECT * FROM memories WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 50),
 f AS (SELECT id, object_type, row_number() OVER (ORDER BY CASE WHEN object_type IN ('constraint','known_fix','failed_attempt') THEN 0 ELSE 1 END, created_at DESC, id) AS place FROM n WHERE id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0)) SELECT CAST(place AS INTEGER) AS place, id, object_type FROM f WHERE place <= 15""",
)
def disclosed(spark, d):
    seen = V.read(spark, d, "labels").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    return P.disclosed(V.memories(spark, d), seen, "deep", "error_burst")


@query(
    "escalation",
    f"""WITH {V.LOG_SQL}, s AS (SELECT session_id, count(*) FILTER (event_type = 'error') % 7 AS errors, count(*) % 25 AS since, count(*) AS total FROM log GROUP BY 1)
 SELECT session_id, CASE WHEN errors >= 3 THEN 'error_burst' ELSE 'event_threshold' END AS trigger, round(CASE WHEN errors >= 3 THEN least(1.0::DOUBLE, errors / 5.0::DOUBLE) ELSE 0.5 END, 6) AS confidence, CASE WHEN errors >= 3 OR total >= 75 THEN 'deep' ELSE 'task' END AS level FROM s WHERE errors >= 3 OR since >= 15""",
)
def escalation(spark, d):
    none = F.lit(None).cast("string")
    s = V.log(spark, d).groupBy("session_id").agg((F.count_if(F.col("event_type") == "error") % 7).alias("error_count"), (F.count("*") % 25).alias("events_since_checkpoint"), F.count("*").alias("events_count"))
    s = s.select("*", none.alias("query"), none.alias("file"), none.alias("previous_topic"), F.lit(None).cast("timestamp_ntz").alias("last_disclosure_at"))
    return P.escalation(s, V.now()).withColumn("confidence", F.round("confidence", 6))


EVENTS = (
    (1, 1, 0, "user_prompt", "Never use any casts in this code base.", None, None), (1, 2, 10, "tool_output", "Error: cannot find module x\n at y", "bash", 1), (1, 3, 20, "turn", "Fixed by installing the missing package.", None, None),
    (1, 4, 60, "tool_output", "ok", "bash", 0), (1, 5, 600, "tool_output", "Error: late failure\n", "bash", 2), (1, 6, 1800, "tool_output", "ok", "edit", 0), (2, 10, 3600, "turn", "We are using pytest for tests.", None, None),
    (2, 11, 3601, "turn", "We are using pytest for tests.", None, None), (2, 12, 3602, "turn", "We are using pytest for tests.", None, None), (2, 20, 3900, "user_prompt", "No, you should keep the helper in one place.", None, None),
    (2, 21, 4000, "turn", "Always use the shared client because it must never open two connections.", None, None),
)


FIRST_SESSION, FIRST_EVENT = 100, 1_000_000
#: What turns say before their own text, by (8 conv_id + turn) % 13; # stands for the conversation. Every fifth conversation repeats REPEATED instead.
SAYINGS = ("Error: cannot find module m#", "Fixed by installing package p#.", "No, you should keep helper h# in one place.", "Never use casts in module m#.", "Always use the shared client c# because it must never open two connections.", "I decided to use the cache in src/m#/index.ts because it is faster.")
REPEATED = "We are using pytest for tests."


def events(spark, d):
    """Literal events, and every turn as one: an assistant's, in two of three sessions, is a tool's output, and every second of these succeeds."""
    rows = spark.createDataFrame(list(EVENTS), "session_id long, event_id long, at long, event_type string, content string, tool_name string, exit_code int")
    pos = F.col("pos")
    tool = (F.col("role") == "assistant") & (F.col("session_id") % 3 != 0)
    said = F.when(F.col("session_id") % 5 == 0, REPEATED)
    for i, saying in enumerate(SAYINGS):
        said = said.when((F.col("session_id") * 8 + pos) % 13 == i, F.replace(F.lit(saying), F.lit("#"), F.col("session_id").cast("string")))
    turns = V.turns(spark, d).withColumn("content", F.concat_ws("\n", said, "content")).select(
        (F.col("session_id") + FIRST_SESSION).alias("session_id"), (F.col("session_id") * 1000 + pos + FIRST_EVENT).alias("event_id"), (pos * 40).cast("long").alias("at"),
        F.when(F.col("role") == "user", "user_prompt").when(tool, "tool_output").otherwise("turn").alias("event_type"), "content",
        F.when(tool, F.when(pos % 4 == 1, "bash").otherwise("edit")).alias("tool_name"), F.when(tool, (F.floor(pos / 2) + F.col("session_id")) % 2).cast("int").alias("exit_code"),
    )
    return rows.unionByName(turns).withColumn("ts", F.timestamp_seconds("at"))


def literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else quoted(v).replace("\n", "' || chr(10) || '")


SAID_FIRST = f"CASE WHEN conv_id % 5 = 0 THEN {quoted(REPEATED)} " + " ".join(f"WHEN (conv_id * 8 + turn) % 13 = {i} THEN replace({quoted(x)}, '#', CAST(conv_id AS VARCHAR))" for i, x in enumerate(SAYINGS)) + " END"
EV = f"""ev AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(literal, e)) + ")" for e in EVENTS)}) v(session_id, event_id, sec, event_type, content, tool_name, exit_code)
 UNION ALL SELECT conv_id + {FIRST_SESSION}, conv_id * 1000 + turn + {FIRST_EVENT}, turn * 40, CASE WHEN role = 'user' THEN 'user_prompt' WHEN role = 'assistant' AND conv_id % 3 <> 0 THEN 'tool_output' ELSE 'turn' END, concat_ws(chr(10), {SAID_FIRST}, text),
 CASE WHEN role = 'assistant' AND conv_id % 3 <> 0 THEN CASE WHEN turn % 4 = 1 THEN 'bash' ELSE 'edit' END END, CASE WHEN role = 'assistant' AND conv_id % 3 <> 0 THEN (turn // 2 + conv_id) % 2 END FROM conversations)"""


def first_of(patterns, group: int, flags: str = "") -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(content, {quoted(flags + p)}, {group})), '')" for p in patterns) + ")"


def ahead(condition: str, said: str) -> str:
    """The next event of the session that meets a condition."""
    return f"first_value(CASE WHEN {condition} THEN {{'sec': sec, 'id': event_id, 'said': {said}}} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY sec, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


FIXED = f"""told AS (SELECT *, substr({first_of(C.FIXES, 1, "(?i)")}, 1, 300) AS how FROM ev),
 ahead AS (SELECT *, {ahead("event_type = 'tool_output' AND exit_code = 0", "tool_name")} AS ok, {ahead("how IS NOT NULL", "how")} AS say FROM told),
 failed AS (SELECT *, substr({first_of(C.SIGNATURES, 1)}, 1, 200) AS signature, CASE WHEN say.sec < ok.sec OR (say.sec = ok.sec AND say.id < ok.id) THEN say.said WHEN ok.said IN ('edit', 'write') THEN 'Applied ' || ok.said || ' operation' END AS fix FROM ahead
 WHERE event_type = 'tool_output' AND exit_code <> 0 AND ok.sec - sec <= 300),
 fixes AS (SELECT session_id, event_id AS error_id, ok.id AS success_id, signature, fix FROM failed WHERE signature IS NOT NULL AND fix IS NOT NULL)"""
PHRASES = " UNION ALL ".join(f"SELECT session_id, nullif(trim(lower(regexp_extract(content, {quoted('(?i)' + p)}, 0))), '') AS phrase FROM ev" for p in C.CONVENTIONS)
HABITS = f"phrases AS ({PHRASES}), habits AS (SELECT session_id, phrase, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'high' ELSE 'medium' END AS confidence FROM phrases WHERE phrase IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)"


def corrected_sql(severity: str, pattern: str) -> str:
    opens = f" AND regexp_matches(content, {quoted('(?i)' + L.CORRECTION)})" if severity == "should" else ""
    return f"SELECT session_id, event_id, trim(regexp_extract(content, {quoted('(?i)' + pattern)}, 0)) AS content, '{severity}' AS severity FROM ev WHERE event_type IN ('turn', 'user_prompt') AND regexp_matches(content, {quoted('(?i)' + pattern)}){opens}"


CORRECTED = "corrected AS (" + " UNION ALL ".join(corrected_sql(s, p) for s, ps in (("must", L.MUST), ("should", L.SHOULD)) for p in ps) + ")"
CURATED = f"""{EV}, {FIXED}, {HABITS}, {CORRECTED}, made AS (SELECT session_id, error_id AS event_id, 'Error: ' || signature || ' Fix: ' || fix AS content, 'known_fix' AS object_type, 'high' AS confidence FROM fixes
 UNION ALL SELECT session_id, event_id, content, 'constraint', CASE WHEN severity = 'must' THEN 'high' ELSE 'medium' END FROM corrected UNION ALL SELECT session_id, NULL, phrase, 'convention', confidence FROM habits),
 merged AS (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY substr(lower(content), 1, 100) ORDER BY list_position(['certain', 'high', 'medium', 'low'], confidence), event_id NULLS LAST, content, session_id) = 1)"""


@query("known_fixes", f"WITH {EV}, {FIXED} SELECT * FROM fixes")
def known_fixes(spark, d):
    return C.known_fixes(events(spark, d))


@query("repeated_phrases", f"WITH {EV}, {HABITS} SELECT * FROM habits")
def repeated_phrases(spark, d):
    return C.repeated_patterns(events(spark, d))


@query("curated_candidates", f"WITH {CURATED} SELECT * FROM merged")
def curated_candidates(spark, d):
    return C.merged(C.curated(events(spark, d)))


VOTES = ", ".join(f"{count_sql(ps)} AS v_{n}" for n, ps in L.EXTRACTION.items())
MOST = f"greatest({', '.join('v_' + n for n in L.EXTRACTION)})"
WINNER = " ".join(f"WHEN v_{n} = {MOST} THEN '{n}'" for n in L.EXTRACTION)
VOTED = f"voted AS (SELECT *, {MOST} AS top, CASE {WINNER} END AS object_type FROM (SELECT *, {VOTES} FROM kept) WHERE {MOST} > 0)"
MARKED = r"regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g')"
PIECE = r"regexp_replace(piece, '^\s+|\s+$', '', 'g')"


def squeezed(code: str) -> str:
    return rf"substr(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '(?s)```.*?```', '{code}', 'g')), 1, 500)"


BOTH_CUTS = rf"list_concat(string_split({MARKED}, chr(1)), regexp_split_to_array(content, '\n+'))"
ONE_CUT = rf"string_split(regexp_replace({MARKED}, '\n+', chr(1), 'g'), chr(1))"


@query(
    "session_candidates",
    rf"""WITH {EV}, cut AS (SELECT session_id, sec, event_id, unnest({BOTH_CUTS}) AS piece, generate_subscripts({BOTH_CUTS}, 1) AS i FROM ev WHERE content IS NOT NULL),
 kept AS (SELECT session_id, sec, event_id, {PIECE} AS text, min(i) AS i FROM cut WHERE length({PIECE}) > 10 GROUP BY 1, 2, 3, 4), {VOTED},
 said AS (SELECT session_id, sec, event_id, i, object_type, {squeezed('[code block]')} AS content, CASE WHEN top >= 3 THEN 'high' WHEN top = 2 THEN 'medium' ELSE 'low' END AS confidence FROM voted)
 SELECT session_id, event_id, content, object_type, confidence FROM said QUALIFY row_number() OVER (PARTITION BY session_id, trim(regexp_replace(substr(lower(content), 1, 50), '\s+', ' ', 'g')) ORDER BY sec, event_id, i) = 1""",
)
def session_candidates(spark, d):
    return C.session_candidates(events(spark, d))


# RE2 has no look-ahead: what must not follow is spelt out
EXCLUDED_SQL = " OR ".join(f"regexp_matches(text, {quoted(p.replace('#(?!' + chr(92) + 's)', '#([^' + chr(92) + 's]|$)'))})" for p in C.EXCLUDED)
ACTIONABLE_SQL = " OR ".join(f"regexp_matches(text, {quoted('(?i)' + p)})" for p in C.ACTIONABLE)


@query(
    "realtime_candidates",
    rf"""WITH {EV}, cut AS (SELECT session_id, sec, event_id, event_type, unnest({ONE_CUT}) AS piece, generate_subscripts({ONE_CUT}, 1) AS i FROM ev WHERE length(content) >= {C.LEAST_CHARS}),
 long AS (SELECT session_id, sec, event_id, event_type, i, {PIECE} AS text FROM cut WHERE length({PIECE}) >= {C.LEAST_CHARS}),
 kept AS (SELECT * FROM long WHERE NOT ({EXCLUDED_SQL} OR len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 1)) < {C.LEAST_WORDS}
  OR (len(regexp_extract_all(text, '[a-zA-Z]')) > 0 AND len(regexp_extract_all(text, '[{{}}()\[\];:=<>]')) / len(regexp_extract_all(text, '[a-zA-Z]')) > 0.3)
  OR (regexp_matches(text, '^[a-z]+\s+[a-z-]+\s*') AND NOT contains(text, ' because') AND NOT contains(text, ' to '))) AND ({ACTIONABLE_SQL})), {VOTED},
 sure AS (SELECT session_id, sec, event_id, i, object_type, CASE WHEN top >= 2 THEN 'high' ELSE 'medium' END AS confidence, {squeezed('[code]')} AS content FROM voted WHERE NOT (event_type IN ('tool_output', 'tool_call') AND top < 2)),
 few AS (SELECT * FROM sure QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY i) <= {C.PER_EVENT})
 SELECT session_id, event_id, content, object_type, confidence FROM few QUALIFY row_number() OVER (PARTITION BY session_id, lower(content) ORDER BY sec, event_id, i) = 1""",
)
def realtime_candidates(spark, d):
    return C.realtime_candidates(events(spark, d))


@query("applied_candidates")
def applied_candidates(spark, d):
    """Candidates of all sessions, one after the other, into the memories."""
    made = C.session_candidates(events(spark, d)).withColumn("candidate_id", F.xxhash64("session_id", "event_id", "content"))
    return C.applied(made, V.memories(spark, d))


MOMENTS = {"explicit_decision": S.DECIDED, "user_correction": S.CORRECTED, "architecture_pattern": S.PATTERNED}
SAID = ", ".join(f"CAST(max(CAST(contains(lower(content), {quoted(p)}) AS INTEGER)) AS INTEGER) AS {name}_{i}" for name, ps in MOMENTS.items() for i, p in enumerate(ps))
SUMS = ", ".join(f"({' + '.join(f'{name}_{i}' for i in range(len(ps)))}) >= {2 if name == 'architecture_pattern' else 1} AS {name}" for name, ps in MOMENTS.items())


@query(
    "learning_moments",
    f"""WITH {EV}, said AS (SELECT session_id, {SAID} FROM ev GROUP BY 1), codes AS (SELECT session_id, exit_code, max(CASE WHEN exit_code <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY sec, event_id) AS failed FROM ev),
 won AS (SELECT session_id, coalesce(bool_or(exit_code = 0 AND failed = 1), false) AS error_resolution FROM codes GROUP BY 1) SELECT session_id, error_resolution, {SUMS} FROM said JOIN won USING (session_id)""",
)
def learning_moments(spark, d):
    return S.learning_moments(events(spark, d))


@query("event_corrections", f"WITH {EV}, {CORRECTED} SELECT * FROM corrected")
def event_corrections(spark, d):
    """What users and assistants correct, in all events."""
    return C.corrections(events(spark, d))


EVENT_PATHS = " UNION ALL ".join(f"SELECT event_id, unnest(regexp_extract_all(content, {quoted(p)}, 1)) AS path FROM ev" for p in CODE_PATHS)


@query("event_paths", f"WITH {EV}, f AS ({EVENT_PATHS}) SELECT DISTINCT event_id, regexp_replace(path, '^\\./', '') AS path FROM f WHERE length(path) BETWEEN 3 AND 199")
def event_paths(spark, d):
    """Source files that events name."""
    return events(spark, d).select("event_id", F.explode(code_paths(F.col("content"))).alias("path"))


FACTS_SAID = ("I went to the museum of town # yesterday.", "My field is counseling.", "I really love painting.", "Tom got a dog last week!", "We plan to travel to town #.")


@query("facts")
def facts(spark, d):
    """Facts that all conversations tell: every turn's own text after a saying by its place."""
    n = F.col("session_id") * 8 + F.col("pos")
    said = F.lit(None).cast("string")
    for i, saying in enumerate(FACTS_SAID):
        said = F.when(n % 7 == i, F.replace(F.lit(saying), F.lit("#"), F.col("session_id").cast("string"))).otherwise(said)
    day = F.date_format(F.date_add(F.lit("2023-05-01").cast("date"), (F.col("session_id") % 200).cast("int")), "yyyy-MM-dd")
    turns = V.turns(spark, d).select(n.alias("message_id"), F.when(F.col("role") == "user", "Caroline").otherwise("Mel").alias("speaker"), F.concat_ws(" ", said, "content").alias("content"), day.alias("session_date"))
    return C.facts(turns)


SCRIPT_SAID, PYTHON_SAID = "export async function load#(a) {\n}\nclass Store# {\n}\nexport type Id#<T> = string\nconst size# = 1\n", "class A#:\n    def run#(self):\n        pass\ndef _own#():\n"


def first_kind(rules, group: int) -> str:
    """The kind (or a group) of the first rule that a line meets."""
    return " ".join(f"WHEN regexp_matches(line, {quoted(p)}) THEN " + (quoted(k) if group == 0 else f"regexp_extract(line, {quoted(p)}, {group})") for k, p in rules)


def symbol_sql(ending: str, rules, exported: str) -> str:
    return f"SELECT path, CASE {first_kind(rules, 2)} END AS name, CASE {first_kind(rules, 0)} END AS kind, CAST(line_no AS INTEGER) AS line, {exported} AS exported FROM lines WHERE path LIKE '%{ending}'"


literal_lines = lambda x: quoted(x).replace("\n", "' || chr(10) || '")
SYMBOLS = f"""WITH files AS (SELECT 'src/f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.txt' END AS path,
  string_split(replace(CASE doc_id % 3 WHEN 1 THEN {literal_lines(PYTHON_SAID)} ELSE {literal_lines(SCRIPT_SAID)} END, '#', CAST(doc_id AS VARCHAR)) || text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
 lines AS (SELECT path, ls[line_no] AS line, line_no FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS line_no FROM files)),
 found AS ({symbol_sql('.ts', E.SCRIPT, f"(CASE {first_kind(E.SCRIPT, 1)} END) <> ''")} UNION ALL {symbol_sql('.py', E.PYTHON, f"NOT starts_with(CASE {first_kind(E.PYTHON, 2)} END, '_')")})
 SELECT * FROM found WHERE kind IS NOT NULL"""


@query("symbols", SYMBOLS)
def symbols(spark, d):
    """Symbols of source files, one for each document: declarations before its text."""
    i = F.col("doc_id")
    said = F.replace(F.when(i % 3 == 1, PYTHON_SAID).otherwise(SCRIPT_SAID), F.lit("#"), i.cast("string"))
    path = F.concat(F.lit("src/f"), i.cast("string"), F.when(i % 3 == 0, ".ts").when(i % 3 == 1, ".py").otherwise(".txt"))
    return E.symbols(V.read(spark, d, "documents").filter("text is not null").select(path.alias("path"), F.concat(said, "text").alias("text")))
