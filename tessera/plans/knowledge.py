"""Queries over contradictions, conflicts, review, evidence and the change log, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compaction
from ..operators import conflicts as C
from ..operators import evidence as E
from ..operators import lifecycle as K
from ..operators import records as R
from ..sources import views as V
from ..sources.store import shared_folder
from .records import TIER, TOKENS

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


M = V.MEMORIES_SQL
# id, type, day of creation, text
CLAIMS = (
    (1, "convention", 1, "Use tabs for indentation in every file"), (2, "convention", 1, "Never use tabs for indentation in any file"), (3, "decision", 2, "We decided to use postgresql for storage"),
    (4, "decision", 9, "Always prefer mongodb for document storage"), (5, "preference", 3, "Enable strict checks for every build"), (6, "preference", 3, "Disable strict checks for every build"),
    (7, "decision", 1, "The cache layer keeps recent search results in memory"), (8, "decision", 20, "The cache layer keeps recent search results in memory today"), (9, "known_fix", 4, "Restart the worker after a deploy"),
    (10, "constraint", 5, "Use npm for installs"), (11, "constraint", 6, "Use pnpm for installs"), (12, "environment", 7, "The server runs linux"),
)
CLAIMS_SQL = "claims(id, object_type, day, content) AS (VALUES " + ", ".join(f"({i}, '{t}', {d}, '{c}')" for i, t, d, c in CLAIMS) + ")"


#: Days of documents as memories.
DOC_DAYS = 30


def claims(spark, d):
    """Literal claims with ids below 0, and every document."""
    own = literal_claims(spark)
    i = F.col("doc_id")
    docs = V.read(spark, d, "documents").select(
        i.alias("id"), V.nth(V.OBJECT_TYPES, i % 7).alias("object_type"), F.col("text").alias("content"), F.lit("active").alias("status"), F.lit("observed").alias("tier"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), (i % DOC_DAYS + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"), F.lit(None).cast("long").alias("superseded_by"),
    )
    return own.withColumn("id", -F.col("id")).unionByName(docs)


def literal_claims(spark):
    rows = spark.createDataFrame(list(CLAIMS), "id long, object_type string, day int, content string")
    return rows.select("id", "object_type", "content", F.lit("active").alias("status"), F.lit("observed").alias("tier"), F.expr("make_timestamp_ntz(2024, 1, day, 0, 0, 0)").alias("created_at"), F.lit(None).cast("long").alias("superseded_by"))


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def contradiction_sql() -> str:
    flags = ", ".join(f"list_filter({listed(g)}, lambda c: contains(l, c)) AS c{i}" for i, g in enumerate(C.CHOICES))
    implicit = " OR ".join(f"(len(x.c{i}) > 0 AND len(y.c{i}) > 0 AND x.c{i} <> y.c{i})" for i in range(len(C.CHOICES)))
    antonyms = ", ".join(f"({i}, '{x}', '{y}')" for i, (x, y) in enumerate(C.ANTONYMS))
    return f"""WITH {CLAIMS_SQL}, m AS (SELECT -id AS id, object_type, day, content FROM claims UNION ALL SELECT doc_id, (['decision','preference','convention','known_fix','constraint','failed_attempt','environment'])[doc_id % 7 + 1], doc_id % {DOC_DAYS} + 1, text FROM documents),
 w0 AS (SELECT *, lower(content) AS l, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2)) AS ws FROM m),
 w AS (SELECT id, object_type IN ('decision', 'convention', 'preference') AS timed, day, ws, len(ws) AS n, len(list_filter({listed(C.NEGATIONS)}, lambda n: contains(l, n))) > 0 AS neg, regexp_matches(l, '{C.RECOMMENDS}') AS rec, {flags} FROM w0),
 u AS (SELECT id, n, unnest(ws) AS word FROM w), p AS (SELECT x.id AS a, y.id AS b, count(*) / (any_value(x.n + y.n) - count(*))::DOUBLE AS alike FROM u x JOIN u y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2),
 direct AS (SELECT a, b FROM p JOIN w x ON x.id = a JOIN w y ON y.id = b WHERE x.neg <> y.neg AND alike > 0.4),
 an(i, one, two) AS (VALUES {antonyms}), sides AS (SELECT id, i, one, two, list_contains(ws, one) AS h1, list_contains(ws, two) AS h2, list_filter(ws, lambda z: z <> one AND z <> two) AS rest FROM w, an WHERE list_contains(ws, one) OR list_contains(ws, two)),
 opposite AS (SELECT DISTINCT x.id AS a, y.id AS b FROM sides x JOIN sides y ON x.i = y.i AND x.id < y.id WHERE ((x.h1 AND y.h2) OR (x.h2 AND y.h1)) AND len(x.rest) > 0 AND len(y.rest) > 0 AND len(list_intersect(x.rest, y.rest)) / len(list_distinct(list_concat(x.rest, y.rest)))::DOUBLE > 0.3),
 implicit AS (SELECT x.id AS a, y.id AS b FROM w x JOIN w y ON x.id < y.id AND x.rec AND y.rec WHERE {implicit}),
 temporal AS (SELECT a, b FROM p JOIN w x ON x.id = a JOIN w y ON y.id = b WHERE x.timed AND y.timed AND alike >= 0.5 AND abs(x.day - y.day) >= 1),
 k AS (SELECT a, b, 0 AS o FROM direct UNION ALL SELECT a, b, 0 FROM opposite UNION ALL SELECT a, b, 1 FROM implicit UNION ALL SELECT a, b, 2 FROM temporal)
 SELECT a, b, (['direct', 'implicit', 'temporal'])[min(o) + 1] AS kind FROM k GROUP BY 1, 2"""


@query("contradictions", contradiction_sql())
def contradictions(spark, d):
    return C.contradictions(claims(spark, d)).select("a", "b", "kind")


def oppose_sql(a: str, b: str) -> str:
    q = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    return " OR ".join(f"(regexp_matches({a}, {q(y)}) AND regexp_matches({b}, {q(n)})) OR (regexp_matches({a}, {q(n)}) AND regexp_matches({b}, {q(y)}))" for y, n in C.OPPOSED)


KIN = " OR ".join(f"(ct = '{t}' AND et IN ({', '.join(map(repr, others))}))" for t, others in C.RELATED_TYPES.items())
BAG = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\w\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 2))"


@query(
    "similar_memories",
    f"""WITH {M}, b AS (SELECT id, {BAG.format('content')} AS ws FROM memories), w AS (SELECT *, max(id) OVER (PARTITION BY list_sort(ws)) AS rep FROM b WHERE len(ws) > 0), u AS (SELECT id, len(ws) AS n, unnest(ws) AS word FROM w WHERE id = rep),
 p AS (SELECT x.id AS a, y.id AS b, count(*) AS c, any_value(x.n + y.n) AS s FROM u x JOIN u y ON x.word = y.word AND x.id < y.id AND y.n BETWEEN x.n * 0.79 AND x.n / 0.79 GROUP BY 1, 2)
 SELECT a, b, round(c / (s - c)::DOUBLE, 6) AS similarity FROM p WHERE c / (s - c)::DOUBLE >= 0.8 UNION ALL SELECT id, rep, 1.0 FROM w WHERE id <> rep""",
)
def similar_memories(spark, d):
    """Pairs of memories that are alike; of equal word sets the newest stands for all, with the others as its pairs."""
    return C.similar_pairs(V.memories(spark, d)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "review_suggestions",
    f"""WITH {M}, p AS (SELECT m.id, m.content, m.confidence, m.object_type, count(o.id) AS n, count(*) FILTER (o.object_type = m.object_type) AS same FROM memories m LEFT JOIN memories o ON o.content = m.content AND o.id <> m.id WHERE m.review_status = 'pending' GROUP BY ALL)
 SELECT id, CASE WHEN confidence = 'low' THEN 'reject' WHEN length(content) > 500 OR length(content) < 20 THEN 'edit' WHEN same > 0 THEN 'merge' WHEN n > 0 THEN 'supersede' ELSE 'approve' END AS action FROM p""",
)
def review_suggestions(spark, d):
    memories = V.memories(spark, d)
    pending = memories.filter("review_status = 'pending'").select("id", "content", "confidence", "object_type")
    other = memories.select(F.col("id").alias("o_id"), F.xxhash64("content").alias("h"), F.col("content").alias("o_content"), F.col("object_type").alias("other_type"))
    same = pending.select("id", F.xxhash64("content").alias("p_h"), F.col("content").alias("p_content")).join(other, (F.col("h") == F.col("p_h")) & (F.col("p_content") == F.col("o_content")) & (F.col("id") != F.col("o_id"))).select("id", "other_type")
    return C.review_suggestions(pending, same).select("id", "action")


@query("review_actions", f"""WITH {M} SELECT id, CASE id % 11 WHEN 4 THEN 'retired' WHEN 2 THEN 'superseded' WHEN 3 THEN 'superseded' ELSE status END AS status, CASE WHEN id % 11 IN (0, 1) THEN 'approved' WHEN id % 11 = 4 THEN 'rejected' ELSE review_status END AS review_status, CASE WHEN id % 11 IN (2, 3) THEN id + 1 END AS superseded_by FROM memories""")
def review_actions(spark, d):
    memories = V.memories(spark, d).select("id", "status", "review_status")
    n = F.col("id") % 11
    action = F.when(n == 0, "approve").when(n == 1, "edit").when(n == 2, "merge").when(n == 3, "supersede").when(n == 4, "reject").otherwise("skip")
    return C.reviewed(memories, memories.select("id", action.alias("action"), (F.col("id") + 1).alias("by")))


def code_tables(spark, d):
    """Memories with references, and the files, changes and symbols of the code, by arithmetic."""
    m = V.memories(spark, d)
    i = F.col("id")
    ref = F.struct(F.concat(F.lit("src/f"), (i % 50).cast("string")).alias("path"), F.lit("symbol").alias("type"), F.when(i % 2 == 0, F.concat(F.lit("s"), (i % 30).cast("string"))).alias("symbol"))
    m = m.withColumn("code_refs", F.when(F.col("n_refs") > 0, F.array(ref)).otherwise(F.array().cast("array<struct<path:string,type:string,symbol:string>>")))
    numbers = spark.range(50).withColumn("path", F.concat(F.lit("src/f"), F.col("id").cast("string")))
    changes = numbers.filter("id % 3 = 0").select("path", (V.now() - V.days_ago((F.col("id") % 15).cast("int"))).alias("changed_at"))
    known = numbers.crossJoin(spark.range(25).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"))).select("path", "name")  # a fixture of 1250 rows
    return m, numbers.filter("id % 7 <> 0").select("path"), changes, known


STALE = f"""m AS (SELECT id, object_type, last_verified_at, id % 50 AS f, CASE WHEN id % 2 = 0 THEN id % 30 END AS s FROM memories WHERE n_refs > 0),
 l AS (SELECT *, CASE WHEN f % 7 = 0 OR s >= 25 THEN 'stale' WHEN f % 3 = 0 AND TIMESTAMP '{V.NOW}' - to_days(CAST(f % 15 AS INTEGER)) > last_verified_at THEN 'needs_review' ELSE 'verified' END AS level FROM m)"""


@query("staleness_levels", f"WITH {M}, {STALE} SELECT id AS memory_id, level FROM l")
def staleness_levels(spark, d):
    m, files, changes, known = code_tables(spark, d)
    return E.staleness(E.checked_references(E.references(m), files, changes, known)).select("memory_id", "level")


@query("staleness_summary", f"WITH {M}, {STALE} SELECT level, count(*) AS n FROM l GROUP BY 1")
def staleness_summary(spark, d):
    m, files, changes, known = code_tables(spark, d)
    return E.staleness_summary(E.staleness(E.checked_references(E.references(m), files, changes, known)))


@query("revalidation", f"""WITH {M}, {STALE} SELECT m.id, (CASE WHEN level = 'stale' THEN 3 WHEN level = 'needs_review' THEN 2 ELSE 1 END + CASE m.object_type WHEN 'constraint' THEN 1 WHEN 'decision' THEN 0.5 ELSE 0 END)::DOUBLE AS priority
 FROM memories m LEFT JOIN l ON l.id = m.id WHERE level IN ('stale', 'needs_review') OR m.last_verified_at IS NULL""")
def revalidation(spark, d):
    m, files, changes, known = code_tables(spark, d)
    return E.revalidation(m, E.staleness(E.checked_references(E.references(m), files, changes, known))).select("id", "priority")


@query("auto_verified", f"WITH {M}, {STALE} SELECT m.id, strftime(CASE WHEN level = 'verified' THEN TIMESTAMP '{V.NOW}' ELSE m.last_verified_at END, '%Y-%m-%d') AS verified FROM memories m LEFT JOIN l ON l.id = m.id")
def auto_verified(spark, d):
    m, files, changes, known = code_tables(spark, d)
    levels = E.staleness(E.checked_references(E.references(m), files, changes, known))
    return E.auto_verified(m, levels, V.now()).select("id", F.date_format("last_verified_at", "yyyy-MM-dd").alias("verified"))


@query("snapshots", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash, length(text) AS size, len(string_split(text, chr(10))) AS lines, substr(sha256(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10))), 1, 16) AS range_hash FROM documents")
def snapshots(spark, d):
    docs = V.read(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    ranges = docs.select(F.col("path").alias("r"), E.line_range_hash(F.col("text"), F.lit(2), F.lit(4)).alias("range_hash"))
    shots = E.snapshots(docs).join(ranges, F.col("path") == F.col("r"))
    return shots.select(F.col("path").alias("doc_id"), "hash", F.col("size").cast("long").alias("size"), F.col("lines").cast("long").alias("lines"), "range_hash")


CHANGED = """WITH c AS (SELECT user_id AS id, event_id AS version, CASE event_type WHEN 'error' THEN 'stale' WHEN 'view' THEN 'verify' WHEN 'click' THEN 'approve' WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'delete' ELSE 'update' END ELSE 'reject' END AS op, CASE WHEN event_type = 'purchase' THEN value END AS value FROM events),
 a AS (SELECT id, version, op, value, CASE op WHEN 'stale' THEN 'stale' WHEN 'verify' THEN 'active' WHEN 'reject' THEN 'retired' END AS status, CASE op WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' END AS review_status FROM c)
 SELECT id, max(version) AS version, arg_max(status, version) FILTER (status IS NOT NULL) AS status, arg_max(review_status, version) FILTER (review_status IS NOT NULL) AS review_status, arg_max(value, version) FILTER (value IS NOT NULL) AS value FROM a GROUP BY 1 HAVING arg_max(op, version) <> 'delete'"""
CHANGED_COLUMNS = ["status", "review_status", "value"]


def changes_of(spark, d):
    kind = F.col("event_type")
    op = F.when(kind == "error", "stale").when(kind == "view", "verify").when(kind == "click", "approve").when(kind == "purchase", F.when(F.col("event_id") % 4 == 0, "delete").otherwise("update")).otherwise("reject")
    none = F.lit(None).cast("string")
    return V.read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), op.alias("op"), F.when(kind == "purchase", F.col("value")).alias("value"), none.alias("status"), none.alias("review_status"))


@query("change_log_state", CHANGED)
def change_log_state(spark, d):
    return K.current(changes_of(spark, d), CHANGED_COLUMNS)


@query("state_from_snapshot", CHANGED)
def state_from_snapshot(spark, d):
    """The same state from a snapshot of the first two thirds of the log, made twice, and the changes since."""
    changes = changes_of(spark, d)
    path, block = f"{shared_folder(spark)}/log-{uuid.uuid4().hex[:12]}", 1000
    upto = changes.agg(F.max("version")).first()[0] * 2 // 3
    compaction.append(changes.filter(F.col("version") <= upto), path, block)
    for _ in range(2):
        compaction.compact(spark, path, changes.schema, CHANGED_COLUMNS, block=block)
    compaction.append(changes.filter(F.col("version") > upto), path, block)
    return compaction.state(spark, path, changes.schema, CHANGED_COLUMNS, block)


@query("reinforced", f"WITH {M}, a AS (SELECT user_id * 3 AS id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) SELECT m.id, access_count + coalesce(n, 0) AS access_count, round(least(1.0, strength + coalesce(n, 0) * 0.15::DOUBLE), 6) AS strength FROM memories m LEFT JOIN a ON a.id = m.id")
def reinforced(spark, d):
    seen = V.read(spark, d, "events").filter("event_type = 'view'").select((F.col("user_id") * 3).alias("id"), F.col("ts").alias("accessed_at"))
    return K.accessed(V.memories(spark, d), seen).select("id", "access_count", F.round("strength", 6).alias("strength"))


@query("blob_split", f"WITH {M}, s AS (SELECT id, substr(sha256(content), 1, 16) AS hash, {TOKENS} AS tokens FROM memories) SELECT id, tokens, CASE WHEN tokens > 1000 THEN hash END AS blob_id, tokens <= 1000 AS inline FROM s")
def blob_split(spark, d):
    events, _ = K.split_blobs(V.memories(spark, d).select("id", "content"))
    return events.select("id", F.col("token_count").alias("tokens"), "blob_id", F.col("content").isNotNull().alias("inline"))


@query("quality_advice", f"WITH {M}, m AS (SELECT *, {TIER} AS tier FROM memories), q AS (SELECT count(*) FILTER (n_refs > 0) / count(*) < 0.5 AS link, count(*) FILTER (review_status = 'pending') / count(*) > 0.3 AS review, count(*) FILTER (tier = 'hypothesis') > count(*) * 0.2 AS unverified FROM m) SELECT unnest(list_filter([CASE WHEN link THEN 'link memories to code' END, CASE WHEN review THEN 'review pending memories' END, CASE WHEN unverified THEN 'many unverified memories' END], lambda x: x IS NOT NULL)) AS advice FROM q")
def quality_advice(spark, d):
    return R.recommendations(R.quality_metrics(V.memories(spark, d), V.now())).select(F.explode("advice").alias("advice"))
