"""Queries over search, fusion, plans, packing and retrieval metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text
from ..operators import lexicon as L
from ..operators import records as R
from ..operators import search as X
from ..sources import views as V
from . import lexicon_sql as Q
from .records import OUT, TIER, TOKENS

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


M, O = V.MEMORIES_SQL, V.OUTCOMES_SQL
TERMS = ("thation", "oning", "leau", "der")
LIMIT = 20
BM25 = Q.bm25("memories", ("content", "scope_path"), L.query_terms(TERMS))
COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"
AGE = f"date_diff('day', coalesce(last_accessed, created_at), TIMESTAMP '{V.NOW}')"
FADED = f"greatest(0.01, strength * exp(-0.05 * {AGE}))"
RECENT = f"(1 + 0.2 * exp(-date_diff('day', coalesce(last_verified_at, created_at), TIMESTAMP '{V.NOW}') / 30.0))"


def hybrid_sql(limit: int) -> str:
    return f"""{BM25}, lx AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) AS l_rank FROM (SELECT id, bm25 FROM hits JOIN memories USING (id) WHERE status = 'active' ORDER BY bm25 DESC, id LIMIT {2 * limit})),
vx AS (SELECT vec_id, row_number() OVER (ORDER BY 1 - {COS}, vec_id) AS v_rank FROM embeddings ORDER BY 1 - {COS}, vec_id LIMIT {2 * limit}),
rk AS (SELECT coalesce(id, vec_id) AS m_id, coalesce(0.5::DOUBLE / (60 + l_rank), 0) + coalesce(0.5::DOUBLE / (60 + v_rank), 0) AS rrf, CASE WHEN vec_id IS NULL THEN 'lexical' WHEN id IS NULL THEN 'vector' ELSE 'hybrid' END AS match FROM lx FULL JOIN vx ON id = vec_id),
hy AS (SELECT m.*, rrf, match, rrf * {FADED} * (0.5 + coalesce(outcome_score, 0.5)) * {RECENT} AS score FROM memories m JOIN rk ON id = m_id LEFT JOIN scores ON id = memory_id WHERE status = 'active' ORDER BY score DESC, id LIMIT {limit})"""


HEAD = f"WITH {M}, {O}, {OUT}, "


def searched(spark, d, limit=LIMIT):
    memories = R.with_outcomes(V.memories(spark, d), V.outcomes(spark, d))
    vectors = V.read(spark, d, "embeddings")
    asked = vectors.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return X.hybrid(memories, V.memory_index(spark, d), vectors, asked, TERMS, V.now(), limit)


@query("bm25_topk", f"WITH {M}, {BM25} SELECT id, round(bm25, 6) AS bm25 FROM hits JOIN memories USING (id) WHERE status = 'active' ORDER BY hits.bm25 DESC, id LIMIT 50")
def bm25_topk(spark, d):
    return X.lexical(V.memories(spark, d), V.memory_index(spark, d), TERMS).select("id", F.round("bm25", 6).alias("bm25"))


EVENT_TERMS = ("hation", "sthe", "and")


@query("event_search", f"WITH {V.SAID_SQL}, {Q.bm25('said_events', ('content', 'role'), L.query_terms(EVENT_TERMS))} SELECT id, session_id, role, round(bm25, 6) AS bm25 FROM hits JOIN said_events USING (id) ORDER BY hits.bm25 DESC, id LIMIT 50")
def event_search(spark, d):
    """Events by words, whatever their session."""
    events = V.said(spark, d)
    top = L.search(V.event_index(spark, d), events, EVENT_TERMS)
    return events.select("id", "session_id", "role").join(F.broadcast(top), "id").select("id", "session_id", "role", F.round("bm25", 6).alias("bm25"))


@query("snippets")
def snippets(spark, d):
    """The best memories for some words, each with its best window; the texts of these alone are read through."""
    memories = V.memories(spark, d)
    top = L.search(V.memory_index(spark, d), memories.filter("status = 'active'"), EVENT_TERMS)
    return memories.select("id", "content").join(F.broadcast(top), "id").select("id", F.round("bm25", 6).alias("bm25"), L.snippet(F.col("content"), EVENT_TERMS).alias("snippet"))


LIKE = 5
OWN_WORDS = f"SELECT DISTINCT s FROM said JOIN stems USING (w) WHERE id = {LIKE} AND w IN (SELECT strip_accents(lower(unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(content, '{chr(91)}^\\p{{L}}\\p{{N}}_{chr(93)}', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) >= 2 AND lower(x) NOT IN ({', '.join(repr(w) for w in text.STOP_WORDS)}) AND upper(x) NOT IN ('AND', 'OR', 'NOT', 'NEAR'))))) FROM memories WHERE id = {LIKE})"


@query(
    "find_similar",
    f"""WITH {M}, {Q.bm25("memories", ("content", "scope_path"), OWN_WORDS)}, lx AS (SELECT id, 0 AS part, -bm25 AS key FROM (SELECT id, bm25 FROM hits JOIN memories USING (id) WHERE status = 'active' ORDER BY bm25 DESC, id LIMIT 10) WHERE bm25 > 0.5 AND id <> {LIKE}),
 v AS (SELECT vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = {LIKE})::DOUBLE[]) AS distance FROM embeddings),
 nx AS (SELECT id, 1 AS part, distance AS key FROM (SELECT * FROM v ORDER BY distance, id LIMIT 10) WHERE 1 - distance > 0.85 AND id <> {LIKE} AND id IN (SELECT id FROM memories WHERE status = 'active')),
 b AS (SELECT id, min((part, key)) AS o FROM (SELECT * FROM lx UNION ALL SELECT * FROM nx) GROUP BY 1) SELECT id, CAST(row_number() OVER (ORDER BY o, id) AS INTEGER) AS place FROM b ORDER BY o, id LIMIT 5""",
)
def find_similar(spark, d):
    return X.find_similar(V.memories(spark, d), V.memory_index(spark, d), V.read(spark, d, "embeddings"), LIKE)


@query("vector_topk", f"SELECT vec_id, round(1 - {COS}, 6) AS distance FROM embeddings ORDER BY 1 - {COS}, vec_id LIMIT 50")
def vector_topk(spark, d):
    v = V.read(spark, d, "embeddings")
    return X.vector(v, v.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)).select("vec_id", F.round("distance", 6).alias("distance"))


@query("vector_pairs_mean", "SELECT a.label, count(DISTINCT a.vec_id) AS n, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean_similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1")
def vector_pairs_mean(spark, d):
    return X.mean_similarity(V.read(spark, d, "embeddings")).select("label", "n", F.round("mean_similarity", 6).alias("mean_similarity"))


@query("rrf_hybrid", f"{HEAD}{hybrid_sql(LIMIT)} SELECT id, match, round(rrf, 6) AS rrf, round(score, 6) AS score FROM hy")
def rrf_hybrid(spark, d):
    return searched(spark, d).select("id", "match", F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"))


def plan_sql(plan: dict) -> str:
    s = "score"
    if "grounded" in plan:
        s = f"(CASE WHEN tier = 'grounded' THEN {s} * {plan['grounded']} ELSE {s} END)"
    if "refs" in plan:
        s = f"(CASE WHEN n_refs > 0 THEN {s} * {plan['refs']} ELSE {s} END)"
    if "verified" in plan:
        s = f"(CASE WHEN last_verified_at > TIMESTAMP '{V.NOW}' - INTERVAL 7 DAY THEN {s} * {plan['verified']} ELSE {s} END)"
    kinds = " ".join(f"WHEN '{k}' THEN {v / 100}" for k, v in plan.get("type_boosts", {}).items())
    s = f"{s} + (CASE object_type {kinds} ELSE 0 END)" if kinds else s
    where = [f"object_type IN ({', '.join(repr(t) for t in plan['types'])})"] if plan["types"] else []
    if "least_tier" in plan:
        where.append(f"tier IN ({', '.join(repr(t) for t in S.TIERS[: S.TIERS.index(plan['least_tier']) + 1])})")
    return f"tr AS (SELECT *, {TIER} AS tier FROM hy) SELECT id, object_type, round({s}, 6) AS score FROM tr {'WHERE ' + ' AND '.join(where) if where else ''} ORDER BY {s} DESC, id LIMIT {plan['budget'] // 30}"


def register_plan(name: str) -> None:
    plan = S.PLANS[name]
    if plan.get("stale"):
        return

    def run(spark, d):
        return X.planned(searched(spark, d, 50), plan, V.now()).select("id", "object_type", F.round("score", 6).alias("score"))

    QUERIES[f"plan_{name}"] = run
    SQL[f"plan_{name}"] = f"{HEAD}{hybrid_sql(50)}, {plan_sql(plan)}"


for plan_name in S.PLANS:
    register_plan(plan_name)


def rerank_sql(task: str) -> str:
    weights, boosts = S.RERANK_TASKS[task]
    w = S.RERANK | weights
    types = " ".join(f"WHEN '{t}' THEN {(p + boosts.get(t, 0)) / 100}" for t, p in S.TYPE_PRIORITY.items())
    made = f"exp(-date_diff('day', created_at, TIMESTAMP '{V.NOW}') / 30.0)"
    return f"""tr AS (SELECT *, {TIER} AS tier FROM hy) SELECT id, round({w['search']} * least(score, 1) + {w['type']} * (CASE object_type {types} END)
 + {w['confidence']} * greatest((CASE tier WHEN 'grounded' THEN 1.0 WHEN 'observed' THEN 0.75 WHEN 'inferred' THEN 0.5 ELSE 0.25 END), (CASE confidence WHEN 'certain' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.4 ELSE 0.2 END))
 + {w['recency']} * {made} + {w['access']} * least(ln(1 + access_count * 2.0) / ln(21), 1), 6) AS score FROM tr"""


def register_rerank(task: str) -> None:
    def run(spark, d):
        return X.reranked(searched(spark, d, 50), V.now(), task).select("id", F.round("score", 6).alias("score"))

    QUERIES[f"rerank_{task}"] = run
    SQL[f"rerank_{task}"] = f"{HEAD}{hybrid_sql(50)}, {rerank_sql(task)}"


for task_name in S.RERANK_TASKS:
    register_rerank(task_name)


@query(
    "pack_skip_greedy",
    f"""WITH RECURSIVE {M}, r AS (SELECT *, row_number() OVER (ORDER BY access_count DESC, id) AS rank, {TOKENS} + 20 AS tokens FROM (SELECT * FROM memories WHERE status = 'active' AND object_type <> 'constraint' ORDER BY access_count DESC, id LIMIT 50)),
 f AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS tokens, false AS included, CAST(3000 AS BIGINT) AS remaining UNION ALL
 SELECT r.rank, r.id, CAST(r.tokens AS BIGINT), r.tokens <= f.remaining, CASE WHEN r.tokens <= f.remaining THEN f.remaining - CAST(r.tokens AS BIGINT) ELSE f.remaining END FROM f JOIN r ON r.rank = f.rank + 1)
 SELECT CAST(rank AS INTEGER) AS rank, id, tokens, included, remaining AS "left" FROM f WHERE rank > 0""",
)
def pack_skip_greedy(spark, d):
    top = V.memories(spark, d).filter("status = 'active' and object_type <> 'constraint'").orderBy(F.desc("access_count"), "id").limit(50)
    return X.packed(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("access_count"), "id"))), 3000)


@query("merge_rollup", f"""WITH {M}, g AS (SELECT *, substr(trim(lower(content)), 1, 200) AS key FROM memories), t AS (SELECT key, object_type, count(*) AS n, min(id) AS f FROM g GROUP BY 1, 2),
 k AS (SELECT key, object_type FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, f) = 1)
 SELECT min(id) AS first_id, (['certain','high','medium','low'])[min(CASE confidence WHEN 'certain' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END)] AS confidence, CAST(sum(n_evidence) AS BIGINT) AS n_evidence,
 arg_max(id, (length(content), -id)) AS content_from, count(*) AS members, any_value(k.object_type) AS object_type FROM g JOIN k USING (key) GROUP BY key HAVING count(*) > 1""")
def merge_rollup(spark, d):
    keyed = V.memories(spark, d).withColumn("key", F.substring(F.trim(F.lower("content")), 1, 200))
    first = keyed.groupBy("key").agg(F.min("id").alias("first_id"))
    return X.group_merge(keyed, "key").join(first, "key").filter("members > 1").select("first_id", "confidence", "n_evidence", "content_from", "members", "object_type")


def judged(spark, d):
    """Queries are the vectors whose id is divisible by 20, each ranks its 20 nearest; those of its label are relevant, graded by id."""
    v = V.read(spark, d, "embeddings")
    asked = v.filter("vec_id % 20 = 0")
    ranked = X.nearest_in_blocks(v, asked, 20)
    # grades of all rows of a label are summed per label and grade in ir_metrics' ideal: only as many as count are kept
    label = v.select(F.col("vec_id").alias("item_id"), "label", (1 + F.col("vec_id") % 3).cast("int").alias("grade"))
    own = asked.select(F.col("vec_id").alias("query_id"), "label")
    return ranked.select("query_id", F.col("vec_id").alias("item_id"), "rank"), own, label


JUDGED = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS q_label FROM embeddings WHERE vec_id % 20 = 0),
 nr AS (SELECT query_id, vec_id AS item_id, q_label, label, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 9), vec_id) AS rank FROM embeddings JOIN q ON vec_id <> query_id),
 rl AS (SELECT query_id, vec_id AS item_id, 1 + vec_id % 3 AS grade FROM embeddings JOIN q ON label = q_label AND vec_id <> query_id),
 j AS (SELECT nr.*, grade FROM nr LEFT JOIN rl USING (query_id, item_id) WHERE rank <= 20),
 idl AS (SELECT query_id, count(*) AS wanted, sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item_id) AS r FROM rl) GROUP BY 1)"""
PR = ", ".join(f"round(count(*) FILTER (grade IS NOT NULL AND rank <= {k}) / least({k}, count(*) FILTER (rank <= 10)), 6) AS p_{k}, round(count(*) FILTER (grade IS NOT NULL AND rank <= {k}) / any_value(wanted), 6) AS r_{k}" for k in (1, 3, 5, 10))


@query("ir_metrics", f"WITH {JUDGED} SELECT query_id, {PR}, round(coalesce(max(CASE WHEN grade IS NOT NULL THEN 1.0::DOUBLE / rank END), 0), 6) AS mrr, round(sum(CASE WHEN rank <= 10 THEN (pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1) ELSE 0 END) / any_value(idcg), 6) AS ndcg FROM j JOIN idl USING (query_id) GROUP BY 1")
def ir_metrics(spark, d):
    m = X.ir_metrics_by_label(*judged(spark, d))
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in m.columns if c != "query_id"))


@query("latency_p95", "WITH s AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT max(n) AS n, round((SELECT avg(value) FROM events), 6) AS mean, max(v) AS p95 FROM s WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)")
def latency_p95(spark, d):
    return X.latency_p95(V.read(spark, d, "events"), "value").select("n", F.round("mean", 6).alias("mean"), "p95")
