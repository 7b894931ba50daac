"""Queries over memories, outcomes and usage, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import score, text
from ..operators import lookup
from ..operators import records as R
from ..operators import running
from ..sources import views as V

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


M, O, U = V.MEMORIES_SQL, V.OUTCOMES_SQL, V.USAGE_SQL
DAY = "strftime(created_at, '%Y-%m-%d')"
TIER = f"""CASE WHEN n_refs > 0 AND last_verified_at >= TIMESTAMP '{V.NOW}' - INTERVAL 7 DAY THEN 'grounded'
 WHEN review_status = 'approved' OR n_evidence > 0 THEN 'observed' WHEN n_refs > 0 OR review_status = 'pending' THEN 'inferred' ELSE 'hypothesis' END"""
TOKENS = r"""CASE WHEN content IS NULL OR length(trim(regexp_replace(content, '\s+', ' ', 'g'))) = 0 THEN 0 ELSE greatest(CAST(ceil(length(content) / 4.0) AS BIGINT),
 CAST(list_sum(list_transform(list_filter(string_split(trim(regexp_replace(content, '\s+', ' ', 'g')), ' '), lambda w: length(w) > 0), lambda w: greatest(1, CAST(ceil(length(w) / 4.0) AS BIGINT)))) AS BIGINT)) END"""
MADE = "date_format(created_at, 'yyyy-MM-dd') AS made"


@query("list_filtered", f"WITH {M} SELECT id, object_type, {DAY} AS made FROM memories WHERE status IN ('active','stale') AND object_type IN ('decision','convention') AND review_status = 'approved' ORDER BY created_at DESC, id LIMIT 50 OFFSET 10")
def list_filtered(spark, d):
    return R.listed(V.memories(spark, d), ["active", "stale"], ["decision", "convention"], review="approved", limit=50, offset=10).selectExpr("id", "object_type", MADE)


@query("active_constraints", f"WITH {M} SELECT id, {DAY} AS made FROM memories WHERE object_type = 'constraint' AND status = 'active' AND review_status = 'approved'")
def active_constraints(spark, d):
    return R.active_constraints(V.memories(spark, d)).selectExpr("id", MADE)


@query("pending_review", f"WITH {M} SELECT id, {DAY} AS made FROM memories WHERE status = 'active' AND review_status = 'pending' ORDER BY created_at DESC, id LIMIT 10")
def pending_review(spark, d):
    return R.pending_review(V.memories(spark, d)).selectExpr("id", MADE)


@query("stale_warnings", f"WITH {M} SELECT id, {DAY} AS made FROM memories WHERE status = 'stale' ORDER BY created_at DESC, id LIMIT 5")
def stale_warnings(spark, d):
    return R.warnings(V.memories(spark, d).withColumn("updated_at", F.col("created_at"))).selectExpr("id", MADE)


@query("high_value_recent", f"WITH {M} SELECT id, access_count FROM memories WHERE status = 'active' AND object_type IN ('decision','known_fix','convention','preference') ORDER BY access_count DESC, created_at DESC, id LIMIT 20")
def high_value_recent(spark, d):
    return R.high_value(V.memories(spark, d)).select("id", "access_count")


@query("code_ref_queue", f"WITH {M} SELECT id, strftime(last_verified_at, '%Y-%m-%d') AS verified FROM memories WHERE n_refs > 0 AND status IN ('active','stale')")
def code_ref_queue(spark, d):
    return R.with_code_refs(V.memories(spark, d)).select("id", F.date_format("last_verified_at", "yyyy-MM-dd").alias("verified"))


@query("stale_by_age", f"WITH {M} SELECT id FROM memories WHERE status = 'active' AND coalesce(last_accessed, created_at) < TIMESTAMP '{V.NOW}' - INTERVAL 30 DAY")
def stale_by_age(spark, d):
    return R.stale_by_age(V.memories(spark, d), V.now()).select("id")


@query("memories_by_ids", f"WITH {M} SELECT id, pos FROM memories JOIN (VALUES (0, 42), (1, 7), (2, 13), (3, 8), (4, 0)) AS w(pos, wid) ON id = wid WHERE status = 'active'")
def memories_by_ids(spark, d):
    return R.by_ids(V.memories(spark, d), [42, 7, 13, 8, 0]).select("id", "pos")


@query("history_prefix_budget", f"WITH {M}, newest AS (SELECT id, created_at, {TOKENS} AS tokens FROM memories WHERE object_type = 'decision' ORDER BY created_at DESC, id LIMIT 10), run AS (SELECT *, sum(tokens) OVER (ORDER BY created_at DESC, id) AS running FROM newest) SELECT id, tokens, CAST(running AS BIGINT) AS running FROM run WHERE running <= 3000")
def history_prefix_budget(spark, d):
    return R.history_within(V.memories(spark, d), 3000).select("id", "tokens", "running")


@query("status_counts", f"WITH {M} SELECT s.status, count(m.id) AS n FROM (VALUES ('active'),('stale'),('superseded'),('retired')) AS s(status) LEFT JOIN memories m ON m.status = s.status GROUP BY 1")
def status_counts(spark, d):
    return R.status_counts(V.memories(spark, d))


OUT = f"scores AS (SELECT memory_id, count(*) FILTER (outcome = 'helpful') AS helpful, count(*) FILTER (outcome = 'neutral') AS neutral, count(*) FILTER (outcome = 'unhelpful') AS unhelpful, avg(CASE outcome WHEN 'helpful' THEN 1.0 WHEN 'neutral' THEN 0.5 ELSE 0.0 END) AS outcome_score FROM outcomes GROUP BY 1)"


@query("outcome_scores", f"WITH {O}, {OUT} SELECT memory_id, helpful, neutral, unhelpful, round(outcome_score, 6) AS outcome_score FROM scores")
def outcome_scores(spark, d):
    return R.outcome_scores(V.outcomes(spark, d)).withColumn("outcome_score", F.round("outcome_score", 6))


@query("effective_score_topk", f"WITH {M}, {O}, {OUT} SELECT id, round(strength * (0.5 + coalesce(outcome_score, 0.5)), 6) AS effective FROM memories LEFT JOIN scores ON id = memory_id WHERE status = 'active' ORDER BY strength * (0.5 + coalesce(outcome_score, 0.5)) DESC, id LIMIT 20")
def effective_score_topk(spark, d):
    return R.effective_ranking(V.memories(spark, d), V.outcomes(spark, d)).select("id", F.round("effective", 6).alias("effective"))


@query("decay_scores", f"""WITH {M} SELECT id, round(greatest(0.01, strength * exp(-0.05 * date_diff('day', coalesce(last_accessed, created_at), TIMESTAMP '{V.NOW}'))), 6) AS decayed,
 round(least(1.0, strength + 0.15), 6) AS reinforced, round(coalesce(1 + 0.2 * exp(-date_diff('day', last_verified_at, TIMESTAMP '{V.NOW}') / 30.0), 1), 6) AS recency,
 greatest(0.01, strength * exp(-0.05 * date_diff('day', coalesce(last_accessed, created_at), TIMESTAMP '{V.NOW}'))) < 0.1 AS archivable FROM memories""")
def decay_scores(spark, d):
    m = V.memories(spark, d)
    faded = score.decayed_strength(F.col("strength"), F.col("last_accessed"), F.col("created_at"), V.now())
    return m.select("id", F.round(faded, 6).alias("decayed"), F.round(score.reinforced_strength(F.col("strength")), 6).alias("reinforced"), F.round(score.recency_multiplier(F.col("last_verified_at"), V.now()), 6).alias("recency"), score.is_archivable(faded).alias("archivable"))


@query("confidence_tiers", f"WITH {M}, t AS (SELECT id, {TIER} AS tier FROM memories) SELECT id, tier, CASE tier WHEN 'grounded' THEN 4 WHEN 'observed' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END AS priority, CASE tier WHEN 'grounded' THEN 2.0 WHEN 'observed' THEN 1.5 WHEN 'inferred' THEN 1.0 ELSE 0.5 END::DOUBLE AS boost, tier <> 'hypothesis' AS retrievable FROM t")
def confidence_tiers(spark, d):
    t = R.with_tier(V.memories(spark, d), V.now())
    return t.select("id", "tier", score.tier_priority(F.col("tier")).alias("priority"), score.tier_boost(F.col("tier")).alias("boost"), (F.col("tier") != "hypothesis").alias("retrievable"))


@query("tier_breakdown", f"WITH {M} SELECT {TIER} AS tier, count(*) AS n FROM memories WHERE status = 'active' GROUP BY 1")
def tier_breakdown(spark, d):
    return R.with_tier(V.memories(spark, d).filter("status = 'active'"), V.now()).groupBy("tier").agg(F.count("*").alias("n"))


HEAT = f"""CASE WHEN last_accessed IS NULL THEN 0.2 WHEN last_accessed > TIMESTAMP '{V.NOW}' - INTERVAL 1 DAY THEN 1.0 WHEN last_accessed > TIMESTAMP '{V.NOW}' - INTERVAL 7 DAY THEN 0.7
 WHEN last_accessed > TIMESTAMP '{V.NOW}' - INTERVAL 30 DAY THEN 0.4 ELSE 0.2 END"""


@query("heatmap_two_stage", f"WITH {M}, a AS (SELECT * FROM memories WHERE status = 'active' AND access_count >= 1 ORDER BY access_count DESC, id LIMIT 40) SELECT id, access_count, round((access_count * {HEAT})::DOUBLE, 6) AS heat FROM a ORDER BY access_count * {HEAT} DESC, id LIMIT 20")
def heatmap_two_stage(spark, d):
    return R.heatmap(V.memories(spark, d), V.now(), limit=20).select("id", "access_count", F.round("heat", 6).alias("heat"))


QM = f"""m AS (SELECT *, {TIER} AS tier FROM memories), q AS (SELECT count(*) AS total, count(*) FILTER (n_refs > 0) AS with_code_refs, count(*) FILTER (review_status = 'approved') AS approved,
 count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (n_evidence > 0) AS with_evidence, count(*) FILTER (tier = 'grounded') AS grounded, count(*) FILTER (tier = 'observed') AS observed,
 count(*) FILTER (tier = 'inferred') AS inferred, count(*) FILTER (tier = 'hypothesis') AS hypothesis FROM m)"""


@query("quality_metrics", f"WITH {M}, {QM} SELECT *, CAST(floor(with_code_refs / total * 30 + approved / total * 25 + with_evidence / total * 20 + (grounded + observed) / total * 25 + 0.5) AS BIGINT) AS health FROM q")
def quality_metrics(spark, d):
    return R.quality_metrics(V.memories(spark, d), V.now())


@query("type_histogram", f"WITH {M} SELECT object_type, {TIER} AS tier, count(*) AS n, round(avg(strength), 6) AS avg_strength FROM memories GROUP BY 1, 2")
def type_histogram(spark, d):
    return R.with_tier(V.memories(spark, d), V.now()).groupBy("object_type", "tier").agg(F.count("*").alias("n"), F.round(F.avg("strength"), 6).alias("avg_strength"))


@query("usage_grouping_sets", f"""WITH {U} SELECT CASE GROUPING_ID(operation, model) WHEN 1 THEN 'operation' WHEN 2 THEN 'model' ELSE 'all' END AS level, coalesce(operation, model, '') AS key, count(*) AS n,
 CAST(sum(input_tokens) AS BIGINT) AS tokens_in, CAST(sum(output_tokens) AS BIGINT) AS tokens_out, round(sum(cost), 6) AS cost FROM priced GROUP BY GROUPING SETS ((operation), (model), ())""")
def usage_grouping_sets(spark, d):
    return R.usage_summary(R.with_cost(V.usage(spark, d))).withColumn("cost", F.round("cost", 6))


@query("daily_usage", f"WITH {U} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM priced GROUP BY 1")
def daily_usage(spark, d):
    return R.daily_usage(R.with_cost(V.usage(spark, d))).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "tokens", F.round("cost", 6).alias("cost"))


@query("budget_running", f"""WITH {U}, r AS (SELECT *, sum(cost) OVER w AS spent, sum(input_tokens + output_tokens) OVER w AS tokens FROM priced WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
 SELECT event_id, session_id, CAST(floor(spent * 1e5 + 0.01) AS BIGINT) AS spent_e5, CAST(tokens AS BIGINT) AS tokens, CASE WHEN greatest(spent / 0.1::DOUBLE, tokens / 5000) >= 1 THEN 'exceeded' WHEN greatest(spent / 0.1::DOUBLE, tokens / 5000) >= 0.8 THEN 'warning' ELSE 'ok' END AS budget FROM r""")
def budget_running(spark, d):
    return R.budget_running(R.with_cost(V.usage(spark, d)), 0.1, 5000).select("event_id", "session_id", F.floor(F.col("spent") * 1e5 + 0.01).cast("long").alias("spent_e5"), "tokens", "budget")


PAID = "paid AS (SELECT *, CAST(round(cost * 1e9) AS BIGINT) AS units, CAST(ts AS DATE) AS day FROM priced)"


@query("budget_gate", f"""WITH {U}, {PAID}, r AS (SELECT event_id, session_id, CAST(coalesce(sum(input_tokens + output_tokens) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens,
 CAST(coalesce(sum(units) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent FROM paid)
 SELECT *, CASE WHEN tokens + 1000 > 5000 THEN 'session_tokens' WHEN spent >= 200000000 THEN 'day_cost' END AS reason, tokens + 1000 <= 5000 AND spent < 200000000 AS allowed FROM r""")
def budget_gate(spark, d):
    """Every call, and whether it may proceed by its session's tokens and its day's cost."""
    return running.budget_gate(R.with_cost(V.usage(spark, d)), 5000, 0.2).select("event_id", "session_id", "tokens", "spent", "reason", "allowed")


@query("budget_status", f"""WITH {U}, {PAID}, s AS (SELECT session_id, CAST(sum(units) AS BIGINT) AS session_used, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens_used, max(day) AS day FROM paid GROUP BY 1), d AS (SELECT day, CAST(sum(units) AS BIGINT) AS day_used FROM paid GROUP BY 1)
 SELECT session_id, strftime(day, '%Y-%m-%d') AS day, session_used, day_used, tokens_used, CAST(floor(session_used * 100 / 1e8 + 1e-6) AS BIGINT) AS session_percent, CAST(floor(day_used * 100 / 2e8 + 1e-6) AS BIGINT) AS day_percent, CAST(floor(tokens_used * 100 / 5000 + 1e-6) AS BIGINT) AS tokens_percent FROM s JOIN d USING (day)""")
def budget_status(spark, d):
    """What each session and its last day have used, in whole percents."""
    s = running.budget_status(R.with_cost(V.usage(spark, d)), 0.1, 0.2, 5000)
    return s.select("session_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "session_used", "day_used", "tokens_used", *(F.floor(F.col(c) + 1e-6).alias(c) for c in ("session_percent", "day_percent", "tokens_percent")))


@query("token_estimate", f"WITH {M} SELECT id, {TOKENS} AS tokens FROM memories")
def token_estimate(spark, d):
    return V.memories(spark, d).select("id", text.estimate_tokens(F.col("content")).alias("tokens"))


@query("content_hash", f"WITH {M} SELECT id, substr(sha256(content), 1, 16) AS hash FROM memories")
def content_hash(spark, d):
    return V.memories(spark, d).select("id", text.content_hash(F.col("content")).alias("hash"))


@query("duplicate_groups", f"WITH {M}, k AS (SELECT *, substr(trim(lower(content)), 1, 200) AS key FROM memories), g AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, first_value(id) OVER (PARTITION BY key ORDER BY created_at DESC, id) AS keeper FROM k) SELECT id, keeper, n FROM g WHERE n > 1")
def duplicate_groups(spark, d):
    return R.duplicate_groups(V.memories(spark, d))


@query("id_prefix", """WITH k AS (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS key FROM documents), a AS (SELECT DISTINCT substr(sha256(CAST(event_id AS VARCHAR)), 1, CAST(2 + event_id % 3 AS INTEGER)) AS prefix FROM events),
 c AS (SELECT prefix, count(key) AS n, min(key) AS one FROM a LEFT JOIN k ON starts_with(key, prefix) GROUP BY 1) SELECT prefix, n, CASE WHEN n = 1 THEN one END AS id FROM c""")
def id_prefix(spark, d):
    """Which memory's id each beginning of an id names, for one beginning per event."""
    name = lambda c: F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 16)
    ids = V.read(spark, d, "documents").select(name("doc_id").alias("key"))
    asked = V.read(spark, d, "events").select(F.substring(name("event_id"), F.lit(1), (2 + F.col("event_id") % 3).cast("int")).alias("prefix"))
    return lookup.resolved(ids, "key", asked, (2, 3, 4))


@query("blob_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def blob_orphans(spark, d):
    return R.orphans(V.read(spark, d, "documents").select("doc_id"), V.read(spark, d, "labels").select(F.col("doc_id").alias("owner")), "doc_id", "owner")


@query("sanitize", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(?:sk-|api[_-]?key|token|secret|password|auth)[_-]?[a-zA-Z0-9]{20,}', '[REDACTED]', 'g'), '(?i)Bearer\s+[a-zA-Z0-9._-]+', 'Bearer [REDACTED]', 'g'), 'AKIA[A-Z0-9]{16}', '[REDACTED_AWS_KEY]', 'g')) AS sanitized FROM documents""")
def sanitize(spark, d):
    return V.read(spark, d, "documents").select("doc_id", F.sha2(text.sanitized(F.col("text")), 256).alias("sanitized"))


@query("context_health", f"WITH {M}, m AS (SELECT *, {TIER} AS tier FROM memories) SELECT count(*) AS n, round(avg(strength), 6) AS avg_strength, round(avg(access_count), 6) AS avg_access, round(avg(CASE WHEN tier = 'grounded' THEN 1 ELSE 0 END), 6) AS grounded_share FROM m WHERE status = 'active'")
def context_health(spark, d):
    h = R.context_health(V.memories(spark, d).filter("status = 'active'"), V.now())
    return h.select("n", *(F.round(c, 6).alias(c) for c in ("avg_strength", "avg_access", "grounded_share")))
