"""The jobs as registered queries: each runs twice into one new folder and returns what stands there after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import text
from tessera.operators import lifecycle
from tessera.plans.records import OUT, TIER, TOKENS
from tessera.plans.sessions import quoted
from tessera.sources import views as V
from tessera.sources.store import shared_folder

from . import memory_audit, transcript_ingest


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def job1_transcript_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the conversations, contents that are blobs from the blob table; the second run finds nothing new."""
    folder = own_folder(spark, "job1")
    for _ in range(2):
        transcript_ingest.run(spark, f"{sf_dir}/conversations.parquet", f"{folder}/out", f"{folder}/progress")
    return lifecycle.with_content(transcript_ingest.log(spark, f"{folder}/out"), transcript_ingest.blobs(spark, f"{folder}/out"))


def job2_memory_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all memories."""
    folder = own_folder(spark, "job2")
    for _ in range(2):
        memory_audit.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", folder)
    return memory_audit.results(spark, folder)


def any_(patterns: tuple[str, ...]) -> str:
    return " OR ".join(f"regexp_matches(content, {quoted(p)})" for p in patterns)


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(raw, '(?i)\b(?:sk-|api[_-]?key|token|secret|password|auth)[_-]?[a-zA-Z0-9]{20,}', '[REDACTED]', 'g'), '(?i)Bearer\s+[a-zA-Z0-9._-]+', 'Bearer [REDACTED]', 'g'), 'AKIA[A-Z0-9]{16}', '[REDACTED_AWS_KEY]', 'g')"""

INGESTED = f"""WITH told AS (SELECT DISTINCT conv_id AS session_id, turn AS pos, role, coalesce(text, '') AS raw FROM conversations),
 cleaned AS (SELECT *, {CLEAN} AS content FROM told), sized AS (SELECT *, substr(sha256(content), 1, 16) AS content_hash, {TOKENS} AS token_count FROM cleaned)
SELECT session_id, pos, role, content, CASE WHEN token_count > 1000 THEN content_hash END AS blob_id, content_hash, token_count, content <> raw AS redacted,
 CASE WHEN role = 'user' THEN 'user_prompt' WHEN {any_(text.ERROR)} THEN 'error' WHEN {any_(text.DIFF)} THEN 'diff' WHEN {any_(text.TESTS)} THEN 'test_summary' ELSE 'turn' END AS event_type FROM sized"""

REASON = f"CASE {' '.join(f'WHEN regexp_matches(content, {quoted(p)}) THEN {quoted(r)}' for p, r in text.NOISE)} END"

AUDITED = f"""WITH {V.MEMORIES_SQL}, {V.OUTCOMES_SQL}, {OUT},
 twins AS (SELECT id AS twin, first_value(id) OVER (PARTITION BY substr(trim(lower(content)), 1, 200) ORDER BY created_at DESC, id) AS keeper FROM memories WHERE status IN ('active', 'stale') AND content IS NOT NULL),
 rated AS (SELECT m.*, {TIER} AS tier, {TOKENS} AS tokens, greatest(0.01::DOUBLE, strength * exp(-0.05::DOUBLE * date_diff('day', coalesce(last_accessed, created_at), TIMESTAMP '{V.NOW}'))) AS faded,
  coalesce(outcome_score, 0.5)::DOUBLE AS outcome, {REASON} AS noise, CASE WHEN keeper <> id THEN keeper END AS newer FROM memories m LEFT JOIN scores ON id = memory_id LEFT JOIN twins ON id = twin),
 decided AS (SELECT *, CASE WHEN status IN ('retired', 'superseded') THEN 'leave' WHEN noise IS NOT NULL THEN 'discard' WHEN newer IS NOT NULL THEN 'merge' WHEN faded < 0.1 AND object_type <> 'constraint' THEN 'archive'
  WHEN status = 'stale' OR (n_refs > 0 AND coalesce(last_verified_at < TIMESTAMP '{V.NOW}' - INTERVAL 7 DAY, true)) THEN 'verify' WHEN review_status = 'pending' THEN 'review' ELSE 'keep' END AS action FROM rated)
SELECT id, action, CASE WHEN action = 'discard' THEN noise END AS reason, CASE WHEN action = 'merge' THEN newer END AS "into", tier, tokens, round(faded, 6) AS strength, round(outcome, 6) AS outcome_score,
 round(faded * (0.5 + outcome), 6) AS effective, scope_path AS scope FROM decided"""

QUERIES = {"job1_transcript_ingest": job1_transcript_ingest, "job2_memory_audit": job2_memory_audit}
SQL = {"job1_transcript_ingest": INGESTED, "job2_memory_audit": AUDITED}
