"""What to do with each memory of a knowledge base, scope by scope.

Reads memories (doc_id, text, source, n_chars) and feedback on them (doc_id, quality, toxic)
and decides for every memory, by the first rule that holds:

  leave    it is retired or superseded already
  discard  it is noise (its reason is told)
  merge    a newer live memory begins alike (``into`` names the newest of them)
  archive  its strength has decayed below what retrieval uses, and it is no constraint
  verify   it is stale, or refers to code and wasn't verified lately
  review   nobody has approved or rejected it
  keep     otherwise

Writes Parquet below the output folder, partitioned by scope: ``audit`` (a row per memory)
and ``summary`` (a row per scope and action).  A run over all scopes replaces both; a run
over some (setting ``scopes``) replaces the partitions of those alone.  Running again over
the same tables gives the same files' contents.

  python jobs/memory_audit.py --memories PATH --feedback PATH --output FOLDER [--config FILE]
"""

from __future__ import annotations

import logging
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from pyspark.sql import Column, DataFrame, Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import arguments, checked, session, stored  # noqa: E402
from tessera.functions import score, text  # noqa: E402
from tessera.operators import records  # noqa: E402
from tessera.sources import views  # noqa: E402

LOG = logging.getLogger("memory_audit")
DEFAULTS = {"format": "parquet", "now": views.NOW, "scopes": [], "verify_after_days": 7}
AUDIT = "id long, action string, reason string, into long, tier string, tokens long, strength double, outcome_score double, effective double, scope string"
SUMMARY = "action string, n long, tokens long, effective double, scope string"


def audit(memories: DataFrame, outcomes: DataFrame, now: Column, scopes: tuple[str, ...] = (), verify_after_days: int = 7) -> DataFrame:
    """A row of AUDIT for every memory of the scopes (all, without any); memories of other scopes count as duplicates."""
    # only live memories can be merged, or be merged into; groups of copies are counted before they are joined
    live = memories.filter(F.col("status").isin("active", "stale"))
    twins = records.duplicate_groups(live).filter("keeper <> id").select(F.col("id").alias("twin"), F.col("keeper").alias("into"))
    asked = memories.filter(F.col("scope_path").isin(*scopes)) if scopes else memories
    rows = records.with_tier(records.with_outcomes(asked, outcomes), now).join(twins, F.col("id") == F.col("twin"), "left")
    strength = score.decayed_strength(F.col("strength"), F.col("last_accessed"), F.col("created_at"), now)
    rows = rows.withColumn("faded", strength).withColumn("noise", text.noise_reason(F.col("content")))
    unverified = F.coalesce(score.days_between(now, F.col("last_verified_at")) > verify_after_days, F.lit(True))
    action = (
        F.when(F.col("status").isin("retired", "superseded"), "leave")
        .when(F.col("noise").isNotNull(), "discard")
        .when(F.col("into").isNotNull(), "merge")
        .when(score.is_archivable(F.col("faded")) & (F.col("object_type") != "constraint"), "archive")
        .when((F.col("status") == "stale") | ((F.col("n_refs") > 0) & unverified), "verify")
        .when(F.col("review_status") == "pending", "review")
        .otherwise("keep")
    )
    rows = rows.withColumn("action", action)
    return rows.select(
        "id", "action", F.when(F.col("action") == "discard", F.col("noise")).alias("reason"), F.when(F.col("action") == "merge", F.col("into")).alias("into"), "tier",
        text.estimate_tokens(F.col("content")).alias("tokens"), F.round("faded", 6).alias("strength"), F.round("outcome_score", 6).alias("outcome_score"),
        F.round(score.effective(F.lit(1.0), F.col("faded"), F.col("outcome_score")), 6).alias("effective"), F.col("scope_path").alias("scope"),
    )


def run(spark: SparkSession, memories: str, feedback: str, output: str, settings: dict | None = None) -> int:
    """Audits the memories at a path; the number of rows written."""
    chosen = checked(settings or {}, DEFAULTS)
    read = lambda path, schema: spark.read.format(chosen["format"]).schema(schema).load(path)
    seen, told = Observation(), Observation()
    documents = read(memories, "doc_id long, text string, source string, n_chars long").observe(seen, F.count("*").alias("n"))
    rows = audit(views.as_memories(documents), views.as_outcomes(read(feedback, "doc_id long, quality long, toxic long")), F.lit(chosen["now"]).cast("timestamp_ntz"), tuple(chosen["scopes"]), chosen["verify_after_days"])
    # without a partition for each scope the whole table is replaced
    mode = "dynamic" if chosen["scopes"] else "static"
    rows.observe(told, F.count("*").alias("n")).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("scope").parquet(f"{output}/audit")
    LOG.info("read %s rows of %s, wrote %d rows to %s/audit", seen.get["n"], memories, told.get["n"], output)
    written = results(spark, output)
    if chosen["scopes"]:
        written = written.filter(F.col("scope").isin(*chosen["scopes"]))
    rolled = written.groupBy("scope", "action").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.avg("effective"), 6).alias("effective"))
    rolled.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("scope").parquet(f"{output}/summary")
    return told.get["n"]


def results(spark: SparkSession, output: str) -> DataFrame:
    return stored(spark, f"{output}/audit", AUDIT)


def summary(spark: SparkSession, output: str) -> DataFrame:
    return stored(spark, f"{output}/summary", SUMMARY)


def main() -> None:
    named, settings = arguments(__doc__.split("\n\n")[0], __file__, ("memories", "table of memories"), ("feedback", "table of feedback"), ("output", "folder of the audit"))
    spark = session("memory_audit")
    try:
        run(spark, named.memories, named.feedback, named.output, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
