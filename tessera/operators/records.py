"""Listing, filtering, ranking and rolling up memories, outcomes and usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import score, text


def listed(memories: DataFrame, status: Sequence[str] = (), types: Sequence[str] = (), scope: str | None = None, review: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Memories that pass all given filters, newest first; no limit with None."""
    if status:
        memories = memories.filter(F.col("status").isin(*status))
    if types:
        memories = memories.filter(F.col("object_type").isin(*types))
    if scope is not None:
        memories = memories.filter(F.col("scope_path") == scope)
    if review is not None:
        memories = memories.filter(F.col("review_status") == review)
    memories = memories.orderBy(F.desc("created_at"), "id").offset(offset)
    return memories if limit is None else memories.limit(limit)


def active_constraints(memories: DataFrame) -> DataFrame:
    return listed(memories, ["active"], ["constraint"], review="approved", limit=None)


def pending_review(memories: DataFrame, limit: int | None = 10) -> DataFrame:
    return listed(memories, ["active"], review="pending", limit=limit)


def warnings(memories: DataFrame, limit: int = 5) -> DataFrame:
    return memories.filter("status = 'stale'").orderBy(F.desc("updated_at"), "id").limit(limit)


def high_value(memories: DataFrame, limit: int = 20) -> DataFrame:
    kept = memories.filter((F.col("status") == "active") & F.col("object_type").isin("decision", "known_fix", "convention", "preference"))
    return kept.orderBy(F.desc("access_count"), F.desc("created_at"), "id").limit(limit)


def with_code_refs(memories: DataFrame) -> DataFrame:
    """Active or stale memories with references, least recently verified first, never verified before all."""
    kept = memories.filter((F.col("n_refs") > 0) & F.col("status").isin("active", "stale"))
    return kept.orderBy(F.asc_nulls_first("last_verified_at"), "id")


def stale_by_age(memories: DataFrame, now: Column, days: int = 30) -> DataFrame:
    age = score.days_between(now, F.coalesce("last_accessed", "created_at"))
    return memories.filter((F.col("status") == "active") & (age > days))


def by_ids(memories: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Active memories of a given list, in its order."""
    wanted = memories.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id long")
    return memories.filter("status = 'active'").join(F.broadcast(wanted), "id").orderBy("pos")


def history_within(memories: DataFrame, budget: int, most: int = 10) -> DataFrame:
    """The newest decisions of any status, up to the first that exceeds the budget."""
    newest = memories.filter("object_type = 'decision'").orderBy(F.desc("created_at"), "id").limit(most)
    order = Window.orderBy(F.desc("created_at"), "id")
    sized = newest.withColumn("tokens", text.estimate_tokens(F.col("content")))
    return sized.withColumn("running", F.sum("tokens").over(order)).filter(F.col("running") <= budget)


def status_counts(memories: DataFrame) -> DataFrame:
    """Memories per status, statuses without any too."""
    names = memories.sparkSession.createDataFrame([(s,) for s in S.STATUSES], "status string")
    counts = memories.groupBy("status").count()
    return names.join(counts, "status", "left").select("status", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def outcome_scores(outcomes: DataFrame) -> DataFrame:
    """memory_id, helpful, neutral, unhelpful, outcome_score (1, 0.5 or 0 on average)."""
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    weight = F.when(F.col("outcome") == "helpful", 1.0).when(F.col("outcome") == "neutral", 0.5).when(F.col("outcome") == "unhelpful", 0.0)
    return outcomes.groupBy("memory_id").agg(is_("helpful").alias("helpful"), is_("neutral").alias("neutral"), is_("unhelpful").alias("unhelpful"), F.avg(weight).alias("outcome_score"))


def with_outcomes(memories: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Memories with outcome_score, 0.5 where there is no feedback."""
    scores = outcome_scores(outcomes).select(F.col("memory_id").alias("o_id"), "outcome_score")
    joined = memories.join(scores, F.col("id") == F.col("o_id"), "left").drop("o_id")
    return joined.withColumn("outcome_score", F.coalesce("outcome_score", F.lit(0.5)))


def effective_ranking(memories: DataFrame, outcomes: DataFrame, limit: int = 20) -> DataFrame:
    """Active memories by strength x (0.5 + outcome)."""
    ranked = with_outcomes(memories.filter("status = 'active'"), outcomes).withColumn("effective", F.col("strength") * (0.5 + F.col("outcome_score")))
    return ranked.orderBy(F.desc("effective"), "id").limit(limit)


def with_tier(memories: DataFrame, now: Column) -> DataFrame:
    return memories.withColumn("tier", score.tier(F.col("n_refs"), F.col("n_evidence"), F.col("review_status"), F.col("last_verified_at"), now))


def heatmap(memories: DataFrame, now: Column, limit: int = 10, least: int = 1, types: Sequence[str] = ()) -> DataFrame:
    """The most accessed active memories, twice as many as asked for, then the hottest of them."""
    kept = memories.filter((F.col("status") == "active") & (F.col("access_count") >= least))
    if types:
        kept = kept.filter(F.col("object_type").isin(*types))
    accessed = kept.orderBy(F.desc("access_count"), "id").limit(2 * limit)
    return accessed.withColumn("heat", score.heat(F.col("access_count"), F.col("last_accessed"), now)).orderBy(F.desc("heat"), "id").limit(limit)


def quality_metrics(memories: DataFrame, now: Column) -> DataFrame:
    """One row: counts of what speaks for the store's quality, and its health score."""
    tiers = [F.count_if(F.col("tier") == t).alias(t) for t in S.TIERS]
    counts = with_tier(memories, now).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("n_refs") > 0).alias("with_code_refs"),
        F.count_if(F.col("review_status") == "approved").alias("approved"),
        F.count_if(F.col("review_status") == "pending").alias("pending"),
        F.count_if(F.col("n_evidence") > 0).alias("with_evidence"),
        *tiers,
    )
    return counts.withColumn("health", health(F.col("total")))


def health(total: Column) -> Column:
    """0 to 100 from the counts of quality_metrics: references 30, approval 25, evidence 20, tiers 25."""
    share = lambda c: F.try_divide(c.cast("double"), total)
    tiered = sum((F.col(t) for t in S.TIERS), F.lit(0))
    good = F.when(tiered > 0, F.try_divide((F.col("grounded") + F.col("observed")).cast("double"), tiered) * 25).otherwise(12.5)
    value = share(F.col("with_code_refs")) * 30 + share(F.col("approved")) * 25 + share(F.col("with_evidence")) * 20 + good
    return F.when(total == 0, 100).otherwise(F.floor(value + 0.5)).cast("long")


def recommendations(metrics: DataFrame, needs_review: int = 0, stale: int = 0) -> DataFrame:
    """advice: what the metrics suggest, in order."""
    share = lambda c: F.col(c) / F.col("total")
    advice = [
        F.when(share("with_code_refs") < 0.5, "link memories to code"),
        F.when(share("pending") > 0.3, "review pending memories"),
        F.when(F.lit(needs_review) > 0, f"{needs_review} memories need a freshness review"),
        F.when(F.lit(stale) > 0, f"{stale} stale memories"),
        F.when(F.col("hypothesis") > F.col("total") * 0.2, "many unverified memories"),
    ]
    some = F.array_compact(F.array(*advice))
    out = F.when(F.col("total") == 0, F.array(F.lit("no memories yet"))).when(F.size(some) == 0, F.array(F.lit("memory quality looks good"))).otherwise(some)
    return metrics.select(out.alias("advice"))


def duplicate_groups(memories: DataFrame) -> DataFrame:
    """Members of groups of memories that start alike: id, keeper (the newest), n."""
    keyed = memories.withColumn("key", text.duplicate_key(F.col("content")))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("created_at", (-F.col("id")).alias("i"))).alias("newest")).filter("n > 1")
    return keyed.join(groups, "key").select("id", (-F.col("newest.i")).alias("keeper"), "n")


def noise(memories: DataFrame, extra: str | None = None) -> DataFrame:
    """id, reason of noisy memories."""
    return memories.select("id", text.noise_reason(F.col("content"), extra).alias("reason")).filter("reason is not null")


def usage_summary(priced: DataFrame) -> DataFrame:
    """Totals, by operation and by model, in one pass: level, key, n, tokens_in, tokens_out, cost."""
    sets = priced.groupingSets([["operation"], ["model"], []], "operation", "model").agg(
        F.count("*").alias("n"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.sum("cost").alias("cost"), F.grouping_id().alias("g")
    )
    level = F.when(F.col("g") == 1, "operation").when(F.col("g") == 2, "model").otherwise("all")
    return sets.select(level.alias("level"), F.coalesce("operation", "model", F.lit("")).alias("key"), "n", "tokens_in", "tokens_out", "cost")


def with_cost(usage: DataFrame) -> DataFrame:
    return usage.withColumn("cost", score.cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))


def daily_usage(priced: DataFrame) -> DataFrame:
    """Per day: day, n, tokens, cost."""
    return priced.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost").alias("cost"))


def budget_running(priced: DataFrame, session_limit: float, token_limit: int, warn: float = 0.8) -> DataFrame:
    """Each call with its session's running cost and tokens, and what that is: ok, warning or exceeded."""
    so_far = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = priced.withColumn("spent", F.sum("cost").over(so_far)).withColumn("tokens", F.sum(F.col("input_tokens") + F.col("output_tokens")).over(so_far))
    share = F.greatest(F.col("spent") / session_limit, F.col("tokens") / token_limit)
    return run.withColumn("budget", F.when(share >= 1, "exceeded").when(share >= warn, "warning").otherwise("ok"))


def orphans(blobs: DataFrame, owners: DataFrame, blob: str, owner: str) -> DataFrame:
    """Blobs that no owner refers to."""
    return blobs.join(owners.filter(F.col(owner).isNotNull()).select(F.col(owner).alias("o_id")), F.col(blob) == F.col("o_id"), "left_anti")


def context_health(injections: DataFrame, now: Column) -> DataFrame:
    """Averages over injected memories, and the grounded share."""
    tiered = with_tier(injections, now)
    return tiered.agg(F.count("*").alias("n"), F.avg("strength").alias("avg_strength"), F.avg("access_count").alias("avg_access"), F.avg((F.col("tier") == "grounded").cast("int")).alias("grounded_share"))
