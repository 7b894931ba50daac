"""Scores of memories as column expressions; ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days; null without an earlier time."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def decayed_strength(strength: Column, last_accessed: Column, created: Column, now: Column, rate: float = S.DECAY_PER_DAY) -> Column:
    age = days_between(now, F.coalesce(last_accessed, created))
    return F.greatest(F.lit(S.LEAST_STRENGTH), strength * F.exp(-rate * age))


def reinforced_strength(strength: Column, boost: float = S.REINFORCE) -> Column:
    return F.least(F.lit(1.0), strength + boost)


def effective(base: Column, strength: Column, outcome: Column) -> Column:
    return base * strength * (0.5 + outcome)


def recency_multiplier(date: Column, now: Column) -> Column:
    """Between 1 and 1.2; 1 without a date."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-days_between(now, date) / S.RECENCY_DAYS)))
    return F.coalesce(1 + S.RECENCY_BOOST * share, F.lit(1.0))


def is_archivable(strength: Column, below: float = S.ARCHIVE_BELOW) -> Column:
    return strength < below


def tier(n_refs: Column, n_evidence: Column, review: Column, verified: Column, now: Column) -> Column:
    """Evidence-based confidence tier."""
    recent = F.coalesce(days_between(now, verified) <= S.RECENT_VERIFICATION_DAYS, F.lit(False))
    return (
        F.when((n_refs > 0) & recent, "grounded")
        .when((review == "approved") | (n_evidence > 0), "observed")
        .when((n_refs > 0) | (review == "pending"), "inferred")
        .otherwise("hypothesis")
    )


def worth(column: Column, table: dict[str, float], otherwise: float) -> Column:
    out = F.lit(float(otherwise))
    for name, value in table.items():
        out = F.when(column == name, F.lit(float(value))).otherwise(out)
    return out


def tier_priority(of: Column) -> Column:
    """4 for grounded to 1 for hypothesis, 0 for anything else."""
    return worth(of, {t: 4 - i for i, t in enumerate(S.TIERS)}, 0).cast("int")


def tier_boost(of: Column) -> Column:
    return worth(of, S.TIER_BOOST, 1.0)


def heat(accesses: Column, last_accessed: Column, now: Column) -> Column:
    """Accesses, weighted down as the last one ages."""
    age = days_between(now, last_accessed)
    return accesses * F.when(age < 1, 1.0).when(age < 7, 0.7).when(age < 30, 0.4).otherwise(0.2)


def composite(score: Column, kind: Column, of_tier: Column, confidence: Column, created: Column, accesses: Column, now: Column, task: str = "general") -> Column:
    """Weighted reranking score; the task presets change weights and type priorities."""
    weights, boosts = S.RERANK_TASKS[task]
    w = S.RERANK | weights
    types = {t: p + boosts.get(t, 0) for t, p in S.TYPE_PRIORITY.items()}
    trust = F.greatest(tier_boost(of_tier) / 2, worth(confidence, S.CONFIDENCE_BOOST, 10) / 25)
    recency = F.exp(-days_between(now, created) / 30.0)
    access = F.least(F.log1p(accesses * F.lit(2.0)) / F.log1p(F.lit(20.0)), F.lit(1.0))
    return w["search"] * F.least(score, F.lit(1.0)) + w["type"] * worth(kind, types, 50) / 100 + w["confidence"] * trust + w["recency"] * recency + w["access"] * access


def plan_boosts(score: Column, plan: dict, of_tier: Column, n_refs: Column, verified: Column, kind: Column, now: Column, scope_match: Column | None = None) -> Column:
    """A retrieval plan's boosts, in the plan's order: factors, then the type's addition, then the scope."""
    if "grounded" in plan:
        score = F.when(of_tier == "grounded", score * plan["grounded"]).otherwise(score)
    if "refs" in plan:
        score = F.when(n_refs > 0, score * plan["refs"]).otherwise(score)
    if "verified" in plan:
        score = F.when(days_between(now, verified) < 7, score * plan["verified"]).otherwise(score)
    score = score + worth(kind, plan.get("type_boosts", {}), 0) / 100
    return score if scope_match is None else score * (1 + scope_match * 0.5)


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]] | None = None) -> Column:
    """US dollars; models without a price have the default one."""
    prices = S.PRICES if prices is None else prices
    default = prices["default"]
    out = tokens_in / F.lit(1000.0) * default[0] + tokens_out / F.lit(1000.0) * default[1]
    for name, (a, b) in prices.items():
        out = F.when(model == name, tokens_in / F.lit(1000.0) * a + tokens_out / F.lit(1000.0) * b).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; null for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (length > 0), F.try_divide(dot(a, b), length))
