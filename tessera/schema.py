"""Names, fixed values and settings of the knowledge store."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values (order matters where a position is used).
OBJECT_TYPES = ("decision", "preference", "convention", "known_fix", "constraint", "failed_attempt", "environment")
STATUSES = ("active", "stale", "superseded", "retired")
CONFIDENCES = ("certain", "high", "medium", "low")
TIERS = ("grounded", "observed", "inferred", "hypothesis")
REVIEWS = ("pending", "approved", "rejected")

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
    ]
)

CODE_REF = T.StructType([T.StructField("path", T.StringType()), T.StructField("type", T.StringType()), T.StructField("symbol", T.StringType())])

# Decay and recency.
DECAY_PER_DAY = 0.05
REINFORCE = 0.15
RECENCY_DAYS, RECENCY_BOOST = 30.0, 0.2
LEAST_STRENGTH = 0.01
ARCHIVE_BELOW = 0.1
RECENT_VERIFICATION_DAYS = 7

# What a tier or a type is worth.
TIER_BOOST = {"grounded": 2.0, "observed": 1.5, "inferred": 1.0, "hypothesis": 0.5}
CONFIDENCE_BOOST = {"certain": 25, "high": 20, "medium": 10, "low": 5}
TYPE_PRIORITY = {"failed_attempt": 100, "known_fix": 90, "constraint": 85, "decision": 80, "convention": 60, "preference": 40, "environment": 30}
RRF_K = 60

# US dollars per 1000 tokens, in and out.
PRICES = {
    "gpt-4": (0.03, 0.06),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "claude-3-opus": (0.015, 0.075),
    "claude-3-sonnet": (0.003, 0.015),
    "claude-3-haiku": (0.00025, 0.00125),
    "local": (0.0, 0.0),
    "default": (0.001, 0.002),
}

# Reranking weights by task, with additions to the type priority.
RERANK = {"search": 0.4, "type": 0.25, "confidence": 0.15, "recency": 0.1, "access": 0.1}
RERANK_TASKS = {
    "general": ({}, {}),
    "debugging": ({"type": 0.35, "search": 0.35}, {"failed_attempt": 30, "known_fix": 30, "constraint": 20}),
    "implementing": ({"type": 0.3, "search": 0.4}, {"decision": 20, "convention": 20, "preference": 15}),
    "refactoring": ({"type": 0.3, "search": 0.35}, {"convention": 25, "constraint": 20, "decision": 15}),
}

# Retrieval plans by intent.
PLANS = {
    "debugging": {"types": ("failed_attempt", "known_fix", "constraint"), "budget": 1000, "grounded": 1.5, "refs": 1.3, "type_boosts": {"failed_attempt": 40, "known_fix": 35}},
    "conventions": {"types": ("convention", "preference", "constraint"), "budget": 500, "type_boosts": {"convention": 30, "constraint": 25, "preference": 20}},
    "implementation": {"types": ("decision", "convention", "known_fix", "constraint"), "budget": 800, "grounded": 1.3, "refs": 1.4, "type_boosts": {"decision": 25, "known_fix": 20}},
    "architecture": {"types": ("decision", "convention"), "budget": 600, "type_boosts": {"decision": 30}},
    "history": {"types": ("decision",), "budget": 500, "verified": 0.5, "type_boosts": {"decision": 35}, "stale": True},
    "validation": {"types": (), "budget": 300, "grounded": 2.0, "refs": 1.5, "verified": 1.5, "least_tier": "grounded"},
    "general": {"types": (), "budget": 800, "grounded": 1.2},
}
