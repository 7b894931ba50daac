"""Running totals along one order that no task sees as a whole: totals of ranges first, then what precedes each range.

Rows are dealt by ranges of (key, order), so a key with most of the rows fills many
ranges and a range holds about as many rows as any other.  A range's own running sums
start from what earlier ranges hold of its first key; those sums of ranges are as many as
there are ranges and keys' ends in them, and are summed up per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Rounds

#: Rows of a range, about.
RANGE_ROWS = 200_000


def running(rows: DataFrame, key: str, order: tuple[str, ...], sums: dict[str, Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with, for each name, the sum of an integer column over the rows of the same key that come before it.

    order: columns that put the rows of a key in order (rows that agree in all of them
    come one after the other in no certain order; end with an id).  Runs actions: the
    ranges are a written table.
    """
    values = {f"_v_{name}": F.coalesce(value.cast("long"), F.lit(0)) for name, value in sums.items()}
    ranges = max(1, -(-rows.count() // range_rows))
    dealt = rows.withColumns(values).repartitionByRange(ranges, F.col(key), *order).withColumn("_range", F.spark_partition_id())
    dealt = Rounds(rows.sparkSession, "ranges").put(dealt)
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(*(F.sum(v).alias(v) for v in values))
    # one row per key and range; of a key that fills many ranges, one per range
    offsets = held.select("_key", "_of", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o{v}") for v in values))
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = dealt.join(offsets, (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    return both.withColumns({name: F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0)) + F.col(f"_o_v_{name}") for name in sums}).drop("_range", "_key", "_of", *values, *(f"_o{v}" for v in values))


#: Cost is summed in billionths, so that sums do not depend on their order.
UNITS = 1_000_000_000


def budget_gate(priced: DataFrame, session_tokens: int, day_cost: float, estimate: int = 1000, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Calls (session_id, ts, event_id, input_tokens, output_tokens, cost) with what was used before each, and whether it may proceed.

    tokens (of its session), spent (of its day, over all sessions, in units of 1e-9),
    reason: session_tokens if its estimate would exceed the session's limit, else
    day_cost if the day's limit is reached, else null; allowed.
    """
    rows = priced.withColumn("day", F.to_date("ts"))
    units = F.round(F.col("cost") * UNITS)
    rows = running(rows, "session_id", ("ts", "event_id"), {"tokens": F.col("input_tokens") + F.col("output_tokens")}, range_rows)
    rows = running(rows, "day", ("ts", "event_id"), {"spent": units}, range_rows)
    reason = F.when(F.col("tokens") + estimate > session_tokens, "session_tokens").when(F.col("spent") >= round(day_cost * UNITS), "day_cost")
    return rows.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def budget_status(priced: DataFrame, session_cost: float, day_cost: float, session_tokens: int) -> DataFrame:
    """session_id, day (its last), what is used of the session's cost, the day's cost (in units of 1e-9) and the session's tokens, and the percentages."""
    units = F.sum(F.round(F.col("cost") * UNITS).cast("long"))
    last = priced.groupBy("session_id").agg(units.alias("session_used"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens_used"), F.to_date(F.max("ts")).alias("day"))
    days = priced.groupBy(F.to_date("ts").alias("of")).agg(units.alias("day_used"))  # one row a day
    percent = lambda used, limit: F.col(used) * 100 / F.lit(limit)
    joined = last.join(F.broadcast(days), F.col("day") == F.col("of")).drop("of")
    return joined.select("*", percent("session_used", session_cost * UNITS).alias("session_percent"), percent("day_used", day_cost * UNITS).alias("day_percent"), percent("tokens_used", session_tokens).alias("tokens_percent"))
