"""Session events: episodes, bursts, checkpoints, error resolutions, topic shifts, neighbours of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A new episode begins after such a gap (seconds); a burst is so many tool outputs within so many seconds.
EPISODE_GAP, BURST, BURST_SECONDS = 60, 10, 120
CHECKPOINT_EVENTS = 10
RESOLUTION_SECONDS = 300


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def by_time() -> Window:
    return Window.partitionBy("session_id").orderBy("ts", "event_id")


def episodes(events: DataFrame, gap: int = EPISODE_GAP) -> DataFrame:
    """Events with episode, from 1 in each session; a gap longer than ``gap`` seconds begins one."""
    new = F.coalesce((seconds(F.col("ts")) - seconds(F.lag("ts").over(by_time())) > gap).cast("int"), F.lit(1))
    return events.withColumn("_new", new).withColumn("episode", F.sum("_new").over(by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def episode_summary(with_episode: DataFrame) -> DataFrame:
    """session_id, episode, n, errors, outcome (error, success or open), first and last event."""
    last = F.max_by("exit_code", F.when(F.col("exit_code").isNotNull(), F.struct("ts", "event_id")))
    rolled = with_episode.groupBy("session_id", "episode").agg(F.count("*").alias("n"), F.count_if(F.col("exit_code") != 0).alias("errors"), last.alias("_last"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return rolled.withColumn("outcome", F.when(F.col("_last").isNull(), "open").when(F.col("_last") == 0, "success").otherwise("error")).drop("_last")


def session_rollup(events: DataFrame) -> DataFrame:
    """session_id, n, by type, distinct days."""
    return events.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "user_prompt").alias("prompts"), F.count_if(F.col("event_type") == "tool_output").alias("tool_outputs"), F.countDistinct(F.to_date("ts")).alias("days"))


def tool_bursts(events: DataFrame, least: int = BURST, within: int = BURST_SECONDS) -> DataFrame:
    """Tool outputs that end a burst: event_id, session_id, burst (tool outputs in the seconds up to it)."""
    frame = Window.partitionBy("session_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-within, 0)
    tools = events.filter("event_type = 'tool_output'").withColumn("burst", F.count("*").over(frame))
    return tools.filter(F.col("burst") >= least).select("event_id", "session_id", "burst")


def checkpoints(events: DataFrame, every: int = CHECKPOINT_EVENTS) -> DataFrame:
    """Events at which a session's checkpoint is due: session_id, checkpoint, event_id."""
    n = F.row_number().over(by_time())
    return events.withColumn("_n", n).filter(F.col("_n") % every == 0).select("session_id", (F.col("_n") / every).cast("int").alias("checkpoint"), "event_id")


def since(events: DataFrame, marker: Column) -> DataFrame:
    """The incremental scan: events strictly after a marker."""
    return events.filter(F.col("ts") > marker)


def error_resolutions(events: DataFrame, within: int = RESOLUTION_SECONDS) -> DataFrame:
    """Errors with the next success of their session, if it comes in time: error_id, success_id, seconds.

    One ordered pass: the next success is carried back over the session's events,
    so errors are never joined with successes.
    """
    ahead = by_time().rowsBetween(1, Window.unboundedFollowing)
    success = F.when(F.col("exit_code") == 0, F.struct("ts", "event_id"))
    found = events.withColumn("_next", F.first(success, ignorenulls=True).over(ahead)).filter((F.col("exit_code") != 0) & F.col("_next").isNotNull())
    took = seconds(F.col("_next.ts")) - seconds(F.col("ts"))
    return found.select(F.col("event_id").alias("error_id"), F.col("_next.event_id").alias("success_id"), took.alias("seconds")).filter(F.col("seconds") <= within)


def topic_shifts(events: DataFrame, topic: str) -> DataFrame:
    """Events whose topic differs from the session's last known one: event_id, previous, topic."""
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("previous", F.last(topic, ignorenulls=True).over(before))
    return seen.filter(F.col("previous").isNotNull() & F.col(topic).isNotNull() & (F.col("previous") != F.col(topic))).select("event_id", "session_id", "previous", F.col(topic).alias("topic"))


def neighbours(hits: DataFrame, turns: DataFrame, span: int = 1) -> DataFrame:
    """Hits with the turns around them: session_id, hit, pos, role, content."""
    wanted = hits.select("session_id", F.col("pos").alias("hit"), F.explode(F.sequence(F.col("pos") - span, F.col("pos") + span)).alias("at"))
    return wanted.join(turns.withColumnRenamed("session_id", "t_session"), (F.col("session_id") == F.col("t_session")) & (F.col("at") == F.col("pos"))).select("session_id", "hit", "pos", "role", "content")


def diversified(results: DataFrame) -> DataFrame:
    """Results (session_id, id, score) with place: each session's best first, then the rest."""
    own = Window.partitionBy("session_id").orderBy(F.desc("score"), "id")
    nth = results.withColumn("nth", F.row_number().over(own))
    order = Window.orderBy(F.when(F.col("nth") == 1, 0).otherwise(1), F.desc("score"), "id")
    return nth.withColumn("place", F.row_number().over(order))


def sessions_by_best(results: DataFrame) -> DataFrame:
    """Sessions by their best result: session_id, best, n."""
    return results.groupBy("session_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))


def latest_usage(entries: DataFrame, window: int = 200_000) -> DataFrame:
    """Per session, the tokens of its last entry and their percentage of the context window, to one decimal."""
    last = entries.groupBy("session_id").agg(F.max_by("tokens", F.struct("ts", "event_id")).alias("tokens"))
    return last.withColumn("percent", F.floor(F.col("tokens") * 1000 / window + 0.5) / 10)


def recent(events: DataFrame, limit: int, session: int | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """The newest events, of one session or of given types."""
    if session is not None:
        events = events.filter(F.col("session_id") == session)
    if types:
        events = events.filter(F.col("event_type").isin(*types))
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def buffer_statistics(events: DataFrame, now: Column, days: int = 1) -> DataFrame:
    """event_type, n, last_day: how many there are and how many are recent."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days))).alias("last_day"))


def analysis_due(buffers: DataFrame, most: int = 20, least: int = 5, seconds_old: int = 60) -> DataFrame:
    """session_id, due: buffers (session_id, n, age, learning) to be analysed: full, or with enough events and either old or with a learning moment."""
    due = (F.col("n") >= most) | ((F.col("n") >= least) & ((F.col("age") >= seconds_old) | F.col("learning")))
    return buffers.select("session_id", due.alias("due"))


# Phrases of a decision, of a correction, of talk about patterns (two of them make a moment).
DECIDED = ("i decided to", "we should use", "the approach will be", "going with", "choosing", "instead of using", "rather than")
CORRECTED = ("no, don't", "no, use", "that's wrong", "actually,", "not like that", "instead,", "you should", "never do", "always use")
PATTERNED = ("pattern", "architecture", "structure", "organize", "convention", "standard", "best practice", "in this project", "we follow")


def learning_moments(events: DataFrame) -> DataFrame:
    """session_id, error_resolution, explicit_decision, user_correction, architecture_pattern of buffered events.

    A success after a failure is told by the first failure and the last success, so no
    session is put in order; phrases are counted once for a session.
    """
    low = F.lower("content")
    said = lambda phrase: F.max(F.coalesce(F.contains(low, F.lit(phrase)), F.lit(False)).cast("int"))
    total = lambda phrases: sum((said(p) for p in phrases), F.lit(0))
    when = F.struct("ts", "event_id")
    first_failure, last_success = F.min(F.when(F.col("exit_code") != 0, when)), F.max(F.when(F.col("exit_code") == 0, when))
    return events.groupBy("session_id").agg(
        F.coalesce(first_failure < last_success, F.lit(False)).alias("error_resolution"),
        (total(DECIDED) >= 1).alias("explicit_decision"),
        (total(CORRECTED) >= 1).alias("user_correction"),
        (total(PATTERNED) >= 2).alias("architecture_pattern"),
    )
