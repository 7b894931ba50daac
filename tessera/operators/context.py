"""Progressive context packs, escalation and disclosure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import language, text

# What a context level may hold.
LEVELS = {
    "minimal": {"budget": 200, "parts": ("constraint", "warning"), "constraints": 12, "share": 1.0},
    "task": {"budget": 500, "parts": ("constraint", "warning", "hot", "query"), "constraints": 20, "share": 0.6},
    "deep": {"budget": 1500, "parts": ("constraint", "warning", "hot", "query", "related", "history"), "constraints": 60, "share": 0.5},
}
PARTS = ("constraint", "warning", "hot", "query", "related", "history")
# Words that say nothing about a project.
COMMON = tuple("the and for with that this from are was were will would can could should must have has had not but you your our their its into about when then than use using used all any each other some only over under after before".split())


def content_key(content: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(content), r"[^a-z0-9]+", " "))


def keywords(content: Column) -> Column:
    """Distinct words of three characters or more that aren't common."""
    words = F.filter(F.split(F.lower(content), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, COMMON)))


def keyword_key(content: Column) -> Column:
    return F.array_join(F.sort_array(keywords(content)), " ")


def relevant(content: Column, project: Column) -> Column:
    """Shares a keyword with the project; texts or projects without any pass."""
    own = keywords(content)
    return (F.size(own) == 0) | (F.size(project) == 0) | F.arrays_overlap(own, project)


def candidates(parts: dict[str, DataFrame]) -> DataFrame:
    """One order of all candidates: part, rank (anything that can be ordered, of one type), id, content, object_type."""
    frames = [df.select(F.lit(PARTS.index(name)).alias("part"), F.lit(name).alias("part_name"), "rank", "id", "content", "object_type") for name, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


#: Rows of one part and size beyond those that fit, as some may repeat what is in the pack already in another size.
SPARE = 256


def within_budget(rows: DataFrame, total: int) -> DataFrame:
    """The rows (part, rank, id, tokens, key, words, ...) that a pack of ``total`` tokens can come to, however many there are.

    Of one size at most total / size rows can be taken, and the first come first; rows
    that repeat the text of an earlier one of their part and size are never taken.  What
    is left depends on the budget, not on the table.
    """
    alike = Window.partitionBy("part", "tokens", F.when(F.col("key") == "", F.col("id").cast("string")).otherwise(F.col("key"))).orderBy("rank", "id")
    size = Window.partitionBy("part", "tokens").orderBy("rank", "id")
    first = rows.filter(F.col("wanted") & (F.col("tokens") <= total)).withColumn("nth", F.row_number().over(alike)).filter("nth = 1")
    few = first.withColumn("nth", F.row_number().over(size)).filter(F.col("nth") <= total + SPARE)  # a constant, which is applied before rows are shuffled
    return few.filter(F.col("nth") <= F.floor(total / F.greatest("tokens", F.lit(1))) + SPARE).drop("nth")


def progressive(found: DataFrame, level: str, project: Sequence[str] = (), budget: int | None = None) -> DataFrame:
    """The pack of a level from candidates: place, part, id, tokens.

    A fold over the candidates in order (see within_budget for their number): each is
    taken if it is new (by id, by content, for constraints by keywords), relevant, and
    fits the budgets; what doesn't is passed over.
    """
    config = LEVELS[level]
    total = budget or config["budget"]
    most = int(total * config["share"])
    words = F.array(*map(F.lit, project)) if project else F.array().cast("array<string>")
    rows = found.filter(F.col("part_name").isin(*config["parts"])).select(
        "part", "rank", "id", "part_name", text.estimate_tokens(F.col("content")).alias("tokens"), content_key(F.col("content")).alias("key"),
        F.when(F.col("object_type") == "constraint", keyword_key(F.col("content"))).alias("words"),
        (F.col("object_type") == "constraint").alias("limit"),
        (relevant(F.col("content"), words) & ~((F.col("object_type") == "constraint") & text.ends_open(F.col("content")))).alias("wanted"),
    )
    row = "struct<part:string,id:bigint,tokens:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("limited"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("words"), F.array().cast(f"array<{row}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = ~F.array_contains(s["ids"], x["id"]) & ((x["key"] == "") | ~F.array_contains(s["keys"], x["key"]))
        fits = s["used"] + x["tokens"] <= total
        bound = ~x["limit"] | ((s["n"] < config["constraints"]) & (s["limited"] + x["tokens"] <= most) & ((F.coalesce(x["words"], F.lit("")) == "") | ~F.array_contains(s["words"], F.coalesce(x["words"], F.lit("")))))
        taken = F.struct(
            (s["used"] + x["tokens"]).alias("used"),
            (s["limited"] + F.when(x["limit"], x["tokens"]).otherwise(0)).alias("limited"),
            (s["n"] + x["limit"].cast("int")).alias("n"),
            F.concat(s["ids"], F.array(x["id"])).alias("ids"),
            F.concat(s["keys"], F.array(x["key"])).alias("keys"),
            F.when(x["limit"], F.concat(s["words"], F.array(F.coalesce(x["words"], F.lit(""))))).otherwise(s["words"]).alias("words"),
            F.concat(s["out"], F.array(F.struct(x["part_name"].alias("part"), x["id"].alias("id"), x["tokens"].alias("tokens")))).alias("out"),
        )
        return F.when(x["wanted"] & fresh & fits & bound, taken).otherwise(s)

    folded = within_budget(rows, total).agg(F.sort_array(F.collect_list(F.struct("part", "rank", "id", "part_name", "tokens", "key", "words", "limit", "wanted"))).alias("all"))
    return folded.select(F.posexplode(F.aggregate("all", start, step, lambda s: s["out"])).alias("place", "r")).select("place", "r.part", "r.id", "r.tokens")


def tier_breakdown(pack: DataFrame, tiered: DataFrame) -> DataFrame:
    counts = pack.select(F.col("id").alias("p_id")).join(tiered, F.col("p_id") == F.col("id"))
    return counts.agg(*(F.count_if(F.col("tier") == t).alias(t) for t in S.TIERS))


# Queries that ask for disclosure in so many words.
EXPLICIT = (r"remind\s+me", r"what\s+did\s+we\s+decide", r"what('s|s)?\s+the\s+constraint", r"what\s+should\s+i\s+(remember|know)", r"any\s+conventions?\s+for", r"what\s+went\s+wrong\s+(before|last\s+time)", r"what\s+failed\s+(before|previously)", r"how\s+did\s+we\s+fix", r"why\s+did\s+we\s+choose")
ERROR_BURST, EVENT_THRESHOLD, LEAST_GAP = 3, 15, 60


def escalation(sessions: DataFrame, now: Column) -> DataFrame:
    """session_id, trigger, confidence, level of sessions that need disclosure: the surest signal, the first of equals.

    sessions: session_id, query, file, previous_topic, error_count,
    events_since_checkpoint, events_count, last_disclosure_at.
    """
    from ..functions import score

    query = F.coalesce("query", F.lit(""))
    asked = language.intent(query)
    explicit = F.when(text.any_of([query.rlike(f"(?i){p}") for p in EXPLICIT]), 1.0).when(asked == "history", 0.8).when(asked == "debugging", 0.7)
    burst = F.when(F.col("error_count") >= ERROR_BURST, F.least(F.lit(1.0), F.col("error_count") / 5))
    shift = F.when(F.col("file").isNotNull() & F.col("previous_topic").isNotNull() & (F.col("file") != F.col("previous_topic")), 0.7)
    quiet = F.coalesce(score.days_between(now, F.col("last_disclosure_at")) * 86400 >= LEAST_GAP, F.lit(True))
    many = F.when((F.col("events_since_checkpoint") >= EVENT_THRESHOLD) & quiet, 0.5)
    signal = lambda c, name, order, level: F.when(c.isNotNull(), F.struct((-c).alias("c"), F.lit(order).alias("o"), F.lit(name).alias("trigger"), level.alias("level")))
    by_count = F.when(F.col("events_count") >= 75, "deep").otherwise("task")
    first = F.array_min(F.array_compact(F.array(signal(explicit, "explicit_query", 0, F.lit("deep")), signal(burst, "error_burst", 1, F.lit("deep")), signal(shift, "topic_shift", 2, F.lit("task")), signal(many, "event_threshold", 3, by_count))))
    return sessions.select("session_id", first.alias("s")).filter("s is not null").select("session_id", "s.trigger", (-F.col("s.c")).alias("confidence"), "s.level")


DISCLOSED = {"minimal": 3, "task": 8, "deep": 15}
FOCUS = ("constraint", "known_fix", "failed_attempt")


def disclosed(memories: DataFrame, injected: DataFrame, level: str, trigger: str | None = None, newest: int = 50) -> DataFrame:
    """The memories to inject next, place and id: the newest active ones not yet injected, after an error burst certain types first."""
    fresh = memories.filter("status = 'active'").orderBy(F.desc("created_at"), "id").limit(newest).join(injected.select(F.col("id").alias("i_id")), F.col("id") == F.col("i_id"), "left_anti")
    focus = F.when(F.col("object_type").isin(*FOCUS), 0).otherwise(1) if trigger == "error_burst" else F.lit(0)
    order = Window.orderBy(focus, F.desc("created_at"), "id")  # at most ``newest`` rows
    return fresh.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= DISCLOSED[level]).select("place", "id", "object_type")
