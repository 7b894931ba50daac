"""Sources and sinks beyond parquet: exports, transcripts, conversation files, source files, rendered packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

OBJECT = "content string, objectType string, scope string, status string, confidence string, reviewStatus string, evidenceEventIds array<string>, codeRefs array<struct<path:string,type:string,symbol:string>>, createdAt string"


def export_objects(memories: DataFrame, path: str, status: tuple[str, ...] = ("active",)) -> None:
    """Memories of the given statuses as JSON lines, one object each, in as many files as there are partitions."""
    kept = memories.filter(F.col("status").isin(*status))
    rename = {"object_type": "objectType", "scope_path": "scope", "review_status": "reviewStatus", "created_at": "createdAt"}
    kept.select(*(F.col(c).alias(rename.get(c, c)) for c in kept.columns)).write.mode("overwrite").json(path)


def import_objects(spark: SparkSession, path: str, envelope: bool = False) -> DataFrame:
    """Exported objects with defaults and review status: approved if they were, or are sure and have evidence or references.

    ``envelope``: whole JSON documents {"version", "objects": [...]} instead of lines.
    """
    if envelope:
        rows = spark.read.schema(f"version string, objects array<struct<{OBJECT.replace(' string', ':string').replace(' array', ':array')}>>").option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select("o.*")
    else:
        rows = spark.read.schema(OBJECT).option("mode", "DROPMALFORMED").json(path)
    evidence = F.coalesce(F.size("evidenceEventIds") > 0, F.lit(False)) | F.coalesce(F.size("codeRefs") > 0, F.lit(False))
    trust = F.coalesce("confidence", F.lit("medium"))
    review = F.when(F.col("reviewStatus") == "approved", "approved").when(trust.isin("certain", "high") & evidence, "approved").otherwise(F.coalesce("reviewStatus", F.lit("pending")))
    return rows.filter("content is not null").select("content", F.col("objectType").alias("object_type"), F.col("scope").alias("scope_path"), trust.alias("confidence"), review.alias("review_status"), F.coalesce("evidenceEventIds", F.array()).alias("evidence"), "codeRefs")


USAGE = "input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, ts, tokens of transcript lines on the main chain that tell their usage; malformed lines are dropped."""
    inner = USAGE.replace(" long", ":long")
    rows = spark.read.schema(f"timestamp string, isSidechain boolean, isApiErrorMessage boolean, message struct<usage:struct<{inner}>>").option("mode", "DROPMALFORMED").json(path)
    told = rows.withColumn("file", F.input_file_name()).filter(~F.coalesce("isSidechain", F.lit(False)) & ~F.coalesce("isApiErrorMessage", F.lit(False)) & F.col("message.usage").isNotNull())
    part = lambda c: F.coalesce(F.col(f"message.usage.{c}"), F.lit(0))
    total = part("input_tokens") + part("output_tokens") + part("cache_read_input_tokens") + part("cache_creation_input_tokens")
    return told.select("file", F.coalesce(F.try_to_timestamp("timestamp"), F.lit(0).cast("timestamp")).alias("ts"), total.alias("tokens"))


def context_usage(spark: SparkSession, path: str, window: int = 200_000, threshold: float = 50.0) -> DataFrame:
    """file, tokens, percent, recommendation from each transcript's last line."""
    last = transcripts(spark, path).groupBy("file").agg(F.max_by("tokens", "ts").alias("tokens"))
    percent = F.col("tokens") * 100 / window
    return last.select("file", "tokens", (F.floor(percent * 10 + 0.5) / 10).alias("percent"), F.when(percent >= threshold, "checkpoint_and_clear").otherwise("continue").alias("recommendation"))


def conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Messages and questions of a conversation benchmark: a JSON array of items with numbered sessions.

    messages: session_id, nth, speaker, role, content, date; questions: question_id,
    question, answer, category, sessions (those its evidence names).
    """
    items = spark.read.option("multiLine", True).option("primitivesAsString", True).schema("sample_id string, conversation string, qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>").json(path)
    body = items.select("sample_id", F.from_json("conversation", "map<string,string>").alias("c"))
    named = body.select("sample_id", F.col("c")["speaker_a"].alias("a"), F.col("c").alias("all"), F.explode("c").alias("key", "value")).filter(F.col("key").rlike(r"^session_\d+$"))
    number = F.regexp_extract("key", r"(\d+)", 1)
    said = named.select(F.concat_ws("_D", "sample_id", number).alias("session_id"), "a", F.element_at("all", F.concat("key", F.lit("_date_time"))).alias("date"), F.explode(F.from_json("value", "map<string,struct<speaker:string,text:string>>")).alias("nth", "m"))
    messages = said.filter("nth rlike '^[0-9]+$' and length(m.text) > 0").select("session_id", F.col("nth").cast("int").alias("nth"), F.col("m.speaker").alias("speaker"), F.when(F.col("m.speaker") == F.col("a"), "user").otherwise("assistant").alias("role"), F.col("m.text").alias("content"), "date")
    dialogs = lambda e: F.array_distinct(F.filter(F.transform(e, lambda x: F.regexp_extract(x, r"D(\d+):\d+", 1)), lambda x: x != ""))
    asked = items.select("sample_id", F.posexplode("qa").alias("n", "q"))
    questions = asked.select(F.concat_ws("_q", "sample_id", "n").alias("question_id"), F.col("q.question").alias("question"), F.col("q.answer").alias("answer"), F.col("q.category").alias("category"), F.transform(dialogs(F.col("q.evidence")), lambda d: F.concat_ws("_D", "sample_id", d)).alias("sessions"))
    return messages, questions


def source_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, text of files below a folder."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def rendered(pack: DataFrame, form: str = "text") -> DataFrame:
    """One text for each tier of a pack (tier, id, object_type, content): text, yaml or json."""
    line = {
        "text": F.concat(F.lit("- ["), "object_type", F.lit("] "), "content"),
        "yaml": F.concat(F.lit("  - type: "), "object_type", F.lit('\n    content: "'), F.regexp_replace(F.regexp_replace("content", r'(["\\])', r"\\$1"), "\n", r"\\n"), F.lit('"')),
        "json": F.to_json(F.struct("id", "object_type", "content")),
    }[form]
    lines = pack.select("tier", "id", line.alias("line"))
    grouped = lines.groupBy("tier").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]).alias("lines"))
    glue = ",\n" if form == "json" else "\n"
    body = F.array_join("lines", glue)
    head = F.concat(F.initcap("tier"), F.lit(":\n")) if form == "text" else F.concat("tier", F.lit(":\n")) if form == "yaml" else F.lit("[")
    return grouped.select("tier", F.concat(head, body, F.lit("]" if form == "json" else "")).alias("text"))


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """project of a store partitioned by project: one row each, from the partition values."""
    return spark.read.parquet(root).select("project").distinct()


def save(memories: DataFrame, root: str) -> None:
    """Memories as parquet, a folder for each project, so that reads of one project touch no other."""
    memories.write.mode("append").partitionBy("project").parquet(root)


STATUSES = S.STATUSES
