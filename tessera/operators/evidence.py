"""Staleness against the code, snapshots, symbols and revalidation; files, changes and symbols are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("verified", "needs_review", "stale")


def references(memories: DataFrame) -> DataFrame:
    """memory_id, path, type, symbol, verified_at: one row for each code reference (code_refs: array of struct)."""
    return memories.select(F.col("id").alias("memory_id"), F.explode("code_refs").alias("r"), F.col("last_verified_at").alias("verified_at")).select("memory_id", "r.path", "r.type", "r.symbol", "verified_at")


def checked_references(refs: DataFrame, files: DataFrame, changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with level and reason: missing file or symbol: stale; changed since verification: needs_review.

    files: path; changes: path, changed_at; symbols: path, name.
    """
    last = changes.groupBy(F.col("path").alias("c_path")).agg(F.max("changed_at").alias("changed_at"))
    there = files.select(F.col("path").alias("f_path")).distinct()
    known = symbols.select(F.col("path").alias("s_path"), F.col("name").alias("s_name")).distinct()
    joined = refs.join(there, F.col("path") == F.col("f_path"), "left").join(known, (F.col("path") == F.col("s_path")) & (F.col("symbol") == F.col("s_name")), "left").join(last, F.col("path") == F.col("c_path"), "left")
    gone, lost = F.col("f_path").isNull(), F.col("symbol").isNotNull() & F.col("s_name").isNull()
    changed = F.coalesce(F.col("changed_at") > F.col("verified_at"), F.lit(False))
    level = F.when(gone | lost, "stale").when(changed, "needs_review").otherwise("verified")
    reason = F.when(gone, F.concat(F.lit("missing file "), F.col("path"))).when(lost, F.concat(F.lit("missing symbol "), F.col("symbol"))).when(changed, F.concat(F.lit("changed "), F.col("path")))
    return joined.select("memory_id", "path", "symbol", level.alias("level"), reason.alias("reason"))


def staleness(checked: DataFrame) -> DataFrame:
    """memory_id, level (the worst of its references), reasons."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    worst = checked.groupBy("memory_id").agg(F.max(rank).alias("w"), F.array_sort(F.collect_list("reason")).alias("reasons"))
    return worst.select("memory_id", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("w").cast("int")).alias("level"), "reasons")


def staleness_summary(levels: DataFrame) -> DataFrame:
    return levels.groupBy("level").agg(F.count("*").alias("n"))


def auto_verified(memories: DataFrame, levels: DataFrame, now: Column) -> DataFrame:
    """Memories with all references unchanged, stamped with now."""
    good = levels.filter("level = 'verified'").select(F.col("memory_id").alias("v_id"))
    joined = memories.join(good, F.col("id") == F.col("v_id"), "left")
    return joined.withColumn("last_verified_at", F.when(F.col("v_id").isNotNull(), now).otherwise(F.col("last_verified_at"))).drop("v_id")


def revalidation(memories: DataFrame, levels: DataFrame) -> DataFrame:
    """id, priority, reasons of memories to ask about, most urgent first: 3 missing, 2 changed, 1 unverified, more for constraints and decisions."""
    base = F.when(F.col("level") == "stale", 3.0).when(F.col("level") == "needs_review", 2.0).when(F.col("last_verified_at").isNull(), 1.0)
    extra = F.when(F.col("object_type") == "constraint", 1.0).when(F.col("object_type") == "decision", 0.5).otherwise(0.0)
    joined = memories.join(levels.withColumnRenamed("memory_id", "l_id"), F.col("id") == F.col("l_id"), "left")
    return joined.withColumn("priority", base + extra).filter("priority is not null").select("id", "priority", "reasons").orderBy(F.desc("priority"), "id")


def snapshots(files: DataFrame) -> DataFrame:
    """path, hash, size, lines of files (path, text)."""
    return files.select("path", F.substring(F.sha2("text", 256), 1, 16).alias("hash"), F.length("text").alias("size"), F.size(F.split("text", "\n", -1)).alias("lines"))


def line_range_hash(text: Column, first: Column, last: Column) -> Column:
    """Hash of lines first to last (from 1)."""
    return F.substring(F.sha2(F.array_join(F.slice(F.split(text, "\n", -1), first, last - first + 1), "\n"), 256), 1, 16)


# Kinds of symbols, with the pattern of a line that declares one (group 1: export, group 2: name).
SCRIPT = (
    ("function", r"^(export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)"),
    ("class", r"^(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("interface", r"^(export\s+)?interface\s+(\w+)"),
    ("type", r"^(export\s+)?type\s+(\w+)\s*(?:<[^=]*>)?\s*="),
    ("enum", r"^(export\s+)?(?:const\s+)?enum\s+(\w+)"),
    ("variable", r"^(export\s+)?(?:const|let|var)\s+(\w+)"),
)
PYTHON = (("class", r"^()class\s+(\w+)"), ("function", r"^()(?:async\s+)?def\s+(\w+)"), ("method", r"^()\s+(?:async\s+)?def\s+(\w+)"))


def symbols(files: DataFrame) -> DataFrame:
    """path, name, kind, line, exported of source files (path, text)."""
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    script = F.col("path").rlike(r"\.(?:ts|tsx|js|jsx|mjs)\z")
    python = F.col("path").endswith(".py")

    def made(kind: str, pattern: str, exported: Column) -> Column:
        return F.struct(F.regexp_extract("line", pattern, 2).alias("name"), F.lit(kind).alias("kind"), exported.alias("exported"))

    rules = [F.when(script & F.col("line").rlike(p), made(k, p, F.regexp_extract("line", p, 1) != "")) for k, p in SCRIPT]
    rules += [F.when(python & F.col("line").rlike(p), made(k, p, ~F.regexp_extract("line", p, 2).startswith("_"))) for k, p in PYTHON]
    return lines.withColumn("s", F.coalesce(*rules)).filter("s is not null").select("path", "s.name", "s.kind", (F.col("at") + 1).alias("line"), "s.exported")
