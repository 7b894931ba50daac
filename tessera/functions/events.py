"""What an event says in short: synopses, signals, exit codes, code paths; and the small tables of tiers and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from . import text as X

#: Longer contents are kept apart from the log, with a synopsis.
INLINE_CHARS = 500


def first_group(content: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.when(content.rlike(p), F.regexp_extract(content, p, 1)) for p in patterns))


def size_label(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1048576, F.format_string("%.1fKB", n / 1024)).otherwise(F.format_string("%.1fMB", n / 1048576))


def lines(content: Column) -> Column:
    return F.size(F.split(content, "\n", -1))


PASSED, FAILED = r"(?i)(\d+)\s*(?:tests?\s+)?(?:pass|passed|✓)", r"(?i)(\d+)\s*(?:tests?\s+)?(?:fail|failed|✗)"


def counted(content: Column, pattern: str) -> Column:
    return F.when(content.rlike(pattern), F.regexp_extract(content, pattern, 1).cast("int"))


def synopsis(content: Column, kind: Column, tool: Column, exit_code: Column, path: Column) -> Column:
    """One line on an event, by its kind."""
    n = F.length(content)
    name = F.coalesce(tool, F.lit("unknown"))
    state = F.when(exit_code == 0, "success").when(exit_code.isNotNull(), F.concat(F.lit("failed ("), exit_code.cast("string"), F.lit(")"))).otherwise("completed")
    command, target = first_group(content, r"(?m)^\$\s*(.+?)(?:\n|\z)"), first_group(content, r"""(?i)(?:path|file):\s*["']?([^"'\n]+)""")
    detail = (
        F.when(name.isin("bash", "shell"), F.concat(F.lit(": "), F.substring(command, 1, 50)))
        .when(name == "read", F.concat(F.lit(": "), lines(content).cast("string"), F.lit(" lines")))
        .when(name.isin("edit", "write"), F.concat(F.lit(": "), target))
    )
    of_tool = F.concat(name, F.lit(": "), state, F.coalesce(detail, F.lit("")), F.lit(" ("), size_label(n), F.lit(")"))
    said = first_group(content, r"(?i)error[:\s]+(.+?)(?:\n|\z)", r"(?i)exception[:\s]+(.+?)(?:\n|\z)", r"(?i)failed[:\s]+(.+?)(?:\n|\z)", r"(?im)^(.+?error.+?)$")
    of_error = F.concat(F.lit("Error: "), F.substring(F.coalesce(said, content), 1, 100))
    good, bad = F.coalesce(counted(content, PASSED), F.lit(0)), F.coalesce(counted(content, FAILED), F.lit(0))
    of_tests = (
        F.when((good > 0) | (bad > 0), F.concat(F.lit("Tests: "), good.cast("string"), F.lit(" passed, "), bad.cast("string"), F.lit(" failed")))
        .when(content.rlike(r"(?i)all (?:tests? )?pass"), "Tests: all passed")
        .when(content.rlike(r"(?i)(?:test|tests) failed"), "Tests: failed")
        .otherwise(F.concat(F.lit("Tests: "), F.substring(content, 1, 80)))
    )
    files = F.regexp_extract_all(content, F.lit(r"(?m)^(?:diff|---|\+\+\+)\s+[ab]?/?(.+?)(?:\s|\z)"), F.lit(1))
    added, removed = F.regexp_count(content, F.lit(r"(?m)^\+[^+]")), F.regexp_count(content, F.lit(r"(?m)^-[^-]"))
    of_diff = F.concat(F.lit("Diff: "), F.coalesce(path, F.trim(F.get(files, 0)), F.lit("unknown")), F.lit(" (+"), added.cast("string"), F.lit("/-"), removed.cast("string"), F.lit(")"))
    plain = F.concat(kind, F.lit(": "), lines(content).cast("string"), F.lit(" lines, "), size_label(n))
    return F.when(kind == "tool_output", of_tool).when(kind == "error", of_error).when(kind == "test_summary", of_tests).when(kind == "diff", of_diff).otherwise(plain)


def signals(content: Column, kind: Column, tool: Column, exit_code: Column) -> Column:
    """struct(line_count, char_count, exit_code, files, error, passed, failed)."""
    patterns = (r"(?i)(?:modified|changed|created|deleted):\s*([^\s]+)", r"(?m)^(?:M|A|D|R)\s+(.+)$", r"(?m)(?:---|\+\+\+)\s+[ab]?/?(.+?)(?:\s|\z)")
    found = F.transform(F.concat(*(F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns)), lambda f: F.trim(f))
    files = F.array_distinct(F.filter(found, lambda f: (f != "") & ~f.startswith("/dev/null") & ~f.startswith("dev/null")))
    wrong = (kind == "error") | F.coalesce(exit_code != 0, F.lit(False))
    error = F.substring(F.trim(first_group(content, r"(?im)error[:\s]+(.+?)$", r"(?im)exception[:\s]+(.+?)$", r"(?im)^(.+?error.+?)$")), 1, 200)
    tests = (kind == "test_summary") | F.coalesce(tool.rlike("(?i)test|spec"), F.lit(False))
    return F.struct(
        lines(content).alias("line_count"),
        F.length(content).alias("char_count"),
        exit_code.alias("exit_code"),
        files.alias("files"),
        F.when(wrong, error).alias("error"),
        F.when(tests, counted(content, PASSED)).alias("passed"),
        F.when(tests, counted(content, FAILED)).alias("failed"),
    )


def inferred_exit_code(tool: Column, result: Column) -> Column:
    """Of shell results: the code they name, else 1 where they look like a failure; null otherwise."""
    named = F.nullif(F.regexp_extract(result, r"(?i)exit code:?\s*(\d+)", 1), F.lit("")).cast("int")
    failed = F.when(result.rlike(r"(?i)error|failed|command not found|permission denied|no such file"), 1)
    return F.when(F.lower(tool) == "bash", F.coalesce(named, failed))


# How source files are named in texts.
KINDS = "ts|js|tsx|jsx"
CODE_PATHS = (
    rf"""(?i)(?:file|path):\s*["']?([^\s"']+\.(?:{KINDS}|py|rs|go|java|c|cpp|h|md|json|yaml|yml|toml))""",
    rf"(?i)at\s+([^\s:]+\.(?:{KINDS}|py)):?\d*",
    r"""(?i)(?:from|require\s*\()\s*["']\.?\.?/([^"']+)["']""",
    rf"(?im)(?:^|\s)((?:src|lib|test|dist)/[^\s:]+\.(?:{KINDS}|py))",
)


def code_paths(content: Column) -> Column:
    """Distinct paths of code that a text names, without a leading ./"""
    found = F.concat(*(F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in CODE_PATHS))
    return F.array_distinct(F.transform(F.filter(found, lambda p: F.length(p).between(3, 199)), lambda p: F.regexp_replace(p, r"^\./", "")))


def upgraded_tier(tier: Column, refs: Column, verified: Column, approved: Column, evidence: Column) -> Column:
    return F.when(refs & verified, "grounded").when(approved | evidence, F.when(tier == "grounded", "grounded").otherwise("observed")).when(refs & (tier == "hypothesis"), "inferred").otherwise(tier)


# What a tier falls to, by reason.
FALLS = {
    "file_deleted": {"grounded": "observed"},
    "file_changed": {"grounded": "inferred"},
    "time_decay": {"grounded": "observed", "observed": "inferred"},
    "conflict": {"grounded": "inferred", "observed": "hypothesis"},
}


def downgraded_tier(tier: Column, reason: Column) -> Column:
    out = tier
    for why, falls in FALLS.items():
        for high, low in falls.items():
            out = F.when((reason == why) & (tier == high), low).otherwise(out)
    return out


LEVELS = ("minimal", "task", "deep")


def upgraded_level(level: Column, answer: Column) -> Column:
    """A level more where an answer is in doubt, two from three doubts on, up to deep."""
    n = F.size(X.uncertainty(answer)["triggers"])
    at = F.array_position(F.array(*map(F.lit, LEVELS)), level)
    to = F.least(at + F.when(n >= 3, 2).when(n >= 1, 1).otherwise(0), F.lit(len(LEVELS)))
    return F.element_at(F.array(*map(F.lit, LEVELS)), to.cast("int"))


def recommended_level(query: Column) -> Column:
    n = F.length(query)
    return F.when(query.rlike(r"(?i)architect|design|structure|history|evolution|all|everything") | (n > 100), "deep").when(query.rlike(r"(?i)status|check|valid|still") | (n < 20), "minimal").otherwise("task")


# Question words, and words that say nothing in a question.
ASKING = ("What", "When", "Where", "Why", "How", "Which", "Who")
EMPTY = tuple("what when where why how which who did does do is are was were be been being the a an to of in on for with and or but about into during after before over under between both compare versus vs together relationship likely".split())


def query_signals(query: Column) -> Column:
    """struct(counting, multi_hop, temporal, names, keywords) of a question."""
    low = F.lower(query)
    names = F.transform(F.array_except(F.regexp_extract_all(query, F.lit(X.ascii_words(r"\b[A-Z][a-z]+\b")), F.lit(0)), F.array(*map(F.lit, ASKING))), lambda w: F.lower(w))
    words = F.filter(F.split(F.regexp_replace(low, r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*EMPTY))
    return F.struct(
        low.rlike(X.ascii_words(r"how many|number of|times\b|count\b")).alias("counting"),
        low.rlike(X.ascii_words(r"and|both|compare|versus|vs\b|together|relationship|between")).alias("multi_hop"),
        low.rlike(r"when|what date|what time|how long ago|before|after|during|last\s+\w+|next\s+\w+").alias("temporal"),
        names.alias("names"),
        words.alias("keywords"),
    )


def fact_score(subject: Column, predicate: Column, content: Column, asked: Column) -> Column:
    """How well a fact answers a question with these signals."""
    named = F.array_contains(asked["names"], F.lower(subject))
    hits = F.size(F.filter(asked["keywords"], lambda k: F.contains(F.lower(content), k)))
    return F.when(named, 3).otherwise(0) + hits + F.when(asked["counting"] & (predicate == "went_to"), 2).otherwise(0) + F.when(asked["multi_hop"] & (F.size(asked["names"]) > 1) & named, 1).otherwise(0)


TIERS = S.TIERS
