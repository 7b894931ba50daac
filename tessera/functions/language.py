"""Classifiers of queries and statements: intent, scope, level, extraction votes, corrections, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, ascii_words, needed

# Patterns (3 points each) and keywords (1 point each) of the intents, in order of precedence.
INTENTS = {
    "debugging": (
        (r"why\s+(is|does|did|are|do)\s+.*\s*(fail|error|crash|break|bug)", r"how\s+to\s+fix", r"not\s+working", r"getting\s+(an?\s+)?error", r"what('s|s)?\s+wrong", r"debug(ging)?", r"troubleshoot"),
        ("error", "fail", "failed", "failing", "failure", "bug", "crash", "broken", "break", "issue", "problem", "wrong", "fix", "debug", "troubleshoot", "exception", "stack trace", "stacktrace"),
    ),
    "conventions": (
        (r"how\s+(do|should)\s+we\s+(name|format|style|organize)", r"what('s|s)?\s+(the|our)\s+(naming|style|convention)", r"convention(s)?\s+for", r"best\s+practice", r"coding\s+style", r"how\s+are\s+.*\s+named"),
        ("convention", "conventions", "style", "naming", "format", "formatting", "standard", "standards", "best practice", "practices", "guideline", "guidelines", "how do we", "how should we"),
    ),
    "implementation": (
        (r"how\s+(do\s+i|to|can\s+i)\s+(add|create|build|implement|make)", r"implement(ing)?\s+", r"add(ing)?\s+(a|an|the)\s+", r"create\s+(a|an|the)\s+", r"build(ing)?\s+", r"write\s+(a|an|the)\s+"),
        ("implement", "implementation", "add", "adding", "create", "creating", "build", "building", "write", "writing", "make", "making", "how do i", "how to", "how can i"),
    ),
    "architecture": (
        (r"what('s|s)?\s+(the\s+)?(structure|architecture|design)", r"how\s+is\s+.*\s+(structured|organized|designed)", r"architecture\s+of", r"design\s+pattern", r"system\s+design"),
        ("architecture", "structure", "design", "pattern", "organized", "layout", "diagram", "overview", "high level", "high-level", "system"),
    ),
    "history": (
        (r"what\s+did\s+we\s+decide", r"why\s+did\s+we\s+(choose|decide|pick|use)", r"when\s+did\s+we", r"history\s+of", r"previous(ly)?", r"what\s+was\s+the\s+decision"),
        ("decided", "decision", "chose", "chosen", "picked", "history", "previous", "previously", "past", "why did we", "what did we", "when did we", "rationale", "reasoning"),
    ),
    "validation": (
        (r"is\s+(this|that|it)\s+still\s+(true|valid|correct)", r"still\s+(true|valid|correct|accurate)", r"verify\s+(that|if|whether)", r"confirm\s+(that|if|whether)", r"check\s+if", r"is\s+.*\s+still\s+"),
        ("still true", "still valid", "still correct", "verify", "validate", "confirm", "check", "accurate", "up to date", "up-to-date", "current"),
    ),
}

# What makes a query exploratory or complex.
EXPLORATORY = (r"^how\s+(do|does|can|should|would)", r"^what\s+(is|are|was|were|does|do)", r"^why\s+(is|are|do|does|did|would)", r"^when\s+(should|do|does|did)", r"^where\s+(is|are|do|does|should)", r"^which\s+(is|are|should|would)", r"explain", r"tell me about", r"describe", r"walk me through")
COMPLEX = (r"architecture", r"design\s+(pattern|decision)", r"trade-?off", r"comparison", r"difference\s+between", r"history\s+of", r"evolution", r"all\s+(the|of)", r"everything\s+about", r"comprehensive", r"complete\s+(overview|picture|understanding)")

# How a query names a module, an area, a file.
MODULE = r"(?i)(?:in\s+(?:the\s+)?|the\s+)([a-zA-Z0-9_-]+)\s+(?:module|directory|folder|package|component|service)"
AREA = r"(?i)(?:in\s+|the\s+)?([a-zA-Z0-9_-]+)\s+(?:code|logic|layer|part)"
FILE = r"([A-Za-z0-9_./-]+\.[a-zA-Z]{1,5})\b"
# Names of areas, in the order in which they are looked for.
AREAS = tuple(
    """auth authentication authorization api rest graphql database db storage store stores ui frontend client components
    backend server service services test tests testing utils helpers lib common shared config configuration settings models
    types interfaces schemas routes routing router middleware handlers controllers""".split()
)

# Patterns of the types of extracted memories, in order of precedence.
EXTRACTION = {
    "decision": (r"(?:chose|decided|going with|using|switched to)", r"(?:instead of|rather than|over)", r"let's use", r"we should", r"going forward", r"I'll implement", r"the approach is", r"we'll go with"),
    "constraint": (r"(?:must|always|never|required|cannot)", r"(?:strict mode|no implicit|forbidden)", r"don't ever", r"make sure to always", r"critical", r"security|vulnerability|cve-", r"breaking change", r"deprecated"),
    "known_fix": (r"(?:fixed by|solution:|workaround:|use .* instead)", r"(?:the fix is|resolved by|works when)", r"that fixed it", r"solved by", r"the issue was", r"turns out", r"the problem was", r"now it works"),
    "convention": (r"(?:convention|pattern|style|format|naming)", r"(?:we use|always use|standard is)", r"in this codebase", r"our style", r"following the pattern", r"consistent with", r"as we do in"),
    "preference": (r"(?:prefer|like|better|rather)", r"(?:usually|typically|generally)", r"i prefer", r"works better", r"cleaner|simpler|easier", r"more readable"),
    "environment": (r"(?:version|node|python|bun|npm)", r"(?:config|env|environment)", r"running on", r"using version", r"requires.*version", r"installed|package\.json"),
}

# What a user forbids or asks for.
MUST = (r"(?:don't|do not|never)\s+(.{10,}?)(?:\.|\z)", r"(?:must|required to|have to)\s+always\s+(.{10,}?)(?:\.|\z)", r"(?:you\s+)?(?:must|should)\s+never\s+(.{10,}?)(?:\.|\z)")
SHOULD = (r"(?:please\s+)?(?:always|make sure to)\s+(.{10,}?)(?:\.|\z)", r"(?:you\s+)?should\s+(?:always\s+)?(.{10,}?)(?:\.|\z)", r"(?:instead|rather),?\s+(.{10,}?)(?:\.|\z)")
CORRECTION = r"^\s*(?:no|nope|wrong|incorrect|don't|stop)"


def hits(text: Column, low: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns (any case) match; low: the text in lower case, where each pattern's words are looked for first."""

    def match(pattern: str) -> Column:
        found, words = text.rlike(ascii_words(f"(?i){pattern}")), needed(pattern)
        return any_of([F.contains(low, F.lit(w)) for w in words]) & found if words else found

    return sum((match(p).cast("int") for p in patterns), F.lit(0))


def lowered_once(text: Column, made) -> Column:
    """``made`` of a text and its lower case, which is computed once."""
    bound = F.array(F.struct(text.alias("text"), F.lower(text).alias("low")))
    return F.element_at(F.transform(bound, lambda s: made(s["text"], s["low"])), 1)


def first_largest(scores: dict[str, Column], least: int, otherwise: str | None) -> Column:
    """The name of the largest score, the first of equals, if it reaches ``least``."""
    top = F.greatest(*scores.values())
    out = F.lit(otherwise)
    for name, value in reversed(scores.items()):
        out = F.when((value == top) & (top >= least), F.lit(name)).otherwise(out)
    return out


def counted_once(scores: dict[str, Column], made) -> Column:
    """``made`` of scores (by name) that are computed once."""
    bound = F.array(F.struct(*(v.alias(n) for n, v in scores.items())))
    return F.element_at(F.transform(bound, lambda s: made({n: s[n] for n in scores})), 1)


def intent(query: Column) -> Column:
    def made(text: Column, low: Column) -> Column:
        points = {name: 3 * hits(text, low, patterns) + sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0)) for name, (patterns, keywords) in INTENTS.items()}
        return counted_once(points, lambda p: first_largest(p, 2, "general"))

    return lowered_once(query, made)


def scope(query: Column) -> Column:
    """struct(type, path, confidence) that a query hints at; null without a hint."""
    part = lambda pattern: F.nullif(F.regexp_extract(query, ascii_words(pattern), 1), F.lit(""))
    made = lambda kind, path, trust: F.struct(F.lit(kind).alias("type"), path.alias("path"), F.lit(trust).alias("confidence"))
    area = F.lower(part(AREA))
    low = F.lower(query)
    named = F.coalesce(*(F.when(F.contains(low, F.lit(a)), F.lit(a)) for a in AREAS))
    return (
        F.when(part(FILE).isNotNull(), made("file", part(FILE), "high"))
        .when(part(MODULE).isNotNull(), made("module", F.lower(part(MODULE)), "medium"))
        .when(area.isin(*AREAS), made("module", area, "medium"))
        .when(named.isNotNull(), made("module", named, "low"))
    )


def scope_match(kind: Column, path: Column, query_kind: Column, query_path: Column) -> Column:
    """0 to 1: how well a memory's scope fits the query's."""
    mine, theirs = F.split(F.lower(path), "/"), F.split(F.lower(query_path), "/")
    common = F.size(F.filter(mine, lambda p: F.array_contains(theirs, p)))
    return (
        F.when((kind == query_kind) & path.eqNullSafe(query_path), 1.0)
        .when((query_kind == "module") & (kind == "file") & F.contains(path, query_path), 0.8)
        .when((query_kind == "file") & (kind == "module") & F.contains(query_path, path), 0.6)
        .when(common > 0, 0.4 * common / F.greatest(F.size(mine), F.size(theirs)))
        .when(kind == "global", 0.1)
        .otherwise(0.0)
    )


def level(query: Column, simple: tuple[str, ...] = ()) -> Column:
    """minimal, deep or task: how much context a query asks for."""
    is_ = lambda patterns: any_of([query.rlike(f"(?i){p}") for p in patterns])
    return F.when(is_(simple), "minimal").when(is_(COMPLEX), "deep").otherwise("task")


def sentences(text: Column, least: int = 10) -> Column:
    """Distinct sentences and lines of more than ``least`` characters."""
    cut = lambda pattern: F.transform(F.split(text, pattern), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(F.concat(cut(r"(?<=[.!?])\s+"), cut(r"\n+")), lambda s: F.length(s) > least))


def statements(text: Column, least: int) -> Column:
    """Sentences and lines of at least ``least`` characters, cut in one go, in order."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) >= least)


def extraction(text: Column) -> Column:
    """struct(type, hits, confidence) by pattern votes; null without a vote."""

    def winner(v: dict[str, Column]) -> Column:
        top = F.greatest(*v.values())
        trust = F.when(top >= 3, "high").when(top == 2, "medium").otherwise("low")
        return F.when(top > 0, F.struct(first_largest(v, 1, None).alias("type"), top.alias("hits"), trust.alias("confidence")))

    return lowered_once(text, lambda text, low: counted_once({name: hits(text, low, patterns) for name, patterns in EXTRACTION.items()}, winner))


def corrections(text: Column) -> Column:
    """array of struct(content, severity): hard constraints, and soft ones where the text opens as a correction."""
    found = lambda patterns, severity: [F.when(text.rlike(f"(?i){p}"), F.struct(F.trim(F.regexp_extract(text, f"(?i){p}", 0)).alias("content"), F.lit(severity).alias("severity"))) for p in patterns]
    opens = text.rlike(f"(?i){CORRECTION}")
    soft = [F.when(opens, c) for c in found(SHOULD, "should")]
    return F.array_compact(F.array(*found(MUST, "must"), *soft))


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NAMED = "|".join(MONTHS)


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)).cast("int")


def rolled_date(year: Column, month: Column, day: Column) -> Column:
    """A date whose day (or month) may exceed its month (or year) and then runs on."""
    months = year * 12 + month - 1
    first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.date_add(first, (day - 1).cast("int"))


def session_date(text: Column) -> Column:
    """The date in ``h:mm am on D Month, YYYY`` or ``D Month YYYY``."""
    p = r"(?i)(\d{1,2})\s+([A-Za-z]+),?\s*(\d{4})"
    part = lambda g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    month = month_number(part(2))
    return F.when(month > 0, rolled_date(part(3).cast("int"), month, part(1).cast("int")))


def anchored_date(anchor: Column, session: Column) -> Column:
    """The date an expression means: explicit, else relative to the session's, else the session's."""

    def part(pattern: str, g: int) -> Column:
        return F.nullif(F.regexp_extract(anchor, ascii_words(f"(?i){pattern}"), g), F.lit(""))

    number = lambda c: F.try_to_number(c, F.lit("999999")).cast("int")
    dmy, mdy, dm = rf"\b(\d{{1,2}})\s+({NAMED})\s+(\d{{4}})\b", rf"\b({NAMED})\s+(\d{{1,2}})(?:,?\s+(\d{{4}}))?\b", rf"\b(\d{{1,2}})\s+({NAMED})\b"
    ago = r"\b(\d+|a|an)\s+(day|week|month|year)s?\s+ago\b"
    named = r"\b(last|this|next)\s+(week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
    year = F.year(session)
    found = {
        "y": F.coalesce(number(part(dmy, 3)), number(part(mdy, 3)), year),
        "m": F.coalesce(month_number(part(dmy, 2)), month_number(part(mdy, 1)), month_number(part(dm, 2))),
        "d": F.coalesce(number(part(dmy, 1)), number(part(mdy, 2)), number(part(dm, 1))),
        "today": anchor.rlike(ascii_words(r"(?i)\b(today|tonight)\b")),
        "yesterday": anchor.rlike(ascii_words(r"(?i)\byesterday\b")),
        "n": F.when(F.lower(part(ago, 1)).isin("a", "an"), 1).otherwise(number(part(ago, 1))),
        "units": F.lower(part(ago, 2)),
        "way": F.lower(part(named, 1)),
        "unit": F.lower(part(named, 2)),
        "from": session,
    }

    def meant(f: dict[str, Column]) -> Column:
        start = f["from"]

        def shifted(n: Column, u: Column) -> Column:
            months = F.when(u == "month", n).when(u == "year", n * 12)
            return F.when(u.isin("day", "week"), F.date_add(start, F.when(u == "week", n * 7).otherwise(n).cast("int"))).otherwise(rolled_date(F.year(start), F.month(start) + months, F.day(start)))

        days = F.array(*map(F.lit, ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")))
        delta = F.array_position(days, f["unit"]) - F.dayofweek(start)
        delta = F.when((f["way"] == "last") & (delta >= 0), delta - 7).when((f["way"] == "next") & (delta <= 0), delta + 7).otherwise(delta)
        n = F.when(f["n"].isNotNull(), -f["n"]).when(f["way"] == "last", -1).otherwise(1)
        relative = (
            F.when(f["today"], start)
            .when(f["yesterday"], F.date_sub(start, 1))
            .when(f["n"].isNull() & f["unit"].endswith("day"), F.date_add(start, delta.cast("int")))
            .when(f["n"].isNull() & (f["way"] == "this"), start)
            .when(f["n"].isNotNull() | f["way"].isNotNull(), shifted(n, F.when(f["n"].isNotNull(), f["units"]).otherwise(f["unit"])))
        )
        return F.coalesce(F.when(f["m"].isNotNull(), rolled_date(f["y"], f["m"], f["d"])), relative, start)

    return counted_once(found, meant)
