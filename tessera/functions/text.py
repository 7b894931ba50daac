"""Text keys, tokens, hashes and the classifiers made of patterns, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_words(pattern: str) -> str:
    """A pattern whose \\b lies beside ASCII letters, digits and _ only, as \\w does; the engine's own heeds all letters."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def needed(pattern: str) -> tuple[str, ...]:
    """Words in lower case of which a text holds one if it matches a pattern (in any case): of each alternative its longest.

    None if groups are nested, or if an alternative has no word of its own.
    """
    whole = re.fullmatch(r"\(\?:([^()]*)\)", pattern)
    plain = re.sub(r"\([^()]*\)[?*+]?|\[[^]]*\][?*+]?|\\.[?*+]?|[^|](?:[?*]|\{[^}]*\})|[.^$+]", "\n", whole[1] if whole else pattern)
    words = tuple(max(part.split("\n"), key=len).lower() for part in plain.split("|"))
    return words if all(words) and not set(plain) & set("()[]{}") else ()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def estimate_tokens(text: Column) -> Column:
    """About four characters a token, at least one a word; blank: 0."""
    by_word = F.regexp_count(text, F.lit(r"\S{1,4}")).cast("long")  # of each word as many as it has fours of characters, rounded up
    rough = F.ceil(F.length(text) / 4).cast("long")
    return F.when(text.isNull() | (by_word == 0), F.lit(0).cast("long")).otherwise(F.greatest(rough, by_word))


def content_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


#: What separates words for ``rolling_hash``, beyond ASCII white space.
SPACES = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def rolling_hash(text: Column) -> Column:
    """Key prefix_length_checksum of squeezed lower-cased text.

    The prefix has 32 characters, the checksum is a 32-bit h * 31 + c, without its sign,
    in base 36; characters are those of UTF-16 (a prefix doesn't end within a pair).
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), SPACES, " "), "^ | $", "")
    units = lambda t: F.floor(F.octet_length(F.encode(t, "UTF-16BE")) / 2)
    wrap = lambda h: F.pmod(h + 2147483648, F.lit(4294967296)) - 2147483648

    def add(h: Column, char: Column) -> Column:
        c = F.ascii(char).cast("long")
        high, low = 0xD800 + F.shiftright(c - 0x10000, 10), 0xDC00 + F.pmod(c, F.lit(1024))
        return F.when(c < 0x10000, wrap(h * 31 + c)).otherwise(wrap(wrap(h * 31 + high) * 31 + low))

    total = F.aggregate(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)), F.lit(0).cast("long"), add)
    cut = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(32)), lambda k: units(F.substring(plain, F.lit(1), k)) <= 32))
    return F.concat_ws("_", F.substring(plain, F.lit(1), cut), units(plain).cast("string"), F.lower(F.conv(F.abs(total).cast("string"), 10, 36)))


def duplicate_key(text: Column) -> Column:
    return F.substring(F.trim(F.lower(text)), 1, 200)


def words_of(text: Column) -> Column:
    """Terms for lexical search: lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def plain_words(text: Column, kept: str = r"\w") -> Column:
    """Distinct words, runs of ``kept`` of more than two characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"[{kept}]{{3,}}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


# Words that a search drops.
STOP_WORDS = tuple(
    """a an the is are was were be been being have has had do does did will would could should may might must shall can
    need dare to of in for on with at by from as into through during before after above below between under again further
    then once here there when where why how all each few more most other some such no nor only own same so than too very
    s t just don now i me my myself we our ours you your yours he him his she her hers it its they them their what which
    who this that these those am about get""".split()
)
OPERATORS = ("AND", "OR", "NOT", "NEAR")
PUNCTUATION = r"""[":*^~(){}\[\].!?;,\-/\\'`+|<>=@#$%&]"""


def search_terms(query: Column) -> Column:
    """The words of a query that are searched for; any of them may match."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(query, PUNCTUATION, " "), r"\s+", " ")), " ")
    keep = lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*STOP_WORDS) & ~F.upper(w).isin(*OPERATORS)
    return F.filter(words, keep)


# Families of significant tokens, in the order in which they claim a token.
TOKEN_FAMILIES = (
    ("identifier", r"\b[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b|\b[A-Z][a-z]+[A-Z][a-zA-Z0-9]*\b"),
    ("identifier", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"),
    ("path", r"(?:/[\w.-]+)+(?:\.\w+)?|\b[\w.-]+/[\w./-]+"),
    ("command", r"(?i)\b(?:npm|yarn|bun|pnpm|cargo|uv|pip|git|docker|kubectl)\s+[a-z-]+"),
    ("flag", r"(?i)--?[a-z][a-z0-9-]*"),
    ("version", r"(?i)\b\d+\.\d+(?:\.\d+)?(?:-[a-z0-9.]+)?\b"),
    ("error_code", r"\b(?:E|ERR_?|ERROR_?)[A-Z0-9_]+\b|\bEXIT_?\d+\b"),
)


# What a text with a token of each family holds; looked for first, as that takes a fraction of the time.
TOKEN_HINTS = (r"[a-zA-Z0-9][A-Z]", "_", "/", r"(?i)npm|yarn|bun|cargo|uv|pip|git|docker|kubectl", "-", r"\d\.\d", "E[A-Z0-9_]")


def found_tokens(text: Column) -> Column:
    """array of struct(token, type, family): significant tokens of two characters or more, as often as they are found."""

    def of(family: int) -> Column:
        kind, pattern = TOKEN_FAMILIES[family]
        found = F.regexp_extract_all(text, F.lit(ascii_words(pattern)), F.lit(0))
        found = F.when(~text.rlike(TOKEN_HINTS[family]), F.array().cast("array<string>")).otherwise(found)
        return F.transform(found, lambda t: F.struct(t.alias("token"), F.lit(kind).alias("type"), F.lit(family).alias("family")))

    return F.filter(F.concat(*map(of, range(len(TOKEN_FAMILIES)))), lambda t: F.length(t["token"]) >= 2)


def typed_tokens(text: Column) -> Column:
    """array of struct(token, type): significant tokens, the first of those equal in lower case, of two characters or more."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<token:string,type:string>>").alias("out"))

    def add(s: Column, t: Column) -> Column:
        low, kept = F.lower(t["token"]), F.struct(t["token"].alias("token"), t["type"].alias("type"))
        return F.when(F.array_contains(s["seen"], low), s).otherwise(F.struct(F.concat(s["seen"], F.array(low)).alias("seen"), F.concat(s["out"], F.array(kept)).alias("out")))

    return F.aggregate(found_tokens(text), start, add, lambda s: s["out"])


def sanitized(text: Column) -> Column:
    """Keys, bearer tokens and cloud keys redacted, in that order."""
    text = F.regexp_replace(text, ascii_words(r"(?i)\b(?:sk-|api[_-]?key|token|secret|password|auth)[_-]?[a-zA-Z0-9]{20,}"), "[REDACTED]")
    text = F.regexp_replace(text, r"(?i)Bearer\s+[a-zA-Z0-9._-]+", "Bearer [REDACTED]")
    return F.regexp_replace(text, r"AKIA[A-Z0-9]{16}", "[REDACTED_AWS_KEY]")


# Reasons for which a memory is noise, in order.
NOISE = (
    (r"(?i)^console\.(log|error|warn|debug)\(", "Raw console statement"),
    (r"(?i)^let me (check|look|see|try)", "Stream of consciousness"),
    (r"(?i)^now let('s| me)", "Stream of consciousness"),
    (r"(?i)^but let me", "Stream of consciousness"),
    (r"(?i)^i will try", "Tentative statement"),
    (r"(?i)^actually,", "Correction without context"),
    (r'(?i)^"(oldText|newText)":', "Raw edit parameters"),
    (r"^│|└|├", "ASCII art/table fragments"),
    (r"(?i)^/\(\?:", "Raw regex pattern"),
)


def noise_reason(text: Column, extra: str | None = None) -> Column:
    """Why a memory is noise; null if it isn't."""
    rules = [F.when(text.rlike(p), F.lit(reason)) for p, reason in NOISE]
    if extra:
        rules.append(F.when(text.rlike(extra), F.lit("Custom pattern match")))
    return F.coalesce(*rules)


# What makes a text an error, a diff or a test summary.
ERROR = (r"(?im)^error:", r"(?im)^fatal:", r"(?i)exception", r"(?i)traceback", r"(?i)stack trace", r"(?i)panic:", r"(?i)failed with exit code", r"(?i)command failed", r"(?i)compilation error", r"(?i)syntax error")
DIFF = (r"(?m)^diff --git", r"(?m)^@@.*@@", r"(?m)^\+\+\+ ", r"(?m)^--- ", r"(?m)^index [a-f0-9]+\.\.[a-f0-9]+")
TESTS = (r"(?i)\d+ tests? passed", r"(?i)\d+ tests? failed", r"(?i)tests?:\s*\d+", r"(?i)passed:\s*\d+", r"(?i)failed:\s*\d+", r"(?i)\btest suite\b", r"(?m)^PASS ", r"(?m)^FAIL ", r"(?i)test run")


def event_type(text: Column, tool: Column | None = None, exit_code: Column | None = None) -> Column:
    """tool_output, error, diff, test_summary or turn, in this order of precedence."""
    matches = lambda patterns: any_of([text.rlike(ascii_words(p)) for p in patterns])
    error = matches(ERROR)
    if exit_code is not None:
        error = F.coalesce(exit_code != 0, F.lit(False)) | error
    out = F.when(error, "error").when(matches(DIFF), "diff").when(matches(TESTS), "test_summary").otherwise("turn")
    return out if tool is None else F.when(F.length(tool) > 0, "tool_output").otherwise(out)


def file_paths(text: Column) -> Column:
    unix = F.filter(F.regexp_extract_all(text, F.lit(r"(?:/[\w.-]+)+(?:\.\w+)?"), F.lit(0)), lambda p: (F.length(p) > 2) & ~p.startswith("//"))
    return F.array_distinct(F.concat(unix, F.regexp_extract_all(text, F.lit(ascii_words(r"\b[\w.-]+/[\w./-]+\.\w+")), F.lit(0))))


def error_codes(text: Column) -> Column:
    parts = ((r"\b(?:E|ERR_?|ERROR_?)[A-Z0-9_]+\b", 0), (r"\bEXIT_?\d+\b", 0), (r"(?i)\berror\s*code[:\s]+(\w+)", 1), (r"(?i)\berrno[:\s]+(\d+)", 1))
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(ascii_words(p)), F.lit(g)) for p, g in parts)))


def commands(text: Column) -> Column:
    parts = (r"(?m)^\s*\$\s+(.+)$", r"(?m)^\s*>\s+(.+)$", r"```(?:bash|sh|shell|zsh)\n([\s\S]*?)```", r"`([a-z][\w-]*(?:\s+[\w./-]+)*)`")
    found = F.transform(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in parts)), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(found, lambda c: F.length(c).between(3, 199)))


def versions(text: Column) -> Column:
    """array of struct(package, version): name@1.2 and name==1.2."""

    def pairs(pattern: str) -> Column:
        names, numbers = (F.regexp_extract_all(text, F.lit(ascii_words(pattern)), F.lit(g)) for g in (1, 2))
        return F.zip_with(names, numbers, lambda n, v: F.struct(n.alias("package"), v.alias("version")))

    return F.concat(pairs(r"\b([\w@/-]+)@(\d+\.\d+(?:\.\d+)?(?:-[\w.]+)?)\b"), pairs(r"\b([\w-]+)==(\d+\.\d+(?:\.\d+)?(?:\.\w+)?)\b"))


def test_counts(text: Column) -> Column:
    """struct(passed, failed, skipped, total) of a test run's report; null if there is none."""
    first = r"(?i)Tests?:\s*(?:(\d+)\s*passed)?[,\s]*(?:(\d+)\s*failed)?[,\s]*(?:(\d+)\s*skipped)?[,\s]*(?:(\d+)\s*total)?"
    second = r"(?i)(\d+)\s+passed(?:[,\s]+(\d+)\s+failed)?(?:[,\s]+(\d+)\s+skipped)?"
    n = lambda p, g: F.coalesce(F.nullif(F.regexp_extract(text, p, g), F.lit("")).cast("int"), F.lit(0))
    names = ("passed", "failed", "skipped")
    one = F.struct(*(n(first, i + 1).alias(x) for i, x in enumerate((*names, "total"))))
    two = F.struct(*(n(second, i + 1).alias(x) for i, x in enumerate(names)), (n(second, 1) + n(second, 2) + n(second, 3)).alias("total"))
    return F.when(text.rlike(first), one).when(text.rlike(second), two)


# Phrases of doubt.
DOUBT = ("not sure", "not certain", "don't know", "i don't know", "might be", "could be", "possibly", "perhaps", "maybe", "i think", "i believe", "probably", "unclear", "unsure", "not confident", "hard to say", "difficult to determine", "would need to check", "need more information", "need more context")


def uncertainty(text: Column) -> Column:
    """struct(is_uncertain, confidence, triggers, suggestion)."""
    low = F.lower(text)
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in DOUBT)))
    n = F.size(found)
    hint = F.when(n >= 3, "Consider upgrading to deep context level").when(n >= 1, "Consider upgrading to task context level").otherwise("")
    return F.struct((n > 0).alias("is_uncertain"), F.least(n * 0.3, F.lit(1.0)).alias("confidence"), found.alias("triggers"), hint.alias("suggestion"))


def ends_open(text: Column) -> Column:
    """Blank, or ending with a colon: a constraint that says nothing."""
    plain = F.trim(text)
    return (plain == "") | plain.endswith(":")
