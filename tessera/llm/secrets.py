r"""Secret scans through a trigram inverted index (operator 8); DataFrame functions only.

A Boolean trigram query is derived from each rule's pattern: what trigrams any
match must hold.  One pass over the lower-cased texts finds the trigrams that any
rule asks for; grouped by trigram, the documents that hold it are its posting list.
The lists are cut into blocks of documents (every list of a block holds the same
range of keys, at most about ``BLOCK_DOCS`` of them), so that no list grows with the
input and lists of one block are intersected and united, as a rule's query says,
where they lie.  Only documents that remain are read again and verified with the
pattern.  A rule whose query is empty (such as a bare run of hexadecimal digits)
scans every document.

A posting is a 64-bit hash of doc_id and text.  Rows that repeat share it; should two
documents share it, each is verified with what either was asked for, which can add
nothing false.  Verified spans go back by doc_id and hash of the text.
Defined cases: a null text is empty and has no spans; matches of one kind don't
overlap, matches of different kinds may; texts of any length are searched whole, in
time that grows with their length and number of matches; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, joinable, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: every match of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # the same matches as of [0-9a-f]+ with 24 characters or more
)
MORE = (
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

# --- Boolean trigram queries -------------------------------------------------
# A query is None (no condition), a trigram, or ("and" | "or", frozenset of queries).

#: Sets of strings larger than this are given up for a weaker condition.
MOST_STRINGS = 64


def conjunction(*parts):
    return combine("and", [p for p in parts if p is not None])


def disjunction(*parts):
    return None if not parts or any(p is None for p in parts) else combine("or", parts)


def combine(op, parts):
    flat = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == op else {p}
    if not flat:
        return None
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def grams_of(strings: set[str]):
    """What a text that holds one of the strings must hold."""
    return disjunction(*(conjunction(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


@dataclass
class Known:
    """Of the matches of a part: all of them, if few; how they begin and end; what they must hold."""

    exact: set[str] | None
    heads: set[str]
    tails: set[str]
    query: object


def weaker(k: Known) -> Known:
    """``k`` without its exact set."""
    if k.exact is None:
        return k
    return Known(None, {s[:2] for s in k.exact}, {s[-2:] for s in k.exact}, conjunction(k.query, grams_of(k.exact)))


ANYTHING = Known(None, {""}, {""}, None)
EMPTY = Known({""}, {""}, {""}, None)


def one_of(chars: set[str]) -> Known:
    low = {c.lower() for c in chars}
    return Known(low, set(), set(), None) if len(low) <= 8 else ANYTHING


def joined(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return Known({x + y for x, y in product(a.exact, b.exact)}, set(), set(), conjunction(a.query, b.query))
    heads = None
    if a.exact is not None:
        heads = {x[:2] if len(x) >= 2 else (x + y)[:2] for x in a.exact for y in (b.heads or b.exact or {""})}
    tails = None
    if b.exact is not None:
        tails = {y[-2:] if len(y) >= 2 else (x + y)[-2:] for y in b.exact for x in (a.tails or a.exact or {""})}
    a, b = weaker(a), weaker(b)
    across = {x + y for x, y in product(a.tails, b.heads)}
    seam = grams_of(across) if across and len(across) <= MOST_STRINGS else None
    return Known(None, heads or a.heads, tails or b.tails, conjunction(a.query, b.query, seam))


def either(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return Known(a.exact | b.exact, set(), set(), disjunction(a.query, b.query))
    a, b = weaker(a), weaker(b)
    return Known(None, a.heads | b.heads, a.tails | b.tails, disjunction(a.query, b.query))


def known(tree) -> Known:
    """Walks the parse tree of a pattern, as Python's re gives it."""
    out = EMPTY
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            part = one_of({chr(arg)})
        elif name == "IN":
            chars: set[str] | None = set()
            for o, a in arg:
                if str(o) == "LITERAL":
                    chars.add(chr(a))
                elif str(o) == "RANGE" and a[1] - a[0] < 64:
                    chars |= {chr(c) for c in range(a[0], a[1] + 1)}
                else:
                    chars = None
                    break
            part = one_of(chars) if chars else ANYTHING
        elif name == "SUBPATTERN":
            part = known(arg[3])
        elif name == "BRANCH":
            part = reduce(either, map(known, arg[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg[0], arg[1], known(arg[2])
            if low == 0:
                part = either(EMPTY, inner) if high == 1 else ANYTHING
            elif low == high == 1:
                part = inner
            else:
                part = weaker(inner)
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            part = EMPTY
        else:
            part = ANYTHING
        out = joined(out, part)
    return out


def trigram_query(pattern: str):
    """The Boolean query over lower-cased trigrams that every match's text satisfies; None: no condition."""
    return weaker(known(re._parser.parse(pattern))).query


def leaves(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(leaves, query[1]))


#: Conditions of a rule at most; what more of them would rule out is left to verification.
MOST_CLAUSES = 64


def clauses(query) -> list[frozenset[str]]:
    """The query as conditions that all hold, each one of several trigrams; of very many, some."""
    if isinstance(query, str):
        return [frozenset({query})]
    parts = [clauses(q) for q in sorted(query[1], key=str)]
    if query[0] == "and":
        out = set().union(*parts)
    else:
        out = {frozenset()}
        for part in parts:
            out = set(sorted({a | b for a in out for b in part}, key=lambda c: (len(c), sorted(c)))[:MOST_CLAUSES])
    # what a condition implies needs no asking
    least = [c for c in out if not any(d < c for d in out)]
    return sorted(least, key=lambda c: (len(c), sorted(c)))


def holds(conditions: Column, lists: Column) -> Column:
    """The keys that meet all conditions, by a block's posting lists (map of trigram to sorted keys): lists of one are united, the unions intersected."""
    listed = lambda g: F.coalesce(F.try_element_at(lists, g), F.array().cast("array<long>"))
    united = lambda c: F.array_distinct(F.flatten(F.transform(c, listed)))
    return F.aggregate(F.slice(conditions, 2, F.size(conditions)), united(F.element_at(conditions, 1)), lambda keys, c: F.array_intersect(keys, united(c)))


# --- Index, intersection, verification ----------------------------------------

#: Documents that a block of postings holds, about; numbers of an array that are summed up at a time.
BLOCK_DOCS, CHUNK = 8192, 256


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column) -> Column:
    """The running sums of a non-empty array of numbers, chunk by chunk: the time is about linear."""
    zero = F.lit(0).cast("long")

    def sums(values: Column, start: Column) -> Column:
        first = F.struct(start.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"] + v)).alias("out"))
        return F.aggregate(values, first, step, lambda s: s["out"])

    def chunked(values: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / CHUNK).cast("int") - 1), lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)))
        return bound(chunks, lambda parts: bound(sums(F.transform(parts, lambda p: F.aggregate(p, zero, lambda s, v: s + v)), zero), lambda upto: F.flatten(F.transform(parts, lambda p, i: sums(p, F.when(i == 0, zero).otherwise(F.get(upto, i - 1)))))))

    return bound(numbers, chunked)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array of struct(start, kind_order, kind, end): the rule's matches, as code points of the text; null if there are none.

    The text is searched once, and again for what lies between if there are matches.
    """
    kept = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least) if rule.group else (lambda m: F.length(m) >= rule.least)

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(between, found, lambda g, m: (F.length(g) + F.length(m)).cast("long")))
        span = lambda m, e: F.when(kept(m), F.struct((e - F.length(m)).cast("int").alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), e.cast("int").alias("end")))
        return F.when(F.size(found) > 0, F.array_compact(F.zip_with(found, ends, span)))

    return bound(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), placed)


SPAN = "array<struct<start:int,kind_order:int,kind:string,end:int>>"


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), SPAN)


def some(parts: list[Column]) -> Column:
    return F.concat(*(F.coalesce(p, no_spans()) for p in parts)) if parts else no_spans()


def any_gram(grams: list[str]) -> str:
    """A pattern that finds, at every place, the one of the trigrams that begins there: its group 1."""
    by_first: dict[str, list[str]] = {}
    for g in grams:
        by_first.setdefault(g[0], []).append(re.escape(g[1:]))
    firsts = "".join(re.escape(c) for c in sorted(by_first))
    return f"(?=[{firsts}])(?=({'|'.join(f'{re.escape(c)}(?:{chr(124).join(rest)})' for c, rest in sorted(by_first.items()))}))"


def known_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), th (hash of the text) and key (of both) of documents."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th"))
    return rows.withColumn("key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "th"))


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, th, key, grams (its trigrams that rules ask for), full (spans of rules without a query)."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(leaves, queries)))
    grams = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_gram(wanted)), F.lit(1))) if wanted else F.array().cast("array<string>")
    full = some([spans(F.col("text"), r, i) for i, (r, q) in enumerate(zip(rules, queries, strict=True)) if q is None])
    return known_rows(docs).select("doc_id", "th", "key", grams.alias("grams"), full.alias("full"))


def postings(indexed: DataFrame) -> DataFrame:
    """block, gram, keys (sorted): the inverted index, each trigram's list in blocks."""
    blocks = max(1, -(-indexed.count() // BLOCK_DOCS))
    each = indexed.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.explode("grams").alias("gram"), "key")
    return each.groupBy("block", "gram").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def candidates(lists: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents that some rule's query leaves: key, asked (the rules' places); posting lists of a block are intersected."""
    held = lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))  # as many as there are trigrams in rules
    # a row per block and rule, so that one small expression serves all rules
    asked = [F.struct(F.lit(i).alias("rule"), F.array(*(F.array(*map(F.lit, sorted(c))) for c in clauses(q))).alias("all")) for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None]
    if not asked:
        return lists.select(F.lit(0).cast("long").alias("key"), F.array(F.lit(0)).alias("asked")).limit(0)
    each = held.select("lists", F.explode(F.array(*asked)).alias("q")).select("q.rule", F.explode(holds(F.col("q.all"), F.col("lists"))).alias("key"))
    return each.groupBy("key").agg(F.array_sort(F.collect_set("rule")).alias("asked"))


def verify(docs: DataFrame, chosen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, th, checked (spans): the texts of candidates, searched with the patterns that asked for them."""
    hit = known_rows(docs).join(chosen.withColumnRenamed("key", "c_key"), F.col("key") == F.col("c_key"))
    parts = [F.when(F.array_contains("asked", i), spans(F.col("text"), r, i)) for i, r in enumerate(rules) if trigram_query(r.pattern) is not None]
    return hit.select("doc_id", "th", some(parts).alias("checked")).filter(F.size("checked") > 0).dropDuplicates(["doc_id", "th"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (sorted array of struct(start, kind_order, kind, end)) of every document (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "secrets")
    indexed = scratch.put(index(docs, rules))
    chosen = scratch.put(candidates(postings(indexed), rules))
    checked = scratch.put(verify(docs, joinable(chosen), rules)).select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "checked")
    scratch.drop(chosen)
    every = indexed.select("doc_id", "th", "full").join(joinable(checked), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")), "left")
    return every.select("doc_id", F.array_sort(some([F.col("full"), F.col("checked")])).alias("spans"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind_order"] < len(BASE))
    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


QUERIES = {"op8_secret_scan": op8_secret_scan}
SQL: dict[str, str] = {}
