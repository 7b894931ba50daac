"""Lexical (BM25, typed tokens), vector and fused search, plans, reranking, packing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import score, text
from . import lexicon, records

#: A context pack adds so many tokens for each object.
PACK_OVERHEAD = 20


def token_index(memories: DataFrame) -> DataFrame:
    """id, token, type: the typed-token table."""
    found = memories.select("id", F.explode(text.found_tokens(F.col("content"))).alias("t")).select("id", F.lower("t.token").alias("token"), "t.type", "t.family")
    return found.groupBy("id", "token").agg(F.min_by("type", "family").alias("type"))


def by_token(memories: DataFrame, index: DataFrame, token: str) -> DataFrame:
    """Active memories that hold a token."""
    hits = index.filter(F.col("token") == token.lower()).select(F.col("id").alias("t_id"))
    return memories.filter("status = 'active'").join(hits, F.col("id") == F.col("t_id"), "left_semi")


def by_token_part(memories: DataFrame, index: DataFrame, part: str) -> DataFrame:
    """Active memories that hold a token with a part in it."""
    hits = index.filter(F.contains("token", F.lit(part.lower()))).select(F.col("id").alias("t_id"))
    return memories.filter("status = 'active'").join(hits, F.col("id") == F.col("t_id"), "left_semi")


def lexical(memories: DataFrame, index: lexicon.Index, terms: Sequence[str], status: Sequence[str] = ("active",), limit: int = 50) -> DataFrame:
    """id, bm25: the best of the given statuses; statistics are those of all memories indexed."""
    return lexicon.search(index, memories.filter(F.col("status").isin(*status)), terms, limit)


def vector(vectors: DataFrame, query: DataFrame, limit: int = 50, key: str = "vec_id") -> DataFrame:
    """key, distance (1 - cosine): exact, one scan; ``query``: one row with q."""
    near = vectors.join(F.broadcast(query)).withColumn("distance", 1 - score.cosine(F.col("embedding"), F.col("q")))
    return near.select(key, "distance").orderBy("distance", key).limit(limit)


#: Least bm25 and least cosine of what counts as similar.
SIMILAR_LEXICAL, SIMILAR_VECTOR = 0.5, 0.85


def find_similar(memories: DataFrame, index: lexicon.Index, vectors: DataFrame, of: int, limit: int = 5) -> DataFrame:
    """id, place: active memories like one: the best lexical hits for its words, then the nearest vectors, up to ``limit``."""
    told = memories.filter(F.col("id") == of).select(text.search_terms(F.col("content")).alias("words")).first()  # one row
    if told is None:
        return memories.select("id", F.lit(0).alias("place")).limit(0)
    others = memories.filter(F.col("id") != of)
    # the memory itself is among the best hits and counts among them
    words = lexical(memories, index, told["words"] or [], limit=2 * limit).filter(f"bm25 > {SIMILAR_LEXICAL} and id <> {of}").select("id", F.lit(0).alias("part"), (-F.col("bm25")).alias("key"))
    asked = vectors.filter(F.col("vec_id") == of).select(F.col("embedding").alias("q")).limit(1)
    near = vector(vectors, asked, 2 * limit).filter(f"1 - distance > {SIMILAR_VECTOR}").select(F.col("vec_id").alias("id"), F.lit(1).alias("part"), F.col("distance").alias("key"))
    near = near.join(others.filter("status = 'active'").select(F.col("id").alias("a")), F.col("id") == F.col("a")).drop("a")
    best = words.unionByName(near).groupBy("id").agg(F.min(F.struct("part", "key")).alias("o"))  # at most four times the limit
    return best.withColumn("place", F.row_number().over(Window.orderBy("o", "id"))).filter(F.col("place") <= limit).select("id", "place")


def related(bases: DataFrame, vectors: DataFrame, first: int = 3, k: int = 3) -> DataFrame:
    """Neighbours of the first few bases (id, rank): id, base, distance; bases themselves are left out."""
    few = bases.orderBy("rank").limit(first).select(F.col("id").alias("base"))
    asked = few.join(vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("q")), F.col("base") == F.col("b")).select("base", "q")
    near = vectors.join(F.broadcast(asked), F.col("vec_id") != F.col("base")).join(bases.select(F.col("id").alias("known")), F.col("vec_id") == F.col("known"), "left_anti")
    order = Window.partitionBy("base").orderBy("distance", "vec_id")
    scored = near.select(F.col("vec_id").alias("id"), "base", (1 - score.cosine(F.col("embedding"), F.col("q"))).alias("distance"), "vec_id")
    return scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("id", "base", "distance")


def latest_vectors(log: DataFrame) -> DataFrame:
    """The current vector of each id from an upsert log (vec_id, version, embedding; a null embedding deletes)."""
    last = log.groupBy("vec_id").agg(F.max_by("embedding", "version").alias("embedding"))
    return last.filter("embedding is not null")


def fused(lexical_hits: DataFrame, vector_hits: DataFrame, memories: DataFrame, alpha: float = 0.5, status: Sequence[str] = ("active",)) -> DataFrame:
    """Reciprocal rank fusion: memories with rrf and match (lexical, vector or hybrid)."""
    # both lists are top-k results, so one task ranks them
    left = lexical_hits.select("id", F.row_number().over(Window.orderBy(F.desc("bm25"), "id")).alias("l_rank"))
    right = vector_hits.select(F.col("vec_id").alias("v_id"), F.row_number().over(Window.orderBy("distance", "vec_id")).alias("v_rank"))
    both = left.join(right, F.col("id") == F.col("v_id"), "full_outer")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (S.RRF_K + F.col(rank)), F.lit(0.0))
    match = F.when(F.col("v_id").isNull(), "lexical").when(F.col("id").isNull(), "vector").otherwise("hybrid")
    ranked = both.select(F.coalesce("id", "v_id").alias("m_id"), (part(alpha, "l_rank") + part(1 - alpha, "v_rank")).alias("rrf"), match.alias("match"))
    return memories.filter(F.col("status").isin(*status)).join(F.broadcast(ranked), F.col("id") == F.col("m_id")).drop("m_id")


def hybrid(memories: DataFrame, index: lexicon.Index, vectors: DataFrame, query: DataFrame, terms: Sequence[str], now: Column, limit: int = 20, alpha: float = 0.5, status: Sequence[str] = ("active",), types: Sequence[str] = ()) -> DataFrame:
    """Fused search: twice the limit from either side, types filtered after fusion, then strength, outcome and recency.

    memories need strength and outcome_score; the strength is always decayed.
    """
    hits = fused(lexical(memories, index, terms, status, 2 * limit), vector(vectors, query, 2 * limit), memories, alpha, status)
    if types:
        hits = hits.filter(F.col("object_type").isin(*types))
    faded = score.decayed_strength(F.col("strength"), F.col("last_accessed"), F.col("created_at"), now)
    value = score.effective(F.col("rrf"), faded, F.col("outcome_score")) * score.recency_multiplier(F.coalesce("last_verified_at", "created_at"), now)
    return hits.withColumn("score", value).orderBy(F.desc("score"), "id").limit(limit)


def access_events(results: DataFrame, now: Column) -> DataFrame:
    """What a search writes back, as rows to append: id, accessed_at, reinforced strength."""
    return results.select("id", now.alias("accessed_at"), score.reinforced_strength(F.col("strength")).alias("strength"))


def planned(results: DataFrame, plan: dict, now: Column) -> DataFrame:
    """Results of a search under a plan: filters, boosts, cap of budget / 30."""
    tiered = records.with_tier(results, now)
    if plan["types"]:
        tiered = tiered.filter(F.col("object_type").isin(*plan["types"]))
    if "least_tier" in plan:
        tiered = tiered.filter(F.col("tier").isin(*S.TIERS[: S.TIERS.index(plan["least_tier"]) + 1]))
    boosted = score.plan_boosts(F.col("score"), plan, F.col("tier"), F.col("n_refs"), F.col("last_verified_at"), F.col("object_type"), now)
    return tiered.withColumn("score", boosted).orderBy(F.desc("score"), "id").limit(plan["budget"] // 30)


def reranked(results: DataFrame, now: Column, task: str = "general") -> DataFrame:
    tiered = records.with_tier(results, now)
    value = score.composite(F.col("score"), F.col("object_type"), F.col("tier"), F.col("confidence"), F.col("created_at"), F.col("access_count"), now, task)
    return tiered.withColumn("score", value)


def packed(results: DataFrame, budget: int | DataFrame, overhead: int = PACK_OVERHEAD) -> DataFrame:
    """Greedy packing: in order of rank, what fits is taken, what doesn't is passed over.

    A fold over one bounded list (results of a search): id, rank, tokens, included, left.
    ``budget``: tokens, or one row with them (budget).
    """
    sized = results.select("rank", "id", (text.estimate_tokens(F.col("content")) + overhead).alias("tokens"))
    listed = sized.agg(F.sort_array(F.collect_list(F.struct("rank", "id", "tokens"))).alias("all"))
    listed = listed.withColumn("budget", F.lit(budget)) if isinstance(budget, int) else listed.join(F.broadcast(budget))  # one row each
    start = F.struct(F.col("budget").cast("long").alias("left"), F.array().cast("array<struct<rank:int,id:bigint,tokens:bigint,included:boolean,left:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = x["tokens"] <= s["left"]
        left = F.when(fits, s["left"] - x["tokens"]).otherwise(s["left"])
        row = F.struct(x["rank"].cast("int").alias("rank"), x["id"].alias("id"), x["tokens"].alias("tokens"), fits.alias("included"), left.alias("left"))
        return F.struct(left.alias("left"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = listed.select(F.explode(F.aggregate("all", start, step, lambda s: s["out"])).alias("r"))
    return folded.select("r.rank", "r.id", "r.tokens", "r.included", "r.left")


def context_pack(memories: DataFrame, ranked: DataFrame, budget: int, reserved: int = 0) -> DataFrame:
    """Constraints first (always in, even below zero), then the greedy pack of the ranked rest: part, id, tokens."""
    limits = memories.filter((F.col("status") == "active") & (F.col("object_type") == "constraint")).select("id", (text.estimate_tokens(F.col("content")) + PACK_OVERHEAD).alias("tokens"))
    left = limits.agg((F.lit(budget - reserved) - F.coalesce(F.sum("tokens"), F.lit(0))).alias("budget"))
    rest = packed(ranked.filter("object_type <> 'constraint'"), left).filter("included")
    return limits.select(F.lit("constraint").alias("part"), "id", "tokens").unionByName(rest.select(F.lit("relevant").alias("part"), "id", "tokens"))


def mean_similarity(vectors: DataFrame, group: str = "label") -> DataFrame:
    """Mean cosine over the pairs of each group, from sums of unit vectors: no pair is formed; 1 for a single member."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = vectors.select(F.col(group), F.posexplode("embedding").alias("i", "v"), length.alias("norm")).filter("norm > 0")
    sums = unit.groupBy(group, "i").agg(F.sum(F.col("v").cast("double") / F.col("norm")).alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    n = F.col("n")
    return total.select(group, n, F.when(n == 1, 1.0).otherwise((F.col("ss") - n) / (n * (n - 1))).alias("mean_similarity"))


def group_merge(members: DataFrame, group: str) -> DataFrame:
    """One memory for each group: modal type, best confidence, evidence in total, longest content, members."""
    modal = members.groupBy(group, "object_type").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    kind = modal.groupBy(group).agg(F.max_by("object_type", F.struct("n", (-F.col("first")).alias("f"))).alias("object_type"))
    rank = F.array_position(F.array(*map(F.lit, S.CONFIDENCES)), F.col("confidence"))
    rolled = members.groupBy(group).agg(
        F.min_by("confidence", rank).alias("confidence"),
        F.sum("n_evidence").alias("n_evidence"),
        F.max_by("id", F.struct(F.length("content"), -F.col("id"))).alias("content_from"),
        F.count("*").alias("members"),
    )
    return rolled.join(kind, group)


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def measured(judged: DataFrame, best: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Precision, recall, reciprocal rank and ndcg of judged results (query_id, rank, grade or null) against the ideal (query_id, wanted, idcg)."""
    found, most = F.col("grade").isNotNull(), max(ks)
    per = judged.groupBy("query_id").agg(
        *(F.count_if(found & (F.col("rank") <= k)).alias(f"hits_{k}") for k in ks),
        F.count_if(F.col("rank") <= most).alias("returned"),
        F.coalesce(F.max(F.when(found, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(F.col("rank") <= most, gain(F.coalesce("grade", F.lit(0)), F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    joined = per.join(best, "query_id")
    cut = lambda k: F.least(F.lit(k), F.col("returned"))
    return joined.select(
        "query_id",
        *(F.coalesce(F.try_divide(F.col(f"hits_{k}").cast("double"), cut(k)), F.lit(0.0)).alias(f"p_{k}") for k in ks),
        *((F.col(f"hits_{k}") / F.col("wanted")).alias(f"r_{k}") for k in ks),
        "mrr",
        F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg"),
    )


def ir_metrics(ranked: DataFrame, relevant: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Per query: precision and recall at ks, reciprocal rank, ndcg.

    ranked: query_id, item_id, rank; relevant: query_id, item_id, grade.
    """
    judged = ranked.join(relevant, ["query_id", "item_id"], "left")
    ideal = relevant.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item_id")))
    best = ideal.groupBy("query_id").agg(F.count("*").alias("wanted"), F.sum(F.when(F.col("r") <= max(ks), gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("idcg"))
    return measured(judged, best, ks)


def ir_metrics_by_label(ranked: DataFrame, queries: DataFrame, items: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """The same where relevant is what has the query's label, so that no table of all relevant pairs is needed.

    queries: query_id, label; items: item_id, label, grade (queries are items too, and
    not relevant for themselves).  The ideal comes from counts by label and grade.
    """
    graded = items.select("item_id", F.col("label").alias("i_label"), "grade")
    judged = ranked.join(graded, "item_id").join(queries, "query_id").select("query_id", "rank", F.when(F.col("label") == F.col("i_label"), F.col("grade")).alias("grade"))
    counts = items.groupBy("label", "grade").agg(F.count("*").alias("n"))
    own = queries.join(items.select(F.col("item_id").alias("query_id"), F.col("grade").alias("own")), "query_id").join(counts, "label").withColumn("n", F.col("n") - (F.col("grade") == F.col("own")).cast("int"))
    # the places that each grade takes in the ideal order, the greatest first
    above = own.withColumn("to", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade")))).withColumn("from", F.col("to") - F.col("n"))
    taken = F.filter(F.sequence(F.lit(1), F.lit(max(ks))), lambda r: (r > F.col("from")) & (r <= F.col("to")))
    part = F.aggregate(taken, F.lit(0.0), lambda s, r: s + gain(F.col("grade"), r))
    best = above.groupBy("query_id").agg(F.sum("n").alias("wanted"), F.sum(part).alias("idcg"))
    return measured(judged, best, ks)


#: Buckets of a bracket of values.
BUCKETS = 1024


def latency_p95(rows: DataFrame, column: str) -> DataFrame:
    """n, mean, p95: the value at place floor(0.95 n) from 0, else the last.

    Approximate quantiles give edges; counts between them, and then of equal parts of
    the bracket that holds the place, lead to one part, whose values alone are ordered
    (counted per value first).  Every ordered window has at most ``BUCKETS`` rows, or
    one part's values.
    """
    v = F.col(column).cast("double")
    bounds = rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.approx_percentile(v, [0.94, 0.945, 0.95, 0.955, 0.96], 1000).alias("cuts"), F.min(v).alias("least"), F.max(v).alias("most"))
    place = F.greatest(F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1), F.lit(0))
    bounds = bounds.select("n", "mean", place.alias("place"), F.array_distinct(F.array_sort(F.concat(F.array("least", "most"), "cuts"))).alias("edges"))
    read = rows.select(v.alias("v")).filter("v is not null")

    def narrowed(values: DataFrame, at: DataFrame) -> DataFrame:
        """One row: at, with the edges around the part of ``edges`` (closed above) that holds the place, and the rows before it."""
        part = F.size(F.filter("edges", lambda e: e < F.col("v")))
        counts = values.join(F.broadcast(at)).groupBy(part.alias("part")).agg(F.count("*").alias("c"))  # at most one row for each edge
        upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("part")))
        hit = upto.join(F.broadcast(at)).filter(F.col("before") + F.col("upto") > F.col("place")).orderBy("part").limit(1)
        low, high = F.when(F.col("part") > 0, F.get("edges", F.col("part") - 1)), F.get("edges", F.col("part"))
        return hit.select("n", "mean", "place", (F.col("before") + F.col("upto") - F.col("c")).alias("before"), low.alias("low"), high.alias("high"))

    inside = lambda at: read.join(F.broadcast(at.select("low", "high"))).filter((F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("v") <= F.col("high"))).select("v")
    first = narrowed(read, bounds.withColumn("before", F.lit(0).cast("long")))
    start = F.coalesce("low", F.col("high"))
    even = F.transform(F.sequence(F.lit(1), F.lit(BUCKETS)), lambda i: F.when(i == BUCKETS, F.col("high")).otherwise(start + (F.col("high") - start) * i / BUCKETS))
    second = narrowed(inside(first), first.withColumn("edges", F.array_distinct(even)))
    # of the first value, nothing lies below; of others, what lies at the lower edge was counted before
    exact = inside(second).groupBy("v").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("v")))
    return exact.join(F.broadcast(second)).filter(F.col("before") + F.col("upto") > F.col("place")).groupBy("n", "mean").agg(F.min("v").alias("p95"))


#: Queries, and rows, that a task compares at a time.
QUERY_BLOCK, ROW_BLOCK = 1024, 16_384


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, distance (1 - cosine, to 9 places), rank: exact, of every query (vec_id, embedding) the k nearest other vectors.

    Queries and rows are cut into blocks by hash; each pair of blocks is one matrix
    product, from which the k best of each query leave: the work is that of all
    comparisons, the shuffle that of the rows once for each block of queries.
    """
    n_queries, n_rows = queries.count(), vectors.count()
    q_blocks, r_blocks = -(-max(1, n_queries) // QUERY_BLOCK), -(-max(1, n_rows) // ROW_BLOCK)
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = ("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.select(*row, block(q_blocks, 1).alias("i")).withColumn("j", every(r_blocks))
    data = vectors.select(*row, block(r_blocks, 2).alias("j")).withColumn("i", every(q_blocks))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "distance"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1)), 1e-300)[:, None]
        q, x = unit(np.stack(left["v"].to_numpy())), unit(np.stack(right["v"].to_numpy()))
        ids, names = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        d = np.round(1 - q @ x.T, 9)
        d[names[:, None] == ids[None, :]] = np.inf
        out = []
        for i, name in enumerate(names):
            near = np.flatnonzero(d[i] <= np.partition(d[i], min(k, len(ids)) - 1)[min(k, len(ids)) - 1])
            near = near[np.lexsort((ids[near], d[i][near]))][:k]
            out += [(name, ids[j], d[i][j]) for j in near if np.isfinite(d[i][j])]
        return pd.DataFrame(out, columns=columns)

    found = asked.groupBy("i", "j").cogroup(data.groupBy("i", "j")).applyInPandas(compare, "query_id long, vec_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def united_evidence(members: DataFrame, evidence: DataFrame, group: str) -> DataFrame:
    """group, event_id: what the members of a group (id) have as evidence (id, event_id), each event once."""
    return members.select(F.col("id").alias("_id"), group).join(evidence, F.col("_id") == F.col("id")).select(group, "event_id").distinct()
