"""Retrieval quality: fusion, diversity, planning and metrics over ranked lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators.search import ranked
from stratalog.shared import written

RRF_K = 60


def fuse_rrf(full: DataFrame, sparse: DataFrame, keys: Sequence[str], k: int = RRF_K, limit: int = 30) -> DataFrame:
    """Two ranked lists (``rank``) fused by reciprocal rank: keys, full_rank, sparse_rank, rrf, fused_rank.

    Ties go by the better rank, then the full view's rank, then the sparse
    view's (none is last), then the keys. A key that a list holds twice fails
    the job.
    """
    if k < 1 or limit < 1:
        raise ValueError("k and the limit are 1 at least")

    def own(df: DataFrame, name: str) -> DataFrame:
        once = F.count("*").over(Window.partitionBy(*keys)) == 1
        checked = F.when(once, F.col("rank")).otherwise(F.raise_error(F.lit(f"a candidate is twice in the {name} list")).cast("bigint"))
        return df.select(*keys, checked.alias(f"{name}_rank"))

    both = own(full, "full").join(own(sparse, "sparse"), list(keys), "full")
    score = F.coalesce(1 / (k + F.col("full_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("sparse_rank")), F.lit(0.0))
    order = [F.desc("rrf"), F.least("full_rank", "sparse_rank"), F.col("full_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), *[F.col(c) for c in keys]]
    out = ranked(both.withColumn("rrf", score).orderBy(*order).limit(limit), order, "fused_rank")
    return out.withColumn("rrf", F.round("rrf", 9))


def mmr_select(groups: DataFrame, k: int, relevance_weight: float, rank: str = "rank", words: str = "words") -> DataFrame:
    """Greedy maximal marginal relevance over a bounded list: ``rank`` and ``mmr_rank`` of the ``k`` chosen.

    Relevance falls linearly from 1 at the first to 0 at the last; redundancy
    is the greatest Jaccard of word sets to what is chosen (two empty sets are
    equal). ``relevance_weight`` weighs relevance, the rest redundancy; ties go
    to the better rank. The list is a search's groups, of which there are few;
    it is worked on in one task.
    """
    if k < 1 or not 0.0 <= relevance_weight <= 1.0:
        raise ValueError("k is 1 at least, the weight 0 to 1")
    schema = f"{rank} bigint, mmr_rank bigint"

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(rank)
        sets, ranks, n = [set(w) for w in frame[words]], list(frame[rank]), len(frame)
        relevance = [1.0 - i / (n - 1) if n > 1 else 1.0 for i in range(n)]
        left, nearest, out = dict.fromkeys(range(n)), [0.0] * n, []
        while left and len(out) < k:
            value = {i: relevance_weight * relevance[i] - (1.0 - relevance_weight) * nearest[i] for i in left}
            best = max(left, key=lambda i: (value[i], -i))
            out.append(best)
            del left[best]
            for i in left:
                either = len(sets[i] | sets[best])
                nearest[i] = max(nearest[i], len(sets[i] & sets[best]) / either if either else 1.0)
        return pd.DataFrame({rank: [ranks[i] for i in out], "mmr_rank": range(1, len(out) + 1)})

    return groups.select(F.col(rank).cast("bigint").alias(rank), words).groupBy().applyInPandas(choose, schema)


def target_ranks(ranked_rows: DataFrame, gold: DataFrame, case: str = "case_id", target: str = "target_fp", fp: str = "fp", rank: str = "rank") -> DataFrame:
    """The first rank at which each case's target occurs, null if it doesn't."""
    own = gold.select(case, target).join(ranked_rows, case, "left")
    return own.groupBy(case).agg(F.min(F.when(F.col(fp) == F.col(target), F.col(rank))).alias("target_rank"))


def retrieval_metrics(ranks: DataFrame, by: Sequence[str] = (), rank: str = "target_rank") -> DataFrame:
    """Cases, R@1, 3, 5, 10 and MRR of nullable ranks."""
    at = lambda k: F.round(F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0))), 6).alias(f"r_at_{k}")
    mrr = F.round(F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))), 6).alias("mrr")
    return ranks.groupBy(*by).agg(F.count("*").alias("cases"), *[at(k) for k in (1, 3, 5, 10)], mrr)


def separation(cases: DataFrame, top: int = 10) -> DataFrame:
    """Candidate stage and ranking stage told apart; a ranked case that wasn't reachable is counted as impossible."""
    hit = F.coalesce(F.col("target_rank") <= top, F.lit(False))
    out = cases.agg(F.count("*").alias("cases"), F.count_if(F.col("reachable")).alias("reachable"), F.count_if(hit).alias("top"), F.count_if(~F.col("reachable") & F.col("target_rank").isNotNull()).alias("impossible"), F.sum(F.coalesce(1 / F.col("target_rank"), F.lit(0.0))).alias("s"))
    return out.select("cases", "reachable", "top", "impossible", F.round(F.col("top") / F.nullif(F.col("reachable"), F.lit(0)), 6).alias("top_of_reachable"), F.round(F.col("s") / F.col("cases"), 6).alias("mrr"))


def concentration(rows: DataFrame, group: str = "session_id") -> DataFrame:
    """Rows, distinct groups and the greatest group's share."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("groups"), F.round(F.max("n") / F.sum("n"), 6).alias("max_share"))


def cap_curve(found: DataFrame, caps: Iterable[int], budget: int, order: Sequence[str]) -> DataFrame:
    """What a per-session cap lets through: for each cap the rows, sessions and greatest share within the budget, and the change to the cap before."""
    caps = sorted(caps)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(*[c for c in order if c != "session_id"]))
    own = found.withColumn("place", place).where(F.col("place") <= max(caps))
    each = own.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps]))).where(F.col("place") <= F.col("cap"))
    top = each.withColumn("k", F.row_number().over(Window.partitionBy("cap").orderBy(*order))).where(F.col("k") <= budget)
    per = top.groupBy("cap", "session_id").agg(F.count("*").alias("n")).groupBy("cap").agg(F.sum("n").alias("n_rows"), F.count("*").alias("sessions"), F.round(F.max("n") / F.sum("n"), 6).alias("max_share"))
    before = Window.partitionBy(F.lit(0)).orderBy("cap")  # a row a cap
    return per.withColumn("gained_rows", F.col("n_rows") - F.lag("n_rows").over(before)).withColumn("cap", F.col("cap").cast("bigint"))


def compare(baseline: DataFrame, other: DataFrame, case: str = "case_id", rank: str = "target_rank") -> DataFrame:
    """Cases improved, same and worse; null is the worst rank; cases that only one list has are counted as mismatch."""
    a = baseline.select(case, F.col(rank).alias("_a"), F.lit(True).alias("_in_a"))
    b = other.select(case, F.col(rank).alias("_b"), F.lit(True).alias("_in_b"))
    far = F.lit(2**62)
    one, two = F.coalesce("_a", far), F.coalesce("_b", far)
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return a.join(b, case, "full").agg(F.count_if(both & (two < one)).alias("improved"), F.count_if(both & (two == one)).alias("same"), F.count_if(both & (two > one)).alias("worse"), F.count_if(~both).alias("mismatch"))


def changes_by(ranks: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """Cases, improved and worse ones by group, with a row ``all`` of the total; null is the worst rank."""
    far = F.lit(2**62)
    one, two = F.coalesce(before, far), F.coalesce(after, far)
    out = ranks.rollup(by).agg(F.count("*").alias("cases"), F.count_if(two < one).alias("improved"), F.count_if(two > one).alias("worse"), F.grouping(by).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(by)).alias(by), "cases", "improved", "worse")


def choose_challenger(points: DataFrame, current_top: float) -> DataFrame:
    """The point that loses no top hits and has the best R@10, then the best recall, then the least cap."""
    return points.where(F.col("r_at_10") >= current_top).orderBy(F.desc("r_at_10"), F.desc("recall"), "cap").limit(1)


def percentiles(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, interpolated median and 95th percentile, and the value at place floor(0.95 n) from 0 (``p95_at``), the last at most."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))
    each = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(*by))
    at = F.least(F.floor(total * 0.95), total - 1) + 1
    last = each.withColumn("_to", before).withColumn("_at", at).where((F.col("_to") >= F.col("_at")) & (F.col("_to") - F.col("_n") < F.col("_at")))
    out = out.join(last.select(*by, F.col(value).alias("p95_at")), list(by), "left")
    return out.select(*by, "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p95_at")])


# Words that frame a request, and closed-class English words.
FRAMING = (
    "найти", "искать", "поиск", "сообщение", "разговор", "обсуждать", "говорить", "писать", "упоминать", "помнить", "вспомнить", "чат", "ветка",
    "find", "search", "message", "messages", "conversation", "discuss", "talk", "write", "mention", "remember", "chat", "thread",
)
CLOSED_CLASS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its",
    "me", "my", "no", "not", "of", "on", "or", "our", "she", "so", "that", "the", "their", "them", "there", "they", "this", "to", "was", "we", "were", "what", "when",
    "where", "which", "who", "why", "with", "without", "you", "your",
)
# Parts of speech, as analyzers name them, and the kinds they make.
GLUE_POS = ("PREP", "CONJ", "PRCL", "INTJ", "NPRO", "PRED")
QUALIFIER_POS = ("ADJF", "ADJS", "PRTF", "PRTS", "NUMR")
# Kinds from best to worst.
KINDS = ("identifier", "technical", "nominal", "qualifier", "other", "glue")
KIND_RANK = {k: i for i, k in enumerate(KINDS)}


def token_kind(surface: Column, normalized: Column, pos: Column | None = None) -> Column:
    """The kind of a query token. Without an analyzer's part of speech only glue, identifier, technical and other occur."""
    pos = F.lit(None).cast("string") if pos is None else pos
    framing = F.lower(surface).isin(*FRAMING, *CLOSED_CLASS) | normalized.isin(*FRAMING, *CLOSED_CLASS)
    return (
        F.when(framing, "glue")
        .when(surface.rlike(r"\p{Nd}"), "identifier")
        .when(pos.isin(*GLUE_POS), "glue")
        .when(normalized.rlike("^[a-z]+$"), "technical")
        .when(pos == "NOUN", "nominal")
        .when(pos.isin(*QUALIFIER_POS), "qualifier")
        .otherwise("other")
    )


def plan_sparse_view(features: DataFrame, budget: int = 5) -> DataFrame:
    """The tokens a sparse query keeps: no glue unless there is nothing else, best kind and idf first, in the query's order.

    ``features``: query_id, token, ordinal, idf, kind; unique per query and token.
    """
    rank = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])
    all_glue = F.bool_and(F.col("kind") == "glue").over(Window.partitionBy("query_id"))
    own = features.withColumn("_g", all_glue).where(F.col("_g") | (F.col("kind") != "glue"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.try_element_at(rank, F.col("kind")), F.desc("idf"), "ordinal"))
    kept = own.withColumn("_k", best).where(F.col("_k") <= budget)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal")).cast("bigint")
    return kept.select("query_id", "token", "ordinal", "kind", place.alias("place"))


def select_view(features: DataFrame, threshold: float = 0.5) -> DataFrame:
    """sparse for queries of which at least ``threshold`` of the tokens are glue, else full."""
    ratio = F.round(F.avg((F.col("kind") == "glue").cast("double")), 6)
    return features.groupBy("query_id").agg(ratio.alias("glue_ratio")).withColumn("view", F.when(F.col("glue_ratio") >= threshold, "sparse").otherwise("full"))


#: So many query terms go to every task; more are joined by shuffling.
QUERY_TERMS = 200_000


def df_gated(postings: DataFrame, queries: DataFrame, n_docs: int, least: int = 1, most: int = 128) -> DataFrame:
    """Candidates of each query: documents with a term of moderate frequency, scored by all terms' idf; ``rank`` per query.

    ``postings``: term, doc_id (distinct). ``queries``: query_id, term. The
    gate bounds each term's candidates by ``most``. Only postings of query
    terms are kept, and of these only those of documents behind the gate are
    weighed.
    """
    wanted = queries.select("term").distinct()
    hits = written(postings.join(F.broadcast(wanted) if wanted.count() <= QUERY_TERMS else wanted, "term", "left_semi").select("term", "doc_id"), "hits")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    terms = written(queries.join(df, "term").withColumn("idf", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1), "terms")
    gate = terms.where(F.col("df").between(least, most)).select("query_id", "term").join(hits, "term").select("query_id", "doc_id").distinct()
    met = gate.join(hits.join(gate.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    scored = met.join(terms.select("query_id", "term", "idf"), ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.round(F.sum("idf"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("bigint")
    return scored.withColumn("rank", place)


# Fixed value: the weight of a word without a section.
PLAIN_WEIGHT = 0.1


def cover_density(places: Sequence[Column], every: bool = True) -> Column:
    """Cover-density rank of a text from the ascending places of each query word; higher is better.

    A cover is a shortest stretch that holds all words (``every``), else one
    place of any word. It counts PLAIN_WEIGHT over one plus the words in it
    that the query hasn't. Native: the occurrences are walked once, with the
    last place of each word.
    """
    if not every:
        return reduce(lambda a, b: a + b, [F.coalesce(F.size(p), F.lit(0)) for p in places]) * PLAIN_WEIGHT

    def of(word: int, p: Column) -> Column:
        return F.transform(F.coalesce(p, F.array().cast("array<int>")), lambda x: F.struct(x.alias("at"), F.lit(word).alias("word")))

    each = [of(i, p) for i, p in enumerate(places)]
    met = F.array_sort(F.concat(*each))
    # each occurrence with its number among all, so that a cover knows how many it holds
    met = F.transform(met, lambda x, n: F.struct(x["at"].alias("at"), n.alias("n"), x["word"].alias("word")))
    none = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("n"))
    start = F.struct(F.array(*[none for _ in places]).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda v, i: F.when(i == x["word"], F.struct(x["at"].alias("at"), x["n"].alias("n"))).otherwise(v))
        first = F.array_min(last)
        fresh = first["at"] > acc["begun"]
        noise = (x["at"] - first["at"]) - (x["n"] - first["n"])
        return F.struct(last.alias("last"), F.when(fresh, first["at"]).otherwise(acc["begun"]).alias("begun"), (acc["sum"] + F.when(fresh, PLAIN_WEIGHT / (1 + noise)).otherwise(F.lit(0.0))).alias("sum"))

    return F.aggregate(met, start, step, lambda acc: acc["sum"])
