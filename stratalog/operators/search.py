"""Lexical search over messages: match, score, bound, group.

Without an index a search is one pass that computes term frequencies in place
and one row of corpus statistics; nothing is shuffled but the bounded
candidates. :mod:`stratalog.operators.index` has the index for many searches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.text import folded_words, folded_tokens, query_units, tokens

SCOPES = ("dialogue", "evidence", "trace")
DEFAULT_SCOPES = ("dialogue", "evidence")
MODES = ("strict", "recall", "phrase", "auto")
MOST_CANDIDATES, MOST_RESULTS, LONGEST_QUERY = 300, 100, 512
SESSION_CAP = 3
# BM25 parameters and the least inverse document frequency of a common term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


class InvalidSearch(ValueError):
    """A request that no search can answer."""


@dataclass(frozen=True)
class Request:
    """A checked search request."""

    query: str
    mode: str = "strict"
    scopes: tuple[str, ...] = DEFAULT_SCOPES
    session: str | None = None
    from_time: float | None = None
    to_time: float | None = None
    limit: int = 10
    budget: int | None = None

    def __post_init__(self) -> None:
        q = self.query.strip()
        object.__setattr__(self, "query", q)
        if not 1 <= len(q) <= LONGEST_QUERY or not query_units(q):
            raise InvalidSearch("the query must have 1 to 512 characters and a token")
        if self.mode not in MODES:
            raise InvalidSearch(f"no mode {self.mode}")
        if not self.scopes or not set(self.scopes) <= set(SCOPES):
            raise InvalidSearch("at least one scope, all of them known")
        if not 1 <= self.limit <= MOST_RESULTS:
            raise InvalidSearch("the limit must be 1 to 100")
        for t in (self.from_time, self.to_time):
            if t is not None and not math.isfinite(t):
                raise InvalidSearch("times must be finite")
        if self.from_time is not None and self.to_time is not None and self.from_time > self.to_time:
            raise InvalidSearch("the times are out of order")
        budget = candidate_budget(self.limit) if self.budget is None else self.budget
        if not self.limit <= budget <= MOST_CANDIDATES:
            raise InvalidSearch("the budget must lie between the limit and 300")
        object.__setattr__(self, "budget", budget)


def candidate_budget(limit: int) -> int:
    """Candidates looked at for ``limit`` results, by default."""
    return min(MOST_CANDIDATES, 3 * limit)


def indexable(messages: DataFrame) -> DataFrame:
    """The messages a search can find: not hidden, not empty."""
    return messages.where((F.col("search_class") != "hidden") & (F.col("text") != ""))


def in_scope(messages: DataFrame, r: Request) -> DataFrame:
    """Scope, session and time filters. A message without a time passes any time range."""
    out = messages.where(F.col("search_class").isin(*r.scopes))
    if r.session is not None:
        out = out.where(F.col("session_id") == r.session)
    if r.from_time is not None:
        out = out.where(F.col("create_time").isNull() | (F.col("create_time") >= r.from_time))
    if r.to_time is not None:
        out = out.where(F.col("create_time").isNull() | (F.col("create_time") <= r.to_time))
    return out


def frequency(words: Column, unit: Sequence[str]) -> Column:
    """How often a unit (a word, or a phrase of adjacent words) stands in a token array."""
    if not unit:
        return F.lit(0)
    if len(unit) == 1:
        return F.size(F.filter(words, lambda w: w == unit[0]))
    phrase = F.array(*[F.lit(w) for w in unit])
    places = F.when(F.size(words) >= len(unit), F.sequence(F.lit(1), F.size(words) - len(unit) + 1)).otherwise(F.array())
    return F.size(F.filter(places, lambda i: F.slice(words, i, len(unit)) == phrase))


def wanted_units(query: str, mode: str) -> list[tuple[str, ...]]:
    """The units a mode looks for: under phrase all words are one, under recall empty ones don't count."""
    units = [tuple(u) for u in query_units(query)]
    if mode == "phrase":
        return [tuple(w for u in units for w in u)]
    return [u for u in units if u] if mode == "recall" else units


def with_scores(docs: DataFrame, weights: Mapping[tuple[str, ...], int], mode: str, dfs: Sequence[int], n: int, avgdl: float | None, dl: str, weigh_repeats: bool) -> DataFrame:
    """The matches among ``docs``, which have each unit's frequency in ``_f0``, ``_f1``..., with ``score``."""
    hits = [F.col(f"_f{i}") > 0 for i in range(len(weights))]
    parts = []
    for i, (w, df) in enumerate(zip(weights.values(), dfs)):
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)
        f = F.col(f"_f{i}")
        parts.append((w if weigh_repeats else 1) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col(dl) / (avgdl or 1.0))))
    return docs.where(reduce(lambda a, b: a & b if mode != "recall" else a | b, hits)).withColumn("score", F.round(-reduce(lambda a, b: a + b, parts), 6))


def scored(messages: DataFrame, query: str, mode: str = "strict", weigh_repeats: bool = True) -> DataFrame:
    """Messages that match, with ``score``: minus BM25, so lower is better, rounded to six places.

    strict: every unit occurs; recall: any; phrase: all the query's words side
    by side. A unit that the query repeats counts as often (``weigh_repeats``)
    or once. An empty phrase matches nothing under strict and is ignored
    under recall.
    """
    units = wanted_units(query, mode)
    weights = Counter(units)
    if not units or not all(units):
        return messages.withColumn("score", F.lit(0.0)).where(F.lit(False))
    # the exploded array of one keeps the optimizer from splitting the text anew in each expression that uses the words
    split = lambda df: df.withColumn("_words", F.explode(F.array(tokens(F.col("text"))))).withColumn("_dl", F.size("_words"))
    low = F.lower("text")
    has = [reduce(lambda a, b: a & b, [low.contains(w) for w in u]) for u in weights]
    counts = split(indexable(messages).select("text", *[h.alias(f"_h{i}") for i, h in enumerate(has)]))
    seen = [F.count_if(F.when(F.col(f"_h{i}"), frequency(F.col("_words"), u) > 0)) for i, u in enumerate(weights)]
    stats = counts.agg(F.count("*").alias("n"), F.avg("_dl").alias("dl"), *seen).first()
    docs = split(indexable(messages).where(reduce(lambda a, b: a & b if mode != "recall" else a | b, has)))
    each = F.struct(*[frequency(F.col("_words"), u).alias(f"_f{i}") for i, u in enumerate(weights)])
    docs = docs.withColumn("_f", F.explode(F.array(each))).select("*", "_f.*").drop("_f")
    return with_scores(docs, weights, mode, list(stats)[2:], stats["n"], stats["dl"], "_dl", weigh_repeats).drop("_words", "_dl", *[f"_f{i}" for i in range(len(weights))])


ORDER = ("score", "session_id", "ordinal", "row_id")


def candidates(messages: DataFrame, r: Request, cap: int | None = None) -> DataFrame:
    """At most ``budget`` best matches with ``candidate_rank`` from 1; recall keeps at most ``cap`` of a session first.

    Statistics are those of the whole corpus; scope filters come after.
    """
    found = in_scope(scored(messages, r.query, "strict" if r.mode == "auto" else r.mode), r)
    return ranked(bounded(found, r, cap), ORDER, "candidate_rank")


def bounded(found: DataFrame, r: Request, cap: int | None = None) -> DataFrame:
    """The best matches within the budget, under recall at most ``cap`` of a session."""
    if r.mode == "recall":
        cap = (r.limit if r.session is not None else min(SESSION_CAP, r.limit)) if cap is None else cap
        found = per_session(found, cap)
    return found.orderBy(*ORDER).limit(r.budget)


def recalling(r: Request) -> Request:
    """The same request under recall."""
    return replace(r, mode="recall")


def per_session(found: DataFrame, cap: int) -> DataFrame:
    """The best ``cap`` matches of each session."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(*[c for c in ORDER if c != "session_id"]))
    return found.withColumn("_place", place).where(F.col("_place") <= cap).drop("_place")


def ranked(bounded: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """A bounded table (a search's candidates) numbered from 1 in a total order."""
    return bounded.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint"))


def rerank(found: DataFrame, query: str, limit: int) -> DataFrame:
    """Recall candidates in order of their sessions' evidence, sessions taken in turns.

    A session's evidence: query words its rows cover together, dialogue rows,
    best score. Its rows come by score; the first rows of all sessions come
    before the second ones. Adds ``session_rank``, ``row_index``, ``result_rank``.
    """
    words = F.array(*[F.lit(w) for w in dict.fromkeys(folded_words(query))])
    rows = found.withColumn("_covered", F.array_intersect(words, folded_tokens(F.col("text"))))
    per = rows.groupBy("session_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_covered")))).alias("_cover"),
        F.count_if(F.col("search_class") == "dialogue").alias("_talk"),
        F.min("score").alias("_best"),
    )
    per = ranked(per, [F.desc("_cover"), F.desc("_talk"), F.col("_best"), F.col("session_id")], "session_rank")
    index = F.row_number().over(Window.partitionBy("session_id").orderBy("score", "ordinal", "row_id")).cast("bigint")
    rows = rows.drop("_covered").withColumn("row_index", index).join(per.drop("_cover", "_talk", "_best"), "session_id")
    order = ["row_index", "session_rank"]
    return ranked(rows.orderBy(*order).limit(limit), order, "result_rank")


def exact_groups(rows: DataFrame, rank: str = "candidate_rank", limit: int | None = None, text: str = "text", occurrence: Sequence[str] = ("session_id", "ordinal", "message_id", "search_class", "score")) -> DataFrame:
    """Bounded rows grouped by exact text: first row as representative, all occurrences in rank order.

    Columns: group_rank, text, representative, occurrence_count, occurrences.
    """
    fields = [c for c in occurrence if c in rows.columns]
    own = F.struct(F.col(rank).alias("rank"), *fields)
    out = rows.groupBy(text).agg(F.min(rank).alias("_first"), F.min_by(F.struct(*fields), F.col(rank)).alias("representative"), F.count("*").alias("occurrence_count"), F.sort_array(F.collect_list(own)).alias("occurrences"))
    out = out.orderBy("_first") if limit is None else out.orderBy("_first").limit(limit)
    return ranked(out, ["_first"], "group_rank").drop("_first")


@dataclass
class Answer:
    status: str
    groups: DataFrame


def search(messages: DataFrame, r: Request) -> Answer:
    """The default search: candidates, exact groups, limit. auto turns to recall only if strict finds nothing."""
    rows = candidates(messages, r)
    if r.mode == "auto" and rows.isEmpty():
        rows = candidates(messages, recalling(r))
    groups = exact_groups(rows, limit=r.limit)
    return Answer("NO_SIGNAL" if groups.isEmpty() else "FOUND", groups)


def flat(messages: DataFrame, r: Request) -> DataFrame:
    """The matches without grouping."""
    return candidates(messages, r).where(F.col("candidate_rank") <= r.limit)


def before(messages: DataFrame, query: str, time: float, limit: int) -> DataFrame:
    """Strict matches created before ``time``; messages without a time are none."""
    found = scored(messages, query, "strict").where(F.col("create_time") < time)
    return ranked(found.orderBy(*ORDER).limit(limit), ORDER, "candidate_rank")


# Markers of a request that looks for something said earlier.
DIRECT_MARKERS = ("вспомни", "восстанови", "по нашим разговорам", "session search", "recall", "recover", "find in our conversations")
FIND_WORD = "найди"
HISTORY_MARKERS = ("разговор", "истори", "чат", "предыдущ", "раньше", "старый", "старую", "session", "сессион")


def looks_back(text: Column, direct: Sequence[str] = DIRECT_MARKERS, find: str = FIND_WORD, history: Sequence[str] = HISTORY_MARKERS) -> Column:
    """Whether a text asks for history: a direct marker, or the find word together with a history marker."""
    low = F.lower(text)
    any_of = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return any_of(direct) | (low.contains(find) & any_of(history))


def term_statistics(messages: DataFrame) -> DataFrame:
    """``term``, ``df`` (messages that have it) and ``idf`` = ln((N + 1) / (df + 1)) + 1 of every term."""
    docs = indexable(messages)
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.round(F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1, 6))
