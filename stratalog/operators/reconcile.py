"""A search that weighs what was found directly against controlled aliases and recall, and says how far each row may be trusted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators import search as s
from stratalog.operators.corpus import first_of
from stratalog.operators.feedback import matching_concepts, normal_form
from stratalog.operators.index import Index

KEY = ["session_id", "message_id", "ordinal"]


@dataclass
class Reconciled:
    """``rows``: the messages by ``position``, with their ``retrieval_basis`` and ``promotion_eligibility``."""

    state: str
    mode: str
    eligibility: str
    rows: DataFrame
    concepts: list[str] = field(default_factory=list)
    forms: list[str] = field(default_factory=list)


def _typed(rows: DataFrame, basis: str, eligibility: str) -> DataFrame:
    return rows.withColumn("retrieval_basis", F.lit(basis)).withColumn("promotion_eligibility", F.lit(eligibility)).withColumnRenamed("candidate_rank", "position")


def _merged(groups: list[DataFrame], limit: int) -> DataFrame:
    """Bounded lists one after another, each message where it comes first."""
    out = first_of(groups, KEY, limit)
    return s.ranked(out.withColumnRenamed("position", "_at"), ["branch", "_at", *KEY], "position").drop("branch", "_at")


def reconciled_search(index: Index, concepts: DataFrame, request: s.Request, recall: bool = False) -> Reconciled:
    """Strict matches, recall ones if asked for, and, where strict finds nothing, those of the one concept the query names.

    ``concepts``: concept_id, preferred_label, aliases. A query that names
    several concepts is ambiguous and so are all its rows. Direct matches are
    evidence; everything else is a candidate only. Rows are at most
    ``request.limit``, each message once, where it comes first.
    """
    def flat(query: str, mode: str) -> DataFrame:
        own = s.Request(query, mode, request.scopes, request.session, request.from_time, request.to_time, request.limit)
        found = index.flat(own).withColumn("message_id", F.coalesce("message_id", "local_identity"))
        return spark.createDataFrame(found.toArrow())  # at most 100 rows, looked at several times

    spark, limit = index.spark, request.limit
    query = spark.createDataFrame([(request.query,)], "query string")
    named = sorted(r["concept_id"] for r in matching_concepts(concepts, query).limit(s.MOST_RESULTS).collect())
    strict = flat(request.query, "strict")
    more = flat(request.query, "recall") if recall else strict.where(F.lit(False))
    more = more.join(strict.select(*KEY), KEY, "left_anti").select(*strict.columns)
    found, recalled = not strict.isEmpty(), recall and not more.isEmpty()
    if len(named) > 1:
        rows = _merged([_typed(strict, "AMBIGUOUS_DIRECT_LEXICAL", "AMBIGUOUS"), _typed(more, "AMBIGUOUS_RECALL", "AMBIGUOUS")], limit)
        return Reconciled("AMBIGUOUS_CONCEPT", "controlled_alias_collision", "AMBIGUOUS", rows, named)
    recall_rows = _typed(more, "RECALL_ONLY", "CANDIDATE_ONLY")
    if found:
        rows = _merged([_typed(strict, "DIRECT_LEXICAL", "LEXICAL_EVIDENCE_ELIGIBLE"), recall_rows], limit)
        shown = {r[0] for r in rows.select("promotion_eligibility").distinct().collect()}
        eligibility = next(iter(shown)) if len(shown) == 1 else "MIXED"
        return Reconciled("DIRECT_WITH_RECALL_CANDIDATES" if recalled else "DIRECT_LEXICAL", "strict_and_with_recall_candidates" if recall else "strict_and", eligibility, rows, named)
    if named:
        one = concepts.where(F.col("concept_id") == named[0]).select(F.explode(F.array_compact(F.concat(F.array("preferred_label"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("form"))
        forms = list(dict.fromkeys(r["form"] for r in one.where(normal_form(F.col("form")) != normal_form(F.lit(request.query))).limit(s.MOST_RESULTS).collect()))
        groups = [_typed(flat(f, "strict"), "CONTROLLED_ALIAS_EXPANSION", "CANDIDATE_ONLY") for f in forms]
        if groups and any(not g.isEmpty() for g in groups):
            return Reconciled("RECONCILED_CANDIDATE", "controlled_alias_expansion", "CANDIDATE_ONLY", _merged([*groups, recall_rows], limit), named, forms)
    if recalled:
        return Reconciled("RECALL_CANDIDATE", "explicit_recall_or", "CANDIDATE_ONLY", _merged([recall_rows], limit))
    return Reconciled("UNKNOWN", "no_candidate", "UNKNOWN", _merged([recall_rows.where(F.lit(False))], limit), named)
