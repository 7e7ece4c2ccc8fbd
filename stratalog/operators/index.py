"""An inverted index for many searches over the same texts.

Postings lie in partitions by a hash of the term, documents in partitions by a
hash of their key, each in as many as its size asks for. A search reads the
partitions of its terms, scores there, and fetches the bounded candidates from
the partitions of their keys; no search reads or splits a text again.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratalog.functions.digest import table_digest
from stratalog.functions.text import query_units, tokens
from stratalog.operators import search as s
from stratalog.operators.evaluate import cover_density
from stratalog.shared import children, read_text, shared_path, state_of, write_text

#: Postings and documents of a file, on average.
FILE_POSTINGS, FILE_DOCS = 4_000_000, 250_000
MOST_BUCKETS = 1024
#: What turns a text into terms; another version makes another index.
ANALYZER = "lower letters-and-digits 1"
FILTERS = ("session_id", "search_class", "ordinal", "create_time")


class StaleIndex(RuntimeError):
    """An index that was made of other rows or by another analyzer."""


def _bucket(key: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("bucket")


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


class Index:
    """An index under ``path``; :func:`build_index` makes one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        body = read_text(spark, f"{path}/manifest.json")
        if body is None:
            raise FileNotFoundError(f"no index at {path}")
        m = json.loads(body)
        if m["analyzer"] != ANALYZER:
            raise StaleIndex("made by another analyzer")
        self.spark, self.path, self.key = spark, path, m["key"]
        self.n_docs, self.avgdl, self.fingerprint = m["n_docs"], m["avgdl"], m["fingerprint"]
        self.term_buckets, self.doc_buckets = m["term_buckets"], m["doc_buckets"]
        self.schemas = {k: StructType.fromJson(v) for k, v in m["schemas"].items()}
        self.known: dict[str, int] = {}  # frequencies of the terms asked for so far
        self.there = {k: set(children(spark, f"{path}/{k}")) for k in self.schemas}

    def _part(self, table: str, buckets: Sequence[int]) -> DataFrame:
        """The rows of a table in some of its partitions; only those are listed and read."""
        schema = self.schemas[table]
        buckets = [b for b in buckets if f"bucket={b}" in self.there[table]]
        if not buckets:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/bucket={b}" for b in buckets])

    def _of_terms(self, table: str, terms: Sequence[str]) -> DataFrame:
        buckets = sorted(set(self.spark.sql("SELECT 1").select(F.array(*[_bucket(F.lit(t), self.term_buckets) for t in terms])).first()[0])) if terms else []
        return self._part(table, buckets).where(F.col("term").isin(*terms) if terms else F.lit(False)).drop("bucket")

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """term, key, dl, tf, positions and the columns filters need, of some terms or all."""
        if terms is None:
            return self.spark.read.schema(self.schemas["postings"]).parquet(f"{self.path}/postings").drop("bucket")
        return self._of_terms("postings", terms)

    def frequencies(self, terms: Sequence[str] | None = None) -> DataFrame:
        """``term`` and ``df`` of some terms or all."""
        if terms is None:
            return self.spark.read.schema(self.schemas["terms"]).parquet(f"{self.path}/terms").drop("bucket")
        return self._of_terms("terms", terms)

    def scored(self, query: str, mode: str = "strict", weigh_repeats: bool = True) -> DataFrame:
        """key, the columns filters need and ``score`` of the matches, as :func:`stratalog.operators.search.scored` defines them."""
        units = s.wanted_units(query, mode)
        weights = Counter(units)
        kept = [self.key, *[c for c in FILTERS if c in self.schemas["postings"].names], "dl"]
        if not units or not all(units):
            return self._part("postings", []).select(*kept[:-1], F.lit(0.0).alias("score")).where(F.lit(False))
        terms = sorted({w for u in units for w in u})
        phrases = any(len(u) > 1 for u in weights)
        found = self.postings(terms)
        of = lambda c, t: F.max(F.when(F.col("term") == t, F.col(c)))
        if len(terms) == 1:
            docs = found.select(*kept, F.col("tf").alias("_t0"))
        elif phrases:
            docs = found.groupBy(*kept).agg(*[of("positions", t).alias(f"_p{i}") for i, t in enumerate(terms)])
        else:
            docs = found.groupBy(*kept).agg(*[F.coalesce(of("tf", t), F.lit(0)).alias(f"_t{i}") for i, t in enumerate(terms)])
        at = {t: i for i, t in enumerate(terms)}
        freq = []
        for u in weights:
            if not phrases:
                freq.append(F.col(f"_t{at[u[0]]}"))
                continue
            own = [F.coalesce(F.col(f"_p{at[w]}"), F.array().cast("array<int>")) for w in u]
            # the words' places, each moved back to where the phrase begins
            freq.append(F.size(reduce(F.array_intersect, [own[0], *[_shifted(p, k) for k, p in enumerate(own[1:], 1)]])))
        docs = docs.select(*kept, *[f.alias(f"_f{i}") for i, f in enumerate(freq)])
        if phrases:
            dfs = list(docs.agg(*[F.count_if(F.col(f"_f{i}") > 0) for i in range(len(weights))]).first())
        else:
            if fresh := [t for t in terms if t not in self.known]:
                self.known |= dict.fromkeys(fresh, 0) | {r["term"]: r["df"] for r in self.frequencies(fresh).collect()}  # a row a term of the query
            dfs = [self.known[u[0]] for u in weights]
        return s.with_scores(docs, weights, mode, dfs, self.n_docs, self.avgdl, "dl", weigh_repeats).select(*kept[:-1], "score")

    def density(self, query: str, every: bool = True) -> DataFrame:
        """key, the columns filters need and ``density`` (see :func:`stratalog.operators.evaluate.cover_density`) of the texts with all or any of a query's words."""
        words = list(dict.fromkeys(w for u in query_units(query) for w in u))
        kept = [self.key, *[c for c in FILTERS if c in self.schemas["postings"].names]]
        docs = self.postings(words).groupBy(*kept).agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_p{i}") for i, t in enumerate(words)])
        if every:
            docs = docs.dropna(subset=[f"_p{i}" for i in range(len(words))])
        return docs.select(*kept, cover_density([F.col(f"_p{i}") for i in range(len(words))], every).alias("density") if words else F.lit(0.0).alias("density"))

    def documents(self, rows: DataFrame, most: int) -> DataFrame:
        """The whole rows behind at most ``most`` rows of keys, read from the partitions of those keys, with the other columns of ``rows``."""
        own = rows.withColumn("bucket", _bucket(self.key, self.doc_buckets)).limit(most).toArrow()
        keys = own.column(self.key).to_pylist()
        part = self._part("docs", sorted(set(own.column("bucket").to_pylist()))).drop("bucket")
        extra = [c for c in rows.columns if c == self.key or c not in part.columns]
        few = self.spark.createDataFrame(own.select(extra))
        return part.where(F.col(self.key).isin(*keys) if keys else F.lit(False)).join(F.broadcast(few), self.key)

    def candidates(self, r: s.Request, cap: int | None = None) -> DataFrame:
        """The rows of :func:`stratalog.operators.search.candidates`, by the index."""
        found = s.bounded(s.in_scope(self.scored(r.query, "strict" if r.mode == "auto" else r.mode), r), r, cap)
        return s.ranked(self.documents(found, r.budget), s.ORDER, "candidate_rank")

    def search(self, r: s.Request) -> s.Answer:
        """The default search by the index: candidates, exact groups, limit; auto turns to recall only if strict finds nothing."""
        rows = self.candidates(r)
        if r.mode == "auto" and rows.isEmpty():
            rows = self.candidates(s.recalling(r))
        groups = s.exact_groups(rows, limit=r.limit)
        return s.Answer("NO_SIGNAL" if groups.isEmpty() else "FOUND", groups)

    def flat(self, r: s.Request) -> DataFrame:
        return self.candidates(r).where(F.col("candidate_rank") <= r.limit)

    def before(self, query: str, time: float, limit: int) -> DataFrame:
        """Strict matches created before ``time``; messages without a time are none."""
        found = self.scored(query).where(F.col("create_time") < time)
        return s.ranked(found.orderBy(*s.ORDER).limit(limit), s.ORDER, "candidate_rank")


def build_index(docs: DataFrame, path: str, key: str = "row_id", text: str = "text") -> Index:
    """Writes postings, documents and term frequencies of ``docs`` (rows with a text) under ``path``, and a manifest as the last file.

    Postings are spread over the files of their term's partition, so that a
    frequent term has many files; they carry the columns that filters need.
    An index without a manifest doesn't exist. The manifest has the number and
    mean length of the documents and an order-independent fingerprint of keys
    and texts.
    """
    spark = docs.sparkSession
    own = docs.withColumn("_words", F.explode(F.array(tokens(F.col(text))))).withColumn("dl", F.size("_words"))
    sums = own.agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
    n, words = sums["n"], sums["words"] or 0
    doc_buckets = min(MOST_BUCKETS, max(1, math.ceil(n / FILE_DOCS)))
    term_buckets = min(MOST_BUCKETS, max(8, math.ceil(words / FILE_POSTINGS)))
    spread = max(1, math.ceil(words / FILE_POSTINGS / term_buckets))
    filters = [c for c in FILTERS if c in docs.columns and c != key]
    each = own.select(key, *filters, "dl", F.posexplode("_words").alias("pos", "term"))
    posts = each.groupBy("term", key, *filters, "dl").agg(F.sort_array(F.collect_list("pos")).alias("positions")).withColumn("tf", F.size("positions"))
    posts = posts.withColumn("bucket", _bucket("term", term_buckets)).repartition(term_buckets * spread, "bucket", F.pmod(F.hash(key), F.lit(spread)))
    posts.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    schemas = {"postings": posts.schema}
    read = spark.read.schema(posts.schema).parquet(f"{path}/postings")
    terms = read.groupBy("bucket", "term").agg(F.count("*").alias("df")).select("term", "df", "bucket")
    terms.repartition(term_buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    schemas["terms"] = terms.schema
    kept = docs.withColumn("bucket", _bucket(key, doc_buckets))
    schemas["docs"] = kept.schema
    kept.repartition(doc_buckets, "bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/docs")
    body = {
        "analyzer": ANALYZER, "key": key, "n_docs": n, "avgdl": words / n if n else 0.0, "term_buckets": term_buckets, "doc_buckets": doc_buckets,
        "fingerprint": table_digest(docs, [key, text]).first()["digest"], "schemas": {k: v.jsonValue() for k, v in schemas.items()},
    }
    write_text(spark, f"{path}/manifest.json", json.dumps(body), replace=True)
    return Index(spark, path)


_built: dict[tuple[str, str, str], tuple[str, Index]] = {}


def index_of(spark: SparkSession, table: str, key: str = "row_id", indexed=s.indexable) -> Index:
    """The index of a parquet table in the shared folder: made at the first call of an application, and made anew when the table's files have changed."""
    at = (spark.sparkContext.applicationId, table, key)
    state = state_of(spark, table)
    if at not in _built or _built[at][0] != state:
        _built[at] = state, build_index(indexed(spark.read.parquet(table)), shared_path(spark, "index"), key)
    return _built[at][1]


def verify_index(index: Index, docs: DataFrame, text: str = "text") -> bool:
    """Whether the index was made of exactly these rows."""
    return table_digest(docs, [index.key, text]).first()["digest"] == index.fingerprint
