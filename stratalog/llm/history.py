"""New batches checked for repeats against everything accepted before.

The history is a set of tables: digests, classes of equal sets (a home each)
with the artifacts in them, minwise band keys and members of the homes, and
links between homes whose sets overlap enough. Each accepted batch adds a part
to each table, in as many hash partitions as its rows ask for, and a manifest
that names all parts; the manifest is the commit, so a batch is in the history
wholly or not at all, and another process can go on where one ended. Parts of
like size are merged eight at a time, so there are few however many batches
came.

A batch computes keys for its own sets alone, reads only the partitions its
keys fall in, verifies the overlap of the candidates it meets exactly, and
appends its own keys and the links it found. Equal sets form a class whose keys
are kept once, so copies meet as one and are never paired unless a caller asks
for the pairs.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratalog.shared import _fs, children, read_text, shared_path, write_text, written

OVERLAP = 0.8
#: A pair of overlap 0.8 shares no band with probability (1 - 0.8 ** 3) ** 24, about 3 in 100 million.
BANDS, ROWS = 24, 3
#: Rows of a partition of a part, on average, and the most partitions of one.
BUCKET_ROWS, MOST_BUCKETS = 200_000, 4096
#: Homes of one band key that are paired directly; of more, those are paired that share one of their rarest members.
HOT_KEY = 500
#: Parts of like size (within this factor) that are merged.
MERGED = 8
TABLES = {"digests": "digest", "homes": "set_id", "copies": "home", "bands": "key", "members": "home", "links": "a"}


class Conflict(RuntimeError):
    """Another writer added a batch in the meantime."""


def digest(raw: Column) -> Column:
    """The hexadecimal digest however written: case, surrounding space and an algorithm prefix don't count."""
    plain = F.regexp_replace(F.lower(raw), r"^\s*(sha-?256\s*[:=]?\s*)?|\s+$", "")
    return F.nullif(plain, F.lit(""))


def utc_day(raw: Column) -> Column:
    """The UTC day of an ISO-8601 time with any offset; null where it isn't one."""
    return F.to_date(F.to_utc_timestamp(F.try_to_timestamp(raw), F.current_timezone()))


def artifact_records(artifacts: DataFrame) -> DataFrame:
    """``artifact_id``, ``digest`` and ``batch`` (UTC day of acceptance)."""
    return artifacts.select("artifact_id", digest(F.col("sha256")).alias("digest"), utc_day(F.col("accepted_at")).alias("batch"))


def artifact_members(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """``artifact_id`` and 128-bit fingerprints of its distinct source objects."""
    o = F.col("source_object_sha256")
    own = sources.where(o.isNotNull()).select("page_id", F.xxhash64(o).alias("o1"), F.xxhash64(o, F.lit(1)).alias("o2"))
    return pages.select("page_id", "artifact_id").where("artifact_id is not null").join(own, "page_id").select("artifact_id", "o1", "o2").distinct()


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _overlapping(a: Column, b: Column, least: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * least


def _two_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.a", "l.b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y) once each, smaller first."""
    return pairs.where("x <> y").select(F.least("x", "y").alias("first_artifact_id"), F.greatest("x", "y").alias("second_artifact_id")).distinct()


class _Snapshot:
    """The parts of the tables at one time. Parts are never changed, so it stays readable."""

    def __init__(self, spark: SparkSession, parts: dict[str, list[dict]], schemas: dict[str, dict]) -> None:
        self.spark, self.parts, self.schemas = spark, parts, schemas
        #: Bytes of the partitions read, by table.
        self.read: dict[str, int] = {}

    def rows(self, table: str, probes: DataFrame | None = None) -> DataFrame | None:
        """A table's rows, with ``probes`` (a column of the table's key) only those of its keys; None if there is no part yet."""
        parts, key = self.parts.get(table, []), TABLES[table]
        if not parts:
            return None
        hit = None
        if probes is not None:
            most = max(p["buckets"] for p in parts)  # powers of two, so the greatest number tells the others
            hit = {r[0] for r in probes.select(_bucket(key, most)).distinct().collect()}  # at most MOST_BUCKETS numbers
        paths = []
        for p in parts:
            own = None if hit is None else {h % p["buckets"] for h in hit}
            met = [b for b in p["sizes"] if own is None or int(b) in own]
            paths += [f"{p['path']}/bucket={b}" for b in met]
            self.read[table] = self.read.get(table, 0) + sum(p["sizes"][b] for b in met)
        if not paths:
            return self.empty(table)
        out = self.spark.read.schema(StructType.fromJson(self.schemas[table])).parquet(*paths)
        return out if probes is None else out.join(probes.select(key).distinct(), key, "left_semi")

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], StructType.fromJson(self.schemas[table]))

    def bytes(self, *tables: str) -> int:
        """Bytes of all parts."""
        return sum(sum(p["sizes"].values()) for t in tables or TABLES for p in self.parts.get(t, []))


@dataclass
class Accepted:
    """What a batch turned out to be.

    ``artifacts``: artifact_id, digest, home (null without a set) and state:
    copy (digest or set known from an earlier batch or a lower id of this one),
    near (overlaps enough with such a one), new. ``links``: the homes a and b
    whose sets overlap enough, found with this batch.
    """

    artifacts: DataFrame
    links: DataFrame
    before: _Snapshot

    def pairs(self) -> DataFrame:
        """The pairs with at least one artifact of the batch, smaller first: copies and neighbours, expanded."""
        digests = self.artifacts.where("digest is not null").select("digest", F.col("artifact_id").alias("x"))
        copies = self.artifacts.where("home is not null").select("home", F.col("artifact_id").alias("x"))

        def every(table: str, own: DataFrame, key: str, probes: DataFrame) -> DataFrame:
            old = self.before.rows(table, probes.select(F.col(key).alias(TABLES[table])))
            own = own.withColumnRenamed("x", "y")
            return own if old is None else own.unionByName(old.withColumnRenamed("artifact_id", "y"))

        same = digests.join(every("digests", digests, "digest", digests), "digest").select("x", "y")
        equal = copies.join(every("copies", copies, "home", copies), "home").select("x", "y")
        links = _two_ways(self.links)
        old = self.before.rows("links", copies.select(F.col("home").alias("a")))
        links = links if old is None else links.unionByName(old)
        met = copies.withColumnRenamed("home", "a").join(links, "a").select("x", F.col("b").alias("home"))
        apart = met.join(every("copies", copies, "home", met), "home").select("x", "y")
        return _ordered(same.unionByName(equal).unionByName(apart))


class History:
    """What has been accepted, under ``path`` in the shared folder; opened again, it goes on after the last whole batch."""

    def __init__(self, spark: SparkSession, path: str | None = None, overlap: float = OVERLAP) -> None:
        self.spark, self.path = spark, (path or shared_path(spark, "history")).rstrip("/")
        known = children(spark, f"{self.path}/manifest")
        names = [n for n in known if n.endswith(".json") and not n.startswith(".")]
        body = json.loads(read_text(spark, f"{self.path}/manifest/{names[-1]}")) if names else {"step": 0, "overlap": overlap, "parts": {}, "schemas": {}}
        if body["overlap"] != overlap:
            raise ValueError(f"the history was made for an overlap of {body['overlap']}")
        self.overlap, self.steps, self.parts, self.schemas = overlap, body["step"], body["parts"], body["schemas"]

    def now(self) -> _Snapshot:
        return _Snapshot(self.spark, {k: list(v) for k, v in self.parts.items()}, self.schemas)

    def _part(self, table: str, df: DataFrame, rows: int) -> dict:
        """Writes ``df`` as a part of ``table``; it counts once a manifest names it."""
        n = min(MOST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS))))
        at = f"{self.path}/{table}/{self.steps:09d}-{uuid.uuid4().hex}"
        df.withColumn("bucket", _bucket(TABLES[table], n)).repartition(n, "bucket").write.partitionBy("bucket").parquet(at)
        self.schemas.setdefault(table, df.schema.jsonValue())
        sizes = {}
        for name in children(self.spark, at):
            if name.startswith("bucket="):
                where, fs = _fs(self.spark, f"{at}/{name}")
                sizes[name.removeprefix("bucket=")] = fs.getContentSummary(where).getLength()
        return {"path": at, "buckets": n, "rows": rows, "sizes": sizes}

    def _commit(self, fresh: dict[str, dict]) -> None:
        parts = {t: [*self.parts.get(t, []), fresh[t]] if t in fresh else self.parts.get(t, []) for t in TABLES}
        for t, own in parts.items():
            tiers: dict[int, list[dict]] = {}
            for p in own:
                tiers.setdefault(int(math.log(max(1, p["rows"] / BUCKET_ROWS), MERGED)), []).append(p)
            for few in tiers.values():
                if len(few) >= MERGED:
                    rows = _Snapshot(self.spark, {t: few}, self.schemas).rows(t)
                    parts[t] = [p for p in parts[t] if p not in few] + [self._part(t, rows, sum(p["rows"] for p in few))]
        body = {"step": self.steps + 1, "overlap": self.overlap, "parts": parts, "schemas": self.schemas}
        if not write_text(self.spark, f"{self.path}/manifest/{self.steps + 1:09d}.json", json.dumps(body)):
            raise Conflict("another writer added a batch; open the history again")
        self.parts, self.steps = parts, self.steps + 1

    def accept(self, records: DataFrame, members: DataFrame) -> Accepted:
        """Checks a batch against itself and all earlier ones, then adds it.

        ``records``: artifact_id, digest (null: none). ``members``:
        artifact_id, o1, o2, distinct; those of other artifacts are ignored.
        An empty batch is a step without rows. An artifact that is accepted
        again is a copy of itself and in no pair with itself.
        """
        before = self.now()
        records = written(records.select("artifact_id", "digest").distinct(), "batch")
        own = members.join(records.select("artifact_id").distinct(), "artifact_id", "left_semi")
        sets = own.groupBy("artifact_id").agg(F.count("*").alias("size"), F.bit_xor("o1").alias("x1"), F.bit_xor("o2").alias("x2"))
        sets = written(sets.select("artifact_id", F.unhex(F.md5(F.concat_ws(",", "size", "x1", "x2"))).alias("set_id"), F.col("size").cast("int").alias("size")), "sets")

        # a class of equal sets goes by its first artifact, its home
        known = before.rows("homes", sets)
        first = sets.groupBy("set_id").agg(F.min("artifact_id").alias("first"), F.min("size").alias("size"))
        classes = first.withColumn("home", F.lit(None).cast(first.schema["first"].dataType)) if known is None else first.join(known, "set_id", "left")
        classes = written(classes.select("set_id", "size", F.coalesce("home", "first").alias("home"), F.col("home").isNull().alias("fresh")), "homes")
        copies = written(sets.join(classes.select("set_id", "home", "fresh"), "set_id").select("home", "artifact_id", "fresh"), "copies")
        fresh = classes.where("fresh").select("home", "size")
        sums = fresh.agg(F.count("*").alias("homes"), F.sum("size").alias("members")).first()
        n_records, n_copies = records.count(), copies.count()

        set_members = written(own.join(fresh.withColumnRenamed("home", "artifact_id"), "artifact_id").select(F.col("artifact_id").alias("home"), "size", "o1", "o2"), "own")
        mins = [F.min(F.xxhash64("o1", F.lit(i))).alias(f"m{i}") for i in range(BANDS * ROWS)]
        # a set so small that one member more is too many has no neighbour but its equals
        signed = set_members.where(F.col("size") >= math.ceil(self.overlap / (1 - self.overlap) - 1e-9) if self.overlap < 1 else F.lit(False)).groupBy("home", "size").agg(*mins)
        keys = F.array(*[F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)])
        new = {
            "digests": self._part("digests", records.where("digest is not null").select("digest", "artifact_id"), n_records),
            "homes": self._part("homes", classes.where("fresh").select("set_id", "home"), sums["homes"]),
            "copies": self._part("copies", copies.select("home", "artifact_id"), n_copies),
            "bands": self._part("bands", signed.select("home", "size", F.explode(keys).alias("key")), sums["homes"] * BANDS),
            "members": self._part("members", set_members.select("home", "size", "o1", "o2"), sums["members"] or 0),
        }
        links = written(self._links(before, _Snapshot(self.spark, {t: [p] for t, p in new.items()}, self.schemas)), "links")
        n_links = links.count()
        if n_links:
            new["links"] = self._part("links", _two_ways(links), 2 * n_links)
        self.schemas.setdefault("links", links.schema.jsonValue())
        self._commit({t: p for t, p in new.items() if p["sizes"]})

        digests = records.where("digest is not null")
        old = before.rows("digests", digests)
        seen = digests.select("digest", "artifact_id", F.lit(False).alias("old"))
        seen = seen if old is None else seen.unionByName(old.select("digest", "artifact_id", F.lit(True).alias("old")))
        seen = seen.groupBy("digest").agg(F.bool_or("old").alias("old"), F.min("artifact_id").alias("least"))
        near = _two_ways(links).join(fresh.withColumnRenamed("home", "a"), "a").join(fresh.select(F.col("home").alias("b"), F.lit(True).alias("own")), "b", "left")
        near = near.groupBy(F.col("a").alias("home")).agg(F.bool_or(F.col("own").isNull() | (F.col("b") < F.col("a"))).alias("near"))
        rows = records.join(copies, "artifact_id", "left").join(seen, "digest", "left").join(near, "home", "left")
        copied = F.coalesce(F.col("old") | (F.col("least") < F.col("artifact_id")), F.lit(False)) | F.coalesce(~F.col("fresh") | (F.col("home") != F.col("artifact_id")), F.lit(False))
        state = F.when(copied, "copy").when(F.coalesce("near", F.lit(False)), "near").otherwise("new")
        return Accepted(written(rows.select("artifact_id", "digest", "home", state.alias("state")), "accepted"), links, before)

    def _links(self, before: _Snapshot, new: _Snapshot) -> DataFrame:
        """The pairs of homes (a < b), at least one of them new, whose sets overlap enough."""
        own, members = new.rows("bands"), new.rows("members")
        if own is None or not new.parts["bands"][0]["sizes"]:
            home = StructType.fromJson(self.schemas["members"])["home"].dataType.simpleString()
            return self.spark.createDataFrame([], f"a {home}, b {home}")
        old = before.rows("bands", own)
        every = own.withColumn("new", F.lit(True))
        every = every if old is None else every.unionByName(old.withColumn("new", F.lit(False)))
        hot = written(every.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY).select("key"), "hot")
        found = []
        cold = every.join(hot, "key", "left_anti")
        a = cold.where("new").select("key", F.col("home").alias("a"), F.col("size").alias("na"))
        b = cold.select("key", F.col("home").alias("b"), F.col("size").alias("nb"))
        found.append(a.join(b, "key").where((F.col("a") != F.col("b")) & _overlapping(F.col("na"), F.col("nb"), self.overlap)).select("a", "b", "na", "nb"))
        if not hot.isEmpty():
            # the homes of crowded keys: sets that overlap enough share one of their rarest members, whatever is common to the crowd
            crowd = written(every.join(hot, "key", "left_semi").groupBy("home", "size").agg(F.bool_or("new").alias("new")), "crowd")
            theirs = self._members_of(before, members, crowd).drop("size").join(crowd, "home")
            rarity = theirs.groupBy("o1", "o2").agg(F.count("*").alias("df"))
            ranked = theirs.join(rarity, ["o1", "o2"]).groupBy("home", "size", "new").agg(F.sort_array(F.collect_list(F.struct("df", "o1", "o2"))).alias("m"))
            prefix = F.col("size") - F.ceil(F.col("size") * self.overlap - 1e-9).cast("int") + 1
            heads = written(ranked.select("home", "size", "new", F.explode(F.slice("m", F.lit(1), prefix)).alias("m")).select("home", "size", "new", "m.o1", "m.o2"), "heads")
            a = heads.where("new").select("o1", "o2", F.col("home").alias("a"), F.col("size").alias("na"))
            b = heads.select("o1", "o2", F.col("home").alias("b"), F.col("size").alias("nb"))
            found.append(a.join(b, ["o1", "o2"]).where((F.col("a") != F.col("b")) & _overlapping(F.col("na"), F.col("nb"), self.overlap)).select("a", "b", "na", "nb"))
        # two new homes meet from both sides: keep one of them
        met = reduce(DataFrame.unionByName, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("both")).distinct()
        met = written(met, "met")
        sides = met.select(F.col("a").alias("home")).union(met.select("b")).distinct()
        theirs = self._members_of(before, members, sides).select("home", "o1", "o2")
        left = met.join(theirs.withColumnRenamed("home", "a"), "a")
        common = left.join(theirs.withColumnRenamed("home", "b"), ["b", "o1", "o2"]).groupBy("a", "b", "both").agg(F.count("*").alias("common"))
        return common.where(F.col("common") >= F.lit(self.overlap) * (F.col("both") - F.col("common")) - F.lit(1e-9)).select("a", "b")

    def _members_of(self, before: _Snapshot, own: DataFrame, homes: DataFrame) -> DataFrame:
        old = before.rows("members", homes)
        own = own.join(homes.select("home"), "home", "left_semi")
        return own if old is None else own.unionByName(old)

    def pairs(self) -> DataFrame:
        """All pairs of accepted artifacts that repeat each other, smaller first: the classes and links, expanded."""
        now = self.now()
        digests, copies, links = (now.rows(t) for t in ("digests", "copies", "links"))
        found = []
        if digests is not None:
            found.append(digests.withColumnRenamed("artifact_id", "x").join(digests.withColumnRenamed("artifact_id", "y"), "digest").where("x < y").select("x", "y"))
        if copies is not None:
            one, two = copies.withColumnRenamed("artifact_id", "x"), copies.withColumnRenamed("artifact_id", "y")
            found.append(one.join(two, "home").where("x < y").select("x", "y"))
            if links is not None:
                found.append(one.withColumnRenamed("home", "a").join(links.where("a < b"), "a").join(two.withColumnRenamed("home", "b"), "b").select("x", "y"))
        if not found:
            return self.spark.createDataFrame([], "first_artifact_id bigint, second_artifact_id bigint")
        return _ordered(reduce(DataFrame.unionByName, found))


def repeats(artifacts: DataFrame, pages: DataFrame, sources: DataFrame, steps: int = 2) -> DataFrame:
    """The pairs of artifacts that repeat each other, batch by batch in order of acceptance.

    The days are taken in ``steps`` batches of about equally many artifacts:
    the first fills the history, each later one is checked against it and
    itself. The pairs are the same for any ``steps``. An artifact without
    pages or with only null objects has no set and can match by digest only;
    a null digest matches none; an unreadable accepted_at is a day before all
    others; a repeated artifact_id doesn't pair with itself; empty tables give
    no pairs; other columns are ignored.
    """
    records = written(artifact_records(artifacts.where("artifact_id is not null")), "records")
    members = written(artifact_members(pages, sources), "members")
    history = History(artifacts.sparkSession)
    for batch in batches(records, steps):
        history.accept(batch, members)
    return history.pairs()


def batches(records: DataFrame, steps: int) -> list[DataFrame]:
    """Whole days in ``steps`` batches of about equally many records, in order."""
    days = records.groupBy("batch").count().orderBy(F.col("batch").asc_nulls_first()).collect()  # a row a day
    total, seen, cuts = sum(r["count"] for r in days), 0, []
    for r in days:
        if seen * steps >= total * (len(cuts) + 1) and r["batch"] is not None:
            cuts.append(r["batch"])
        seen += r["count"]
    day = F.coalesce(F.col("batch"), F.lit("0001-01-01").cast("date"))
    step = reduce(lambda a, b: a + b, [(day >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    return [records.where(step == i).drop("batch") for i in range(len(cuts) + 1)]
