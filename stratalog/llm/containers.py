"""Filling containers of fixed capacity with documents, by a linear grouping scheme.

The plan is made from the histogram of sizes alone, which has at most
``capacity`` entries however many documents there are: large sizes are rounded
up within groups of equal cardinality, the few rounded sizes are combined to
configurations by a linear programme solved by column generation, the groups'
actual documents take the places of their rounded sizes, and what is left over
and all small documents go by best fit into the space that remains. Documents
are then looked up in the plan by size and by their rank among equal sizes;
ranks come from mergeable counts, so no size, however frequent, is gathered.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.shared import written

CAPACITY = 8192
#: Rows of one rank bucket, on average; more rows make more buckets.
BUCKET_ROWS = 500_000

Segment = tuple[int, int, int, int, int]  # size, first rank, items, first container, items a container


def _knapsack(sizes: np.ndarray, gains: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest gain that fits: gain and items a size."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, g = sizes[order], gains[order]
    for c in range(int(s[0]), capacity + 1):
        k = np.searchsorted(s, c, side="right")
        total = best[c - s[:k]] + g[:k]
        i = int(total.argmax())
        if total[i] > best[c - 1] + 1e-12:
            best[c], pick[c] = total[i], i
        else:
            best[c], pick[c] = best[c - 1], -1
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[order[pick[c]]] += 1
            c -= int(s[pick[c]])
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations of the rounded sizes and how often to use each, rounded down; the rest is left to best fit."""
    k = len(sizes)
    base = np.diag((capacity // sizes).astype(float))
    x = demand / base.diagonal()
    for _ in range(rounds):
        y = np.linalg.solve(base.T, np.ones(k))
        gain, column = _knapsack(sizes, y, capacity)
        if gain <= 1 + 1e-9:
            break
        d = np.linalg.solve(base, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        if not np.isfinite(step):
            break
        x = x - step * d
        x[out] = step
        x = np.maximum(x, 0)
        base[:, out] = column
    return [(base[:, j].astype(int), int(x[j] + 1e-9)) for j in range(k) if int(x[j] + 1e-9) > 0]


class _Space:
    """Containers by the space left in them, as runs of neighbouring container numbers."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.left: list[int] = []
        self.used = 0

    def add(self, space: int, first: int, n: int) -> None:
        if n <= 0 or space <= 0:
            return
        if not self.runs[space]:
            bisect.insort(self.left, space)
        self.runs[space].append((first, n))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """A run of the containers with the least space that still holds ``size``."""
        i = bisect.bisect_left(self.left, size)
        if i == len(self.left):
            return None
        space = self.left[i]
        first, n = self.runs[space].pop()
        if not self.runs[space]:
            del self.left[i]
        return space, first, n

    def open(self, n: int) -> int:
        self.used += n
        return self.used - n


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 32, small: float = 1 / 3) -> tuple[list[Segment], int]:
    """Where the items of each size go, and the number of containers. ``counts``: items by size, 1 to ``capacity``."""
    large = sorted((s for s in counts if s > small * capacity), reverse=True)
    runs = [(s, counts[s]) for s in large]
    total = sum(n for _, n in runs)
    segments: list[Segment] = []
    space = _Space()
    rest: list[tuple[int, int, int]] = []  # size, first rank, items not placed by configurations
    if total:
        # groups of equal cardinality, greatest first: (runs of size, first rank, items), rounded size
        each = -(-total // groups)
        made: list[list[list[int]]] = [[]]
        room = each
        for s, n in runs:
            at = 0
            while n:
                take = min(n, room)
                made[-1].append([s, at, take])
                at, n, room = at + take, n - take, room - take
                if not room:
                    made.append([])
                    room = each
        made = [g for g in made if g]
        # neighbouring groups with the same greatest size are one size for the programme
        merged: list[list[list[int]]] = []
        for g in made:
            if merged and merged[-1][0][0] == g[0][0]:
                merged[-1] += g
            else:
                merged.append(g)
        sizes = np.array([g[0][0] for g in merged])
        demand = np.array([float(sum(r[2] for r in g)) for g in merged])
        queues = [[tuple(r) for r in g][::-1] for g in merged]  # taken from the end: greatest first
        for items, times in configurations(sizes, demand, capacity):
            first = space.open(times)
            taken = [(0, times, 0)]  # offset, containers, filled
            for g in np.repeat(np.arange(len(sizes)), items):
                nxt, need = [], times
                got: list[tuple[int, int]] = []
                while need and queues[g]:
                    s, at, n = queues[g].pop()
                    use = min(n, need)
                    segments.append((s, at, use, first + times - need, 1))
                    got.append((use, s))
                    need -= use
                    if n > use:
                        queues[g].append((s, at + use, n - use))
                if need:
                    got.append((need, 0))
                i, left = 0, got[0][0]
                for off, n, filled in taken:
                    while n:
                        use = min(n, left)
                        nxt.append((off, use, filled + got[i][1]))
                        off, n, left = off + use, n - use, left - use
                        if not left and i + 1 < len(got):
                            i += 1
                            left = got[i][0]
                taken = nxt
            for off, n, filled in taken:
                space.add(capacity - filled, first + off, n)
        rest = [r for q in queues for r in q[::-1]]
    rest += [(s, 0, counts[s]) for s in sorted((s for s in counts if s <= small * capacity), reverse=True)]
    for s, at, n in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            found = space.take(s)
            if found is None:
                want = -(-n // (capacity // s))
                found = (capacity, space.open(want), want)
            left, first, containers = found
            per = left // s
            full = min(containers, n // per)
            if full:
                segments.append((s, at, full * per, first, per))
                space.add(left - per * s, first, full)
                at, n = at + full * per, n - full * per
            if full < containers:
                if 0 < n:
                    if n < per:  # the last few of this size go together into one container
                        segments.append((s, at, n, first + full, per))
                        space.add(left - n * s, first + full, 1)
                        full, at, n = full + 1, at + n, 0
                space.add(left, first + full, containers - full)
    return segments, space.used


def pieces(df: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``n_pieces``, ``tokens``: whole documents, or the parts of those longer than a container."""
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("bigint")
    own = df.select(F.col(doc_id).alias("doc_id"), size.alias("size")).withColumn("n_pieces", F.ceil(F.col("size") / capacity).cast("int"))
    own = own.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    return own.select("doc_id", "piece", "n_pieces", F.least(F.lit(capacity), F.col("size") - F.col("piece").cast("bigint") * capacity).cast("int").alias("tokens"))


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, groups: int = 32) -> DataFrame:
    """Every document assigned to containers of ``capacity`` tokens.

    A document has one token per UTF-8 byte and one end token. Columns:
    doc_id, piece (0 unless the document is longer than a container),
    n_pieces, tokens, container. Empty and null texts are documents of one
    token; a null or repeated id is packed as often as it occurs; an empty
    table gives no rows; other columns are ignored. The result is the same
    on every run for the same rows.
    """
    spark = df.sparkSession
    own = written(pieces(df, doc_id, text, capacity), "pieces")
    counts = {r["tokens"]: r["n"] for r in own.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    segments, _ = plan(counts, capacity, groups)
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    local = F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("doc_id", "piece")) - 1
    if buckets == 1:
        ranked = own.withColumn("rank", local.cast("bigint"))
    else:
        before = F.sum("n").over(Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        firsts = own.groupBy("tokens", "bucket").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(before, F.lit(0))).drop("n")
        ranked = own.withColumn("rank", local.cast("bigint")).join(firsts, ["tokens", "bucket"]).withColumn("rank", F.col("rank") + F.col("first"))
    by_size: dict[int, list] = defaultdict(list)
    for size, at, n, container, per in segments:
        by_size[size].append((at, n, container, per))
    rows = [(s, sorted(x)) for s, x in by_size.items()] or [(0, [])]
    places = spark.createDataFrame(rows, "tokens int, places array<struct<at: bigint, n: bigint, container: bigint, per: bigint>>")  # at most ``capacity`` rows
    place = F.filter("places", lambda p: (F.col("rank") >= p["at"]) & (F.col("rank") < p["at"] + p["n"]))[0]
    out = ranked.join(F.broadcast(places), "tokens", "left").withColumn("p", place)
    return out.select("doc_id", "piece", "n_pieces", "tokens", (F.col("p.container") + F.floor((F.col("rank") - F.col("p.at")) / F.col("p.per"))).cast("bigint").alias("container"))


def longer_than_one(packed: DataFrame) -> DataFrame:
    """Ids of the documents that :func:`pack` put into more than one container, each as often as it was packed."""
    copies = F.count_if(F.col("piece") == 0).cast("int")
    parts = packed.where(F.col("n_pieces") > 1).groupBy("doc_id").agg(F.min("container").alias("first"), F.max("container").alias("last"), copies.alias("copies"))
    return parts.where(F.col("first") < F.col("last")).select(F.explode(F.array_repeat("doc_id", F.col("copies"))).alias("doc_id"))
