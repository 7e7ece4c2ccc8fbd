"""Conversation trees: roots, paths, branches, and graphs of inferences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.skew import numbered
from stratalog.shared import written


def roots(nodes: DataFrame, tree: str = "tree_id") -> DataFrame:
    """How many roots each tree has; other than one is a fault."""
    return nodes.groupBy(tree).agg(F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count("*").alias("nodes"))


def leaves(nodes: DataFrame, tree: str = "tree_id") -> DataFrame:
    """The nodes that are no node's parent."""
    parents = nodes.where(F.col("parent_id").isNotNull()).select(tree, F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(parents, [tree, "node_id"], "left_anti").select(tree, "node_id")


def depths(nodes: DataFrame, tree: str = "tree_id", deepest: int | None = None) -> DataFrame:
    """Each node's ``root_id`` and ``depth`` by doubling of pointers; a node that reaches no root (a cycle, a missing parent) has null for both.

    Every round doubles the steps looked ahead, so a path of any length takes
    its logarithm in rounds. A pointer that is open after as many steps as the
    largest tree has nodes is in a cycle. ``deepest`` ends the rounds early
    for callers that know their trees; by default nothing is cut.
    """
    known = nodes.select(F.col(tree).alias("_t"), F.col("node_id").alias("_n"))
    own = nodes.select(tree, "node_id", "parent_id").join(known, (F.col(tree) == F.col("_t")) & (F.col("parent_id") == F.col("_n")), "left")
    # up: the ancestor ``steps`` above, null beyond the root; a missing parent is marked by lost
    own = own.select(tree, "node_id", F.col("_n").alias("up"), F.when(F.col("_n").isNotNull(), 1).otherwise(0).cast("bigint").alias("steps"), F.when(F.col("_n").isNull(), F.col("node_id")).alias("root_id"), (F.col("parent_id").isNotNull() & F.col("_n").isNull()).alias("lost"))
    own = written(own, "depths")
    # a path without a cycle has fewer steps than its tree has nodes
    most = own.groupBy(tree).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 if deepest is None else 2 * deepest
    reach = 1
    while reach < most:
        if own.where("up is not null").isEmpty():
            break
        other = own.select(F.col(tree).alias("_t"), F.col("node_id").alias("_n"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("root_id").alias("_root"), F.col("lost").alias("_lost"))
        step = own.join(other, (F.col(tree) == F.col("_t")) & (F.col("up") == F.col("_n")), "left")
        own = written(step.select(tree, "node_id", F.col("_up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_root", "root_id").alias("root_id"), F.coalesce(F.col("_lost"), F.col("lost")).alias("lost")), "depths")
        reach *= 2
    whole = F.col("up").isNull() & F.col("root_id").isNotNull() & ~F.col("lost")
    return own.select(tree, "node_id", F.when(whole, F.col("root_id")).alias("root_id"), F.when(whole, F.col("steps")).alias("depth"))


def integrity(nodes: DataFrame, tree: str = "tree_id") -> DataFrame:
    """Per tree: nodes, roots, nodes that reach no root, and whether it is sound (one root, all nodes reach it)."""
    apart = depths(nodes, tree).groupBy(tree).agg(F.count_if(F.col("root_id").isNull()).alias("unreachable"))
    return roots(nodes, tree).join(apart, tree).withColumn("sound", (F.col("roots") == 1) & (F.col("unreachable") == 0))


def default_children(nodes: DataFrame, tree: str = "tree_id") -> DataFrame:
    """The earliest child of each parent, and whether several share that time (which can't be decided)."""
    own = nodes.where(F.col("parent_id").isNotNull())
    first = own.groupBy(tree, "parent_id").agg(F.min("create_time").alias("first_time"), F.count("*").alias("children"))
    met = own.join(first, [tree, "parent_id"]).where(F.col("create_time").eqNullSafe(F.col("first_time")))
    return met.groupBy(tree, "parent_id", "children").agg(F.min("node_id").alias("child_id"), F.count("*").alias("tied"))


def leaf_paths(nodes: DataFrame, tree: str = "tree_id") -> DataFrame:
    """``leaf_id``, ``node_id`` and ``place`` (0 at the root): a row a node of each root-to-leaf path.

    The paths double: those known so far are repeated from the ancestor that
    many steps above, whose pointers double as well, so a path of any length
    takes its logarithm in rounds.
    """
    at = written(depths(nodes, tree).where("depth is not null"), "deep")
    own = nodes.select(tree, "node_id", F.col("parent_id").alias("up")).join(at.select(tree, "node_id", "depth"), [tree, "node_id"])
    jump = written(own.select(F.col(tree).alias("_t"), F.col("node_id").alias("_n"), "up"), "jump")
    out = written(leaves(nodes, tree).join(at, [tree, "node_id"]).select(tree, F.col("node_id").alias("leaf_id"), "node_id", F.col("depth").alias("place")), "paths")
    most, steps = at.agg(F.max("depth")).first()[0] or 0, 1
    while steps <= most:
        above = out.join(jump, (F.col(tree) == F.col("_t")) & (F.col("node_id") == F.col("_n"))).where(F.col("up").isNotNull()).select(tree, "leaf_id", F.col("up").alias("node_id"), (F.col("place") - steps).alias("place"))
        out = written(out.unionByName(above), "paths")
        other = jump.select(F.col("_t").alias("_t2"), F.col("_n").alias("_n2"), F.col("up").alias("_up2"))
        jump = written(jump.join(other, (F.col("_t") == F.col("_t2")) & (F.col("up") == F.col("_n2")), "left").select("_t", "_n", F.col("_up2").alias("up")), "jump")
        steps *= 2
    return out


def variants(nodes: DataFrame, tree: str = "tree_id") -> DataFrame:
    """The sequences of nodes that a tree's leaves stand for: branch_id, leaf_id, place, node_id; all leaves of a tree have sequences of their own."""
    paths = leaf_paths(nodes, tree)
    return paths.join(branch_ids(paths, nodes, tree), [tree, "leaf_id"]).select(tree, "branch_id", "leaf_id", "place", "node_id")


def topological(nodes: DataFrame, tree: str = "tree_id") -> DataFrame:
    """``place`` of each node in an order in which parents come before children: by depth, then by id. Nodes that reach no root have none."""
    own = depths(nodes, tree).where("depth is not null")
    return numbered(own, [tree], [F.col("depth"), F.col("node_id")], "place").select(tree, "node_id", "depth", "place")


def branch_ids(paths: DataFrame, nodes: DataFrame, tree: str = "tree_id") -> DataFrame:
    """A branch id a leaf: the tree's own id on the default path, else with a digest of the choices that aren't default."""
    forks = default_children(nodes, tree).where(F.col("children") > 1).select(tree, "parent_id", F.col("child_id").alias("usual"))
    taken = paths.join(nodes.select(tree, "node_id", "parent_id"), [tree, "node_id"]).join(forks, [tree, "parent_id"]).where(F.col("node_id") != F.col("usual"))
    odd = taken.groupBy(tree, "leaf_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(">", "parent_id", "node_id").alias("choice")))), lambda c: c["choice"]), "\n").alias("choices"))
    every = paths.select(tree, "leaf_id").distinct().join(odd, [tree, "leaf_id"], "left")
    return every.select(tree, "leaf_id", F.when(F.col("choices").isNull(), F.col(tree)).otherwise(F.concat(F.col(tree), F.lit("~branch-"), F.substring(F.sha2("choices", 256), 1, 12))).alias("branch_id"))


def evidence_spans(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """Whether each claim's evidence is the text at its place. ``claims``: claim_id, row_id, start (from 0), length, evidence."""
    own = claims.join(texts.select("row_id", "text"), "row_id", "left")
    return own.select("claim_id", F.coalesce(F.expr("substring(text, int(start) + 1, int(length)) = evidence"), F.lit(False)).alias("holds"))


def resolve(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """The round in which each node of a graph of inferences can be drawn; null for one in a cycle or with a missing source.

    ``nodes``: node_id. ``needs``: node_id, source_id.
    """
    left = written(needs.select("node_id", "source_id").distinct(), "needs")
    done = written(nodes.select("node_id").distinct().join(left, "node_id", "left_anti").withColumn("round", F.lit(0).cast("bigint")), "done")
    fresh, out, k = done, done, 0
    while not fresh.isEmpty():
        k += 1
        before = left
        left = written(left.join(fresh.select(F.col("node_id").alias("source_id")), "source_id", "left_anti").select("node_id", "source_id"), "needs")
        ready = before.select("node_id").distinct().join(left, "node_id", "left_anti")
        fresh = written(ready.join(nodes.select("node_id"), "node_id", "left_semi").withColumn("round", F.lit(k).cast("bigint")), "done")
        out = out.unionByName(fresh)
        if k % 100 == 0:  # else the plan grows with the rounds
            out = written(out, "done")
    return nodes.select("node_id").distinct().join(out, "node_id", "left")
