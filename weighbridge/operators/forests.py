"""Many trees at once, as tables: what is wrong with them, and which nodes can be reached or lie on a cycle.

nodes(tree, node, kind, criterion, action), edges(tree, node, branch, target), states(tree, node, state, branch) and
roots(tree, root). Rules are anti-joins and counts. Reachability is a frontier that all trees move in step; nodes on cycles
are strongly connected components, found by trimming and colouring. Every round is a join of a written table with the edges,
so nothing but a count of what is new comes back, and no task holds a tree. Tables are joined by sorting: as files, ids of trees
and nodes are packed so well that a table of millions of rows looks small enough to be broadcast, which the driver has to hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.sources import shared

KINDS = ("criterion", "terminal", "path_end", "configuration_gap")
KEY = ["tree", "node"]


def _written(df: DataFrame, label: str) -> DataFrame:
    return shared.written(df, label).hint("merge")


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, node) of all that can be reached from the roots, these included, over edges(tree, node, target)."""
    steps = edges.select("tree", "node", "target").distinct()
    seen = front = _written(roots.select("tree", F.col("root").alias("node")).distinct(), "reached")
    while not front.isEmpty():
        on = front.join(steps, KEY).select("tree", F.col("target").alias("node")).distinct()
        front = _written(on.join(seen.hint("merge"), KEY, "left_anti"), "reached")
        seen = seen.unionByName(front)
    return seen.hint("merge")


def _trimmed(core: DataFrame) -> DataFrame:
    """Edges between nodes that have a way in and a way out, again and again until that holds for all."""
    core, left = _written(core, "core"), None
    while (now := core.count()) != left:
        left = now
        into = core.select("tree", F.col("target").alias("node")).distinct()
        out = core.select("tree", F.col("node").alias("target")).distinct()
        core = _written(core.join(into, KEY, "left_semi").join(out, ["tree", "target"], "left_semi"), "core")
    return core


def _coloured(core: DataFrame) -> DataFrame:
    """(tree, node, colour): the greatest node from which each node can be reached."""
    colour = _written(core.select("tree", "node", F.col("node").alias("colour")).distinct(), "colours")
    while True:
        pushed = colour.join(core, KEY).groupBy("tree", F.col("target").alias("node")).agg(F.max("colour").alias("more"))
        now = colour.join(pushed, KEY, "left").select(*KEY, F.greatest("colour", "more").alias("colour"), (F.col("more") > F.col("colour")).alias("moved"))
        now = _written(now, "colours")
        colour = now.drop("moved")
        if now.where("moved").isEmpty():
            return colour


def on_cycles(edges: DataFrame) -> DataFrame:
    """(tree, node) of the nodes on a cycle of edges(tree, node, target). After trimming, the node that gives a colour its
    name reaches all of that colour; those of it that reach back to it are its component, which is taken out."""
    core = _trimmed(edges.select("tree", "node", "target").distinct())
    out = edges.select(*KEY).limit(0)
    while not core.isEmpty():
        colour = _coloured(core)
        back = core.join(colour, KEY).join(colour.select("tree", F.col("node").alias("target"), F.col("colour").alias("of")), ["tree", "target"]).where(F.col("colour") == F.col("of"))
        back = _written(back.select("tree", F.col("node").alias("target"), F.col("target").alias("node"), "colour"), "core")
        own = reached(back, colour.where(F.col("node") == F.col("colour")).select("tree", F.col("node").alias("root")))
        own = _written(own.join(colour, KEY), "component")
        other = own.select("tree", F.col("node").alias("target"), F.col("colour").alias("of"))
        loops = core.join(own, KEY).join(other, ["tree", "target"]).where(F.col("colour") == F.col("of"))
        out = out.unionByName(loops.select(*KEY).distinct())
        gone = own.select(*KEY)
        core = _trimmed(core.join(gone, KEY, "left_anti").join(gone.withColumnRenamed("node", "target"), ["tree", "target"], "left_anti"))
    return out.distinct()


def problems(nodes: DataFrame, edges: DataFrame, states: DataFrame, roots: DataFrame, required: Sequence[str]) -> DataFrame:
    """(tree, node, problem), a row each; a criterion that several nodes ask for is a warning, all else an error."""
    nodes, edges, states, roots = (_written(x, "trees") for x in (nodes, edges, states, roots))
    once = nodes.dropDuplicates(KEY)
    asks = once.where("kind = 'criterion'").select(*KEY)
    of = lambda rows, what: rows.select("tree", F.col("node").cast("string").alias("node"), F.lit(what).alias("problem")).distinct()
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    known = once.select("tree", F.col("node").alias("target"))
    named = edges.select("tree", "node", "branch").distinct()
    fine = edges.join(known, ["tree", "target"], "left_semi").join(asks, KEY, "left_semi")
    there = roots.join(once.select("tree", F.col("node").alias("root")), ["tree", "root"], "left_semi")
    every = asks.crossJoin(F.broadcast(nodes.sparkSession.createDataFrame([(s,) for s in required], "state string")))  # as many rows as there are states
    mapped = states.join(asks, KEY, "left_semi")
    seen = reached(fine, there)
    found = [
        of(nodes.groupBy(*KEY).count().where("count > 1"), "duplicate node"),
        of(once.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))), "unknown kind"),
        of(once.where(F.col("kind").eqNullSafe("terminal") & empty("action")), "terminal without an action"),
        of(once.where(F.col("kind").eqNullSafe("criterion") & empty("criterion")), "criterion without a name"),
        of(once.where("kind in ('terminal', 'path_end', 'configuration_gap')").join(edges.select(*KEY), KEY, "left_semi"), "branches of an end"),
        of(roots.join(there, ["tree", "root"], "left_anti").select("tree", F.col("root").alias("node")), "missing root"),
        of(asks.join(named.groupBy(*KEY).count(), KEY, "left").where("coalesce(count, 0) < 2"), "fewer than two branches"),
        of(edges.join(asks, KEY, "left_semi").join(known, ["tree", "target"], "left_anti"), "missing target"),
        of(every.join(states.select(*KEY, "state").distinct(), [*KEY, "state"], "left_anti"), "missing state"),
        of(mapped.where(~F.col("state").isin(*required)), "unknown state"),
        of(mapped.join(named, [*KEY, "branch"], "left_anti"), "state of an unknown branch"),
        of(mapped.groupBy(*KEY, "state", "branch").count().where("count > 1"), "branch twice in a state"),
        of(once.where("kind = 'criterion'").join(once.where("kind = 'criterion'").groupBy("tree", "criterion").count().where("count > 1"), ["tree", "criterion"], "left_semi"), "criterion of several nodes"),
        of(once.join(there.select("tree").distinct(), "tree", "left_semi").join(seen, KEY, "left_anti"), "out of reach"),
        of(on_cycles(fine.join(seen, KEY, "left_semi")), "on a cycle"),
    ]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out
