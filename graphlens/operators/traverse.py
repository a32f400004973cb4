"""Bounded traversals: impact (breadth first) and flow (depth first).

Both follow the order of a sequential walk, written as joins and windows.  A
level's frontier is cut off with a checkpoint in the shared folder, so that the
plan does not grow with the hops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, cut_counting


def bounded_bfs(edges: DataFrame, root: str, hops: int = 3, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) reached from ``root`` in at most ``hops`` steps.

    ``edges``: src, dst, seq (of any type that has an order).  Edges come out as
    they are stored, nodes with their ``depth``.  A neighbour that lies on the
    walk's tree path to a node is skipped, any other edge is reported even if it
    was seen; a node's parent is its first discoverer in the order of the
    frontier and of ``seq``, equal ones by id.
    """
    e, n = _levels(_adjacency(edges, (not reverse,)), root, hops)
    return e.select("src", "dst").distinct(), n.select("id", "depth")


def impact(edges: DataFrame, root: str, hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """Both directions, walked side by side: (edges caller to callee, nodes)."""
    e, n = _levels(_adjacency(edges, (False, True)), root, hops)
    return e.select("src", "dst").distinct(), n.select("id").distinct()


def _adjacency(edges: DataFrame, directions: tuple[bool, ...]) -> DataFrame:
    """``onward, node, m, seq``, written once: what every level of a walk is joined with."""
    sides = [edges.select(F.lit(on).alias("onward"), F.col("src" if on else "dst").alias("node"), F.col("dst" if on else "src").alias("m"), "seq") for on in directions]
    return cut(sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]))


def _levels(adj: DataFrame, root: str, hops: int) -> tuple[DataFrame, DataFrame]:
    """Breadth-first levels in all directions of ``adj``: (src, dst, ...), (id, onward, depth).

    Each level is one join and one folder: its steps, marked with whether they
    found their neighbour first.  Frontier and nodes are read from those.
    """
    spark = adj.sparkSession
    kind = adj.schema["seq"].dataType.simpleString()
    onward = adj.select("onward").distinct()
    # ``key``: the ``seq`` of every step to a node.  Keys of one level are equally long, and their
    # order is that of a sequential walk, so that no level has to be numbered.
    frontier = onward.select("onward", F.lit(root).alias("node"), F.array().cast(f"array<{kind}>").alias("key"), F.array(F.lit(root)).alias("path"))
    found = old = None
    for depth in range(1, hops + 1):
        step = frontier.join(adj, ["onward", "node"]).where((F.col("m") != root) & ~F.array_contains("path", F.col("m")))
        if old is not None:
            step = step.join(old, ["onward", "m"], "left")
        else:
            step = step.withColumn("known", F.lit(None).cast("boolean"))
        nth = F.row_number().over(Window.partitionBy("onward", "m").orderBy("key", "seq", "node"))
        step, met = cut_counting(step.withColumn("first", F.col("known").isNull() & (nth == 1)).drop("known").withColumn("depth", F.lit(depth)), F.col("first"))
        found = step if found is None else found.unionByName(step)
        frontier = step.where("first").select("onward", F.col("m").alias("node"), F.concat("key", F.array("seq")).alias("key"), F.concat("path", F.array("m")).alias("path"))
        if not met:
            break
        old = found.where("first").select("onward", "m", F.lit(True).alias("known"))
    start = spark.createDataFrame([(root, 0)], "id string, depth int")
    if found is None:
        return adj.limit(0).select(F.col("node").alias("src"), F.col("m").alias("dst")), start
    on = F.col("onward")
    edges = found.select(F.when(on, F.col("node")).otherwise(F.col("m")).alias("src"), F.when(on, F.col("m")).otherwise(F.col("node")).alias("dst"))
    return edges, start.unionByName(found.where("first").select(F.col("m").alias("id"), "depth"))


def shortest_path(edges: DataFrame, start: str, root: str) -> DataFrame:
    """The walk from ``start`` along first successors to ``root``: ``step, id``.

    The first successor of a node is the one with the least ``seq``; the walk
    ends at the root, at a node without one, or when it meets itself.  Jumps over
    1, 2, 4, ... steps find it whole in as many rounds as its length has digits.
    """
    spark = edges.sparkSession
    first = edges.groupBy("src").agg(F.min(F.struct("seq", "dst")).alias("s")).select(F.col("src").alias("id"), F.col("s.dst").alias("next"))
    jump = cut(first.where((F.col("id") != root) & F.col("next").isNotNull()))
    walk = spark.createDataFrame([(0, start)], "step int, id string")
    far = 1
    while True:
        ahead = walk.join(jump, "id").select((F.col("step") + far).alias("step"), F.col("next").alias("id"))
        new, more = cut_counting(ahead)
        if not more:
            return walk
        walk = cut(walk.unionByName(new))
        met = walk.groupBy("id").agg(F.min("step").alias("step"))
        again = walk.join(met, ["step", "id"], "left_anti").agg(F.min("step")).first()[0]
        if again is not None:
            return walk.where(F.col("step") < again)
        jump = cut(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("then")), "next").select("id", F.col("then").alias("next")))
        far *= 2


def flow(merged: DataFrame, atoms: DataFrame, root: str, depth: int = 3, external: str = "near") -> dict[str, DataFrame]:
    """Forward calls from ``root`` with order and cycles.

    ``merged``: src, dst (one row a pair).  ``atoms``: id, kind.  ``external``:
    near (externals called by the root only), always or never.  Returns
    ``edges`` (src, dst, label: call, recursive or cycle), ``walks`` (one row a
    node each time it is expanded: node, level), ``nodes`` and ``cycle``.

    Callees are followed in the order of their ids, never twice on one path; of
    several findings of a pair the first in depth-first order counts.  A node at
    the depth limit that calls back onto its path gets a dotted edge there.
    """
    spark = merged.sparkSession
    known = atoms.select(F.col("id").alias("dst"), (F.col("kind") == "extern").alias("ext"))
    adj = merged.select("src", "dst").distinct().join(known, "dst")
    at = spark.createDataFrame([(root, [root], 0)], "node string, path array<string>, level int")
    drawn = limits = None
    walks = at.select("node", "level")
    for level in range(1, max(depth, 1) + 1):
        step = at.join(adj.withColumnRenamed("src", "node").withColumnRenamed("dst", "m"), "node")
        if external == "never":
            step = step.where("not ext")
        elif external == "near" and level > 1:
            step = step.where("not ext")
        step = cut(step.withColumn("back", F.array_contains("path", F.col("m"))))
        rows = step.select(F.col("node").alias("src"), F.col("m").alias("dst"), F.when(F.col("back"), "recursive").otherwise("call").alias("label"), F.concat("path", F.array("m")).alias("key"), "path", "ext")
        drawn = rows if drawn is None else drawn.unionByName(rows)
        new = step.where("not back and not ext").select(F.col("m").alias("node"), F.concat("path", F.array("m")).alias("path"), F.lit(level).alias("level"))
        if level < max(depth, 1):
            at = cut(new)
            walks = walks.unionByName(at.select("node", "level"))
            if at.isEmpty():
                break
        else:
            back = new.join(merged.select(F.col("src").alias("node"), F.col("dst").alias("m")).distinct(), "node").where(F.array_contains("path", F.col("m")))
            limits = back.groupBy("node", "path").agg(F.min("m").alias("m")).select(F.col("node").alias("src"), F.col("m").alias("dst"), F.lit("cycle").alias("label"), F.col("path").alias("key"), "path", F.lit(False).alias("ext"))
    both = drawn.withColumn("late", F.lit(0))
    if limits is not None:
        both = both.unionByName(limits.withColumn("late", F.lit(1)))
    first = Window.partitionBy("src", "dst").orderBy("key", "late")
    edges = both.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("src", "dst", "label")
    cycle = drawn.where("label = 'recursive'").select(F.explode(F.concat("path", F.array("dst"))).alias("id")).distinct()
    called = drawn.where("label = 'call'").select(F.col("dst").alias("id"))
    nodes = called.unionByName(spark.createDataFrame([(root,)], "id string")).distinct()
    return {"edges": edges, "walks": walks, "nodes": nodes, "cycle": cycle}
