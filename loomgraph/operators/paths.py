"""Variable-length expansion, shortest paths and call chains over edges.

Hops are unrolled joins on (src); where only the reached nodes count, a hop is
reduced to distinct (start, node) first, so that walks do not multiply; where
walks count, they are carried as a number, not as rows. Paths are carried only
by the two operators that return them, and repeat no node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.session import materialize


def _edges(graph: Graph, types: list[str] | None, sure: bool = False) -> DataFrame:
    e = graph.edges
    if types:
        e = e.where(F.col("type").isin(types))
    if sure:
        e = e.where(F.col("confidence").isNull() | (F.col("confidence") >= 0.9))
    return e.select("src", "dst").distinct()


def expand(graph: Graph, types: list[str] | None, hi: int, lo: int = 1, starts: DataFrame | None = None, backwards: bool = False) -> DataFrame:
    """``(start, node, distance)``: nodes at the end of a walk of lo..hi edges, each distance once.

    ``starts`` (id) bounds where walks begin; without it they begin everywhere.
    ``lo`` of 0 has the start itself at distance 0.
    """
    e = _edges(graph, types)
    if backwards:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    first = e if starts is None else e.join(starts.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    at = first.select(F.col("src").alias("start"), F.col("dst").alias("node"))
    out = None
    if lo == 0:
        zero = starts.select("id") if starts is not None else graph.nodes.select("id")
        out = zero.distinct().select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance"))
    for d in range(1, hi + 1):
        if d > 1:
            at = at.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        if d >= lo:
            part = at.select("start", "node", F.lit(d).alias("distance"))
            out = part if out is None else out.unionByName(part)
    return out


def walks_to_roots(graph: Graph, types: list[str], hi: int) -> DataFrame:
    """``(start, root, depth, walks)``: walks of up to ``hi`` edges to nodes without a further edge, counted with the edges' multiplicity."""
    e = graph.edges.where(F.col("type").isin(types)).groupBy("src", "dst").agg(F.count("*").alias("m"))
    inner = e.select(F.col("src").alias("root")).distinct()
    at, out = e.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.col("m").alias("walks")), None
    for d in range(1, hi + 1):
        if d > 1:
            at = at.join(e, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.sum(F.col("walks") * F.col("m")).alias("walks"))
        part = at.select("start", F.col("node").alias("root"), F.lit(d).alias("depth"), "walks")
        out = part if out is None else out.unionByName(part)
    return out.join(inner, "root", "left_anti").select("start", "root", "depth", "walks")


def shortest_paths(graph: Graph, sources: DataFrame, targets: DataFrame, max_depth: int = 6, types: list[str] | None = None) -> DataFrame:
    """``(source, target, path, length)``: for each pair that is connected within max_depth one shortest directed path, the first by its ids.

    Level by level from all sources; a (source, node) met before is not expanded
    again, and a target reached goes on as any node does.
    """
    e = _edges(graph, types)
    at = materialize(sources.select(F.col("id").alias("source")).distinct().select("source", F.col("source").alias("node"), F.array("source").alias("path")), "frontier")
    seen, found = at.select("source", "node"), None
    goal = targets.select(F.col("id").alias("node")).distinct()
    for d in range(1, max_depth + 1):
        step = at.join(e, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen, ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min("path").alias("path"))
        at = materialize(step, "frontier")
        part = at.join(goal, "node", "left_semi").select("source", F.col("node").alias("target"), "path", F.lit(d).alias("length"))
        found = part if found is None else found.unionByName(part)
        if not at.take(1):
            break
        seen = seen.unionByName(at.select("source", "node"))
    return found


def call_chains(graph: Graph, starts: DataFrame, ends: DataFrame, max_depth: int = 8, per_pair: int = 10) -> DataFrame:
    """``(start, end, path, depth)``: of each pair the ``per_pair`` shortest chains of sure calls that repeat no node, by depth and ids.

    Only nodes from which an end is still in reach are expanded.
    """
    e = _edges(graph, ["CALLS"], sure=True)
    reach = ends.select(F.col("id").alias("node")).distinct().withColumn("left", F.lit(0))
    near, ring = reach, reach
    for d in range(1, max_depth):
        ring = materialize(ring.join(e, F.col("node") == F.col("dst")).select(F.col("src").alias("node")).distinct().join(near.select("node"), "node", "left_anti").withColumn("left", F.lit(d)), "ring")
        if not ring.take(1):
            break
        near = near.unionByName(ring)
    near = materialize(near, "reach")
    at = starts.select(F.col("id").alias("start")).distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    out = None
    for d in range(1, max_depth + 1):
        ok = near.where(F.col("left") <= max_depth - d).select(F.col("node").alias("dst"))
        at = at.join(e.join(ok, "dst", "left_semi"), F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        part = at.join(ends.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("start", F.col("node").alias("end"), "path", F.lit(d).alias("depth"))
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("start", "end").orderBy("depth", "path"))
    return out.withColumn("_rank", rank).where(F.col("_rank") <= per_pair).drop("_rank")
