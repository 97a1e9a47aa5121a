"""Parent-child links to full hierarchies.

Method: contract the parent chains that lie within one partition to *fragment
exits* (the first ancestor that is no child in the partition), solve the
smaller quotient forest of the exits in the same way, and expand the fragments
by the solved exits. Cycles within a partition are named during contraction;
cycles across partitions show up as cycles of a quotient.

Partitions are ranges of (tree, locality, child), not hashes, so that no tree,
however large, must fit one task, and that chains mostly stay within one.
Where ranges do not shorten the chains (random parents), the quotient is solved
by pointer doubling, which ends after log2(rows) rounds whatever the shape.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import names_something
from loomgraph.session import materialize, shuffle_partitions

#: Rows one task contracts, and the rows of a quotient that is left to one task.
ROWS_PER_TASK, LAST = 150_000, 1_000

_ARROW = pa.schema([("tree", pa.string()), ("child", pa.string()), ("parent", pa.string()), ("root", pa.string()), ("cyclic", pa.bool_()), ("low", pa.string()), ("path", pa.list_(pa.string()))])
_DDL = "tree string, child string, parent string, root string, cyclic boolean, low string, path array<string>"


def latest_parent(edges: DataFrame, order: list[Column], tree: Column, child: Column, parent: Column) -> DataFrame:
    """``(tree, child, parent)`` with one parent a child: the row greatest by ``order``.

    Rows with an end that names nothing, or without a tree, are left out.
    Aggregated before the shuffle; a child with very many rows is no hot task.
    """
    rows = edges.select(tree.alias("tree"), child.alias("child"), parent.alias("parent"), F.struct(*order, parent).alias("_at"))
    rows = rows.where(F.col("tree").isNotNull() & names_something(F.col("child")) & names_something(F.col("parent")))
    return rows.groupBy("tree", "child").agg(F.max_by("parent", "_at").alias("parent"))


def locality(child: Column) -> Column:
    """The part of an id after its kind (``method:a.b.C.m`` -> ``a.b.C.m``): members sort next to their owners."""
    return F.regexp_replace(child, "^[^:]*:", "")


def _contract(paths: bool, closed: bool):
    """Contracts the chains of a partition. ``closed``: the partition is the whole quotient, exits are roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: dict[tuple[str, str], tuple] = {}
        for b in batches:
            for t, c, p, r, y, lo, pa_ in zip(*(b.column(n).to_pylist() for n in _ARROW.names)):
                links[t, c] = (p, r, y, lo, pa_)
        done: dict[tuple[str, str], tuple] = {}  # -> parent, root, cyclic, low, path
        for start in links:
            if start in done:
                continue
            tree, trail, on = start[0], [], {}
            at = start
            while at in links and at not in done and at not in on:
                on[at] = len(trail)
                trail.append(at)
                if links[at][0] is None:  # solved before
                    break
                at = (tree, links[at][0])
            if at in on and links[at][0] is not None:  # a cycle within the partition
                ring = trail[on[at]:]
                low = min(links[x][3] for x in ring)
                for x in ring:
                    done[x] = (None, low, True, low, None)
                trail = trail[: on[at]]
                end = (None, low, True, None, None)
            elif at in done:
                end = done[at]
            elif at in links:
                trail.pop()
                end = done[at] = (None, links[at][1], links[at][2], links[at][3], links[at][4])
            else:
                end = (None, at[1], False, None, [at[1]] if paths else None) if closed else (at[1], None, False, None, [] if paths else None)
            for x in reversed(trail):
                own, low = links[x], links[x][3]
                if end[3] is not None and not end[2]:
                    low = min(low, end[3])
                path = end[4] + own[4] if paths and end[4] is not None else None
                end = done[x] = (end[0], end[1], end[2], low, path)
        if not done:
            return
        keys, values = list(done), list(done.values())
        for i in range(0, len(keys), 20_000):
            k, v = keys[i : i + 20_000], values[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[x[0] for x in k], [x[1] for x in k], *([y[j] for y in v] for j in range(5))], _ARROW)], schema=_ARROW)

    return run


def _double(links: DataFrame, rows: int, paths: bool) -> DataFrame:
    """Pointer doubling: each round halves every chain. Nodes left after log2(rows) rounds run into cycles."""
    cols = ["tree", "child", "parent", "root", "cyclic", "low", "path"]
    ends = links.select("tree", F.col("parent").alias("child")).where("child IS NOT NULL").distinct()
    tips = ends.join(links.select("tree", "child"), ["tree", "child"], "left_anti")
    tip = tips.select("tree", "child", F.lit(None).cast("string").alias("parent"), F.col("child").alias("root"), F.lit(False).alias("cyclic"), F.lit(None).cast("string").alias("low"), F.array("child").alias("path") if paths else F.lit(None).cast("array<string>").alias("path"))
    at = materialize(links.select(cols).unionByName(tip), "double")
    for _ in range(math.ceil(math.log2(max(rows, 2))) + 2):
        if not at.where("parent IS NOT NULL").take(1):
            break
        up = at.select("tree", F.col("child").alias("parent"), F.col("parent").alias("p2"), F.col("root").alias("r2"), F.col("cyclic").alias("y2"), F.col("low").alias("l2"), F.col("path").alias("s2"))
        at = materialize(
            at.join(up, ["tree", "parent"], "left").select(
                "tree", "child", F.when(F.col("root").isNull(), F.col("p2")).alias("parent"), F.coalesce("root", "r2").alias("root"), (F.col("cyclic") | F.coalesce("y2", F.lit(False))).alias("cyclic"),
                F.least("low", "l2").alias("low"), F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat("s2", "path")).alias("path") if paths else F.lit(None).cast("array<string>").alias("path"),
            ),
            "double",
        )
    # a pointer left over stands on the cycle, and the least id on the way from there is the cycle's
    name = at.where("parent IS NOT NULL").select("tree", F.col("child").alias("parent"), F.col("low").alias("name"))
    at = at.join(name, ["tree", "parent"], "left")
    out = at.select("tree", "child", F.lit(None).cast("string").alias("parent"), F.coalesce("root", "name").alias("root"), (F.col("cyclic") | F.col("name").isNotNull()).alias("cyclic"), "low", "path")
    return out.join(tips, ["tree", "child"], "left_anti")


def _solve(links: DataFrame, rows: int, paths: bool, rows_per_task: int, depth: int = 0) -> DataFrame:
    if rows <= min(LAST, rows_per_task):
        return links.coalesce(1).mapInArrow(_contract(paths, True), _DDL)
    spark = links.sparkSession
    parts = max(2, math.ceil(rows / rows_per_task)) if depth else max(2, math.ceil(rows / rows_per_task), shuffle_partitions(spark))
    cut = materialize(links.repartitionByRange(parts, "tree", locality(F.col("child")), "child").mapInArrow(_contract(paths, False), _DDL), "fragments")
    exits = cut.where("parent IS NOT NULL").select("tree", F.col("parent").alias("child")).distinct()
    quotient = materialize(cut.join(exits, ["tree", "child"], "left_semi"), "quotient")
    left = quotient.count()
    if not left:
        solved = quotient
    elif left > 0.6 * rows:
        solved = _double(quotient, left, paths)
    else:
        solved = _solve(quotient, left, paths, rows_per_task, depth + 1)
    up = solved.select("tree", F.col("child").alias("parent"), F.col("root").alias("r2"), F.col("cyclic").alias("y2"), F.col("path").alias("s2"))
    path = F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.coalesce("s2", F.array("parent")), "path")) if paths else F.lit(None).cast("array<string>")
    return cut.join(up, ["tree", "parent"], "left").select("tree", "child", F.lit(None).cast("string").alias("parent"), F.coalesce("root", "r2", "parent").alias("root"), (F.col("cyclic") | F.coalesce("y2", F.lit(False))).alias("cyclic"), "low", path.alias("path"))


def roots(parents: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(tree, child, root, cyclic)`` for each child of ``(tree, child, parent)``.

    One parent a child (see ``latest_parent``); other columns are ignored. Where
    the chain never ends, ``root`` is the smallest id by code point of the cycle
    it runs into and ``cyclic`` is true. No rows give no rows.
    """
    links = materialize(parents.select("tree", "child", "parent", F.lit(None).cast("string").alias("root"), F.lit(False).alias("cyclic"), F.col("child").alias("low"), F.lit(None).cast("array<string>").alias("path")), "links")
    return _solve(links, links.count(), False, rows_per_task).select("tree", "child", "root", "cyclic")


def hierarchy(parents: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(tree, node, root, depth, path, cyclic, in_cycle)`` for each child and each root.

    ``path`` is the array of ids from the root to the node. A component with a
    cycle becomes a tree by cutting the one link above the cycle's smallest id,
    which is its root; ``cyclic`` marks all its nodes, ``in_cycle`` those on the
    cycle itself. A component without cycle keeps its root at depth 0.
    """
    flat = parents.select("tree", "child", "parent")
    named = materialize(roots(flat, rows_per_task), "roots")
    ring = named.where(F.col("cyclic") & (F.col("child") == F.col("root"))).select("tree", "child")
    forest = flat.join(ring, ["tree", "child"], "left_anti")
    links = materialize(forest.select("tree", "child", "parent", F.lit(None).cast("string").alias("root"), F.lit(False).alias("cyclic"), F.col("child").alias("low"), F.array("child").alias("path")), "links")
    paths = materialize(_solve(links, links.count(), True, rows_per_task).select("tree", F.col("child").alias("node"), "root", "path"), "paths")
    above = flat.join(ring, ["tree", "child"], "left_semi").select("tree", F.col("child").alias("root"), F.col("parent").alias("node"))
    on = above.join(paths, ["tree", "root", "node"]).select("tree", F.explode("path").alias("node"))
    on = on.unionByName(above.select("tree", F.col("root").alias("node"))).distinct().withColumn("in_cycle", F.lit(True))
    tops = paths.select("tree", F.col("root").alias("node"), "root", F.array("root").alias("path")).unionByName(ring.select("tree", F.col("child").alias("node"), F.col("child").alias("root"), F.array("child").alias("path"))).dropDuplicates(["tree", "node"])
    cyclic = named.where("cyclic").select("tree", "root").distinct().withColumn("cyclic", F.lit(True))
    every = paths.unionByName(tops).join(cyclic, ["tree", "root"], "left").join(on, ["tree", "node"], "left")
    return every.select("tree", "node", "root", (F.size("path") - 1).cast("bigint").alias("depth"), "path", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def descendants(nodes: DataFrame) -> DataFrame:
    """``(tree, node, descendant, distance)`` from the result of ``hierarchy``; as many rows as paths have links."""
    up = nodes.select("tree", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
    return up.where("at < depth").select("tree", "node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
