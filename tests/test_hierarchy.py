import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import hierarchy as H

DDL = "tree string, child string, parent string"


def brute(links):
    up = {(t, c): p for t, c, p in links}
    out = {}
    for t, c in up:
        seen, at = [], c
        while (t, at) in up and at not in seen:
            seen.append(at)
            at = up[t, at]
        out[t, c] = (min(seen[seen.index(at):]), True) if at in seen else (at, False)
    return out


def shapes():
    r = random.Random(7)
    yield "chain", [("A", f"k:{i:04}", f"k:{i + 1:04}") for i in range(300)]
    yield "scattered chain", [("A", f"{(i * 7919) % 1009}", f"{((i + 1) * 7919) % 1009}") for i in range(700)]
    yield "ring with tails", [("A", f"{(i * 31) % 101}", f"{((i + 1) * 31) % 101}") for i in range(101)] + [("A", f"t{i}", f"{i}") for i in range(50)] + [("A", "self", "self"), ("A", "s2", "self")]
    yield "random", [(t, str(i), str(r.randrange(400))) for t in "AB" for i in range(400) if r.random() < 0.9]
    yield "star", [("A", f"c{i}", "hub") for i in range(500)] + [("A", "hub", "top")]


@pytest.mark.parametrize("name,links", list(shapes()))
@pytest.mark.parametrize("task", [20, 10_000])
def test_roots(spark, name, links, task):
    got = {(r.tree, r.child): (r.root, r.cyclic) for r in H.roots(spark.createDataFrame(links, DDL), task).collect()}
    assert got == brute(links)


@pytest.mark.parametrize("task", [30, 10_000])
def test_hierarchy_paths_and_descendants(spark, task):
    links = list(shapes())[3][1]
    up, roots = {(t, c): p for t, c, p in links}, brute(links)
    h = H.hierarchy(spark.createDataFrame(links, DDL), task)
    rows = h.collect()
    tops = {(t, r) for (t, _), (r, _) in roots.items()}
    assert {(r.tree, r.node) for r in rows} == set(up) | tops and len(rows) == len(set(up) | tops)
    for r in rows:
        assert r.path[0] == r.root and r.path[-1] == r.node and r.depth == len(r.path) - 1
        assert all(up[r.tree, b] == a for a, b in zip(r.path, r.path[1:]))
        ring, at = [], r.node
        while (r.tree, at) in up and at not in ring:
            ring.append(at)
            at = up[r.tree, at]
        assert r.in_cycle == (bool(ring) and at == r.node)
        assert r.cyclic == (at in ring or roots.get((r.tree, r.root), (0, False))[1])
    pairs = {(r.tree, r.node, r.descendant) for r in H.descendants(h).collect()}
    assert pairs == {(r.tree, a, r.node) for r in rows for a in r.path[:-1]}


def test_latest_parent_nulls_ties_and_empty(spark):
    rows = [("A", "c", "p1", 1, 1), ("A", "c", "p2", 2, 1), ("A", "c", "p3", 2, 3), ("A", "d", None, 9, 9), ("A", None, "x", 1, 1), ("A", "e", "null", 1, 1), (None, "c", "p", 9, 9), ("A", "f", "p", None, None), ("A", "", "p", 1, 1)]
    df = spark.createDataFrame(rows, "tree string, child string, parent string, t long, n long").withColumn("path", F.lit("clash"))
    got = H.latest_parent(df, [F.col("t"), F.col("n")], F.col("tree"), F.col("child"), F.col("parent"))
    assert {tuple(r) for r in got.collect()} == {("A", "c", "p3"), ("A", "f", "p")}
    assert H.hierarchy(got.where("false")).count() == 0
