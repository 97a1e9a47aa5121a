"""Sections of the tools against SQL written apart, on a graph that has rows for each of them, and the answers of some by hand."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_graph import got, make

from loomgraph import graph as G
from loomgraph.functions.dialect import duck_sql
from loomgraph.operators import registry, tools
from loomgraph.plans import repos, tool_sql

EMPTY_IN_THE_TABLES = """get_module_interactions__outgoing get_module_interactions__incoming get_design_patterns__factory get_design_patterns__strategy get_domain_model__modules get_domain_model__entities
get_domain_model__implementors get_route_map__exports get_hook_usage_graph impact_analysis__overrides get_route_component_map get_state_ownership_map__consumers get_unused_code__classes get_layer_classification__annotation get_design_patterns__observer""".split()


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(11)
    words = ["Order", "Listener", "Query", "Store", "api", "client", "page", "UserModel", "CartDto", "Event", "Secured", "RestController", "Handler", "Util", "x.schema", "auth.models", "Observer", "app", "route", "main"]
    labels = ["Package", "Class", "Interface", "Method", "Function", "Field", "Module", "Component", "Hook", "AnnotationType", "ArrowFunction"]
    types = ["CONTAINS", "CALLS", "EXTENDS", "IMPLEMENTS", "OF_TYPE", "RETURNS", "HAS_ANNOTATION", "EXPORTS", "IMPORTS", "RENDERS", "USES_HOOK", "OVERRIDES"]
    nodes = []
    for i in range(70):
        label, name = labels[i % 11], r.choice(words) + r.choice(["", "", str(i % 7)])
        if label in ("Class", "Module"):
            name = words[7 + i // 11] if label == "Class" else words[14 + i // 11 % 6]
        nodes.append((f"n{i}", label, name, f"p{i % 9}.{name}{i % 40}", "r", r.choice([None, "src/app/a.tsx", "lib/b.ts"]), "java", r.choice(["public", "protected", "private", None]), i, None, None, None, r.random() < 0.1))
    nodes += [(f"free{i}", "Class", f"Free{i}", f"p.Free{i}", "r", None, "java", None, i, None, None, None, False) for i in range(2)]
    edges = [(i, f"n{r.randrange(70)}", f"n{r.randrange(70)}", r.choice(types), i % 50, r.choice([None, 0.5, 0.95])) for i in range(9000)]
    n = "id string, label string, name string, qn string, repo string, path string, language string, visibility string, line long, end_line long, statement_type string, code string, external boolean"
    return G.connected(spark.createDataFrame(nodes, n), spark.createDataFrame(edges, "rel_id long, src string, dst string, type string, line long, confidence double")), nodes, edges


@pytest.mark.parametrize("name", EMPTY_IN_THE_TABLES)
def test_sections_have_the_rows_of_sql_written_apart(graph, name):
    g, nodes, edges = graph
    con = duckdb.connect()
    n = pd.DataFrame(nodes, columns=g.nodes.columns)  # noqa: F841
    e = pd.DataFrame(edges, columns=["rel_id", "src", "dst", "type", "line", "confidence"])  # noqa: F841
    want = con.sql(duck_sql(tool_sql.SQL[name].format(n="n", e="e", t="t")))
    df = tools.call(g, name)
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    rows = lambda x: sorted((tuple(map(str, r)) for r in x), key=str)
    have = rows(df.select(*cols).collect())
    assert have and have == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_patterns_by_hand(spark):
    nodes = [("F", "Class"), ("F.make", "Method"), ("I", "Interface"), ("A", "Class"), ("B", "Class"), ("U", "Class"), ("U.i", "Field"), ("EventHandlerFn", "Function"), ("make2", "Method")]
    edges = [("F", "CONTAINS", "F.make"), ("F.make", "RETURNS", "I"), ("make2", "RETURNS", "I"), ("A", "IMPLEMENTS", "I"), ("B", "IMPLEMENTS", "I"), ("U", "CONTAINS", "U.i"), ("U.i", "OF_TYPE", "I")]
    g = make(spark, nodes, edges)
    assert got(tools.call(g, "get_design_patterns__factory"), "factory", "method", "product") == [("F", "make", "I")]
    assert got(tools.call(g, "get_design_patterns__strategy"), "strategy", "impl_count", "consumer") == [("I", 2, "U")]
    assert got(tools.call(g, "get_design_patterns__observer"), "class", "type") == [("EventHandlerFn", "Function")]


def test_unused_classes_by_hand(spark):
    """An annotated class is spared only if something contains it."""
    nodes = [("P", "Package"), ("A", "Class"), ("B", "Class"), ("C", "Class"), ("D", "Class"), ("x", "AnnotationType")]
    g = make(spark, nodes, [("P", "CONTAINS", "A"), ("A", "HAS_ANNOTATION", "x"), ("B", "HAS_ANNOTATION", "x"), ("P", "CONTAINS", "C"), ("C", "EXTENDS", "D")])
    assert got(tools.call(g, "get_unused_code__classes"), "class") == [("B",), ("C",)]


def test_routes_fall_back_only_without_entries_and_edges(spark):
    g = make(spark, [("main", "Function"), ("Box", "Component")], [("main", "RENDERS", "Box")])
    assert got(tools.call(g, "get_route_component_map"), "found_by", "entry") == [("fallback", "main"), ("fallback", "main")]
    g = make(spark, [("main", "Function"), ("Box", "Component"), ("pageBuilder", "Method")], [("main", "RENDERS", "Box"), ("pageBuilder", "RENDERS", "Box")])
    assert got(tools.call(g, "get_route_component_map"), "found_by", "entry", "child_component") == [("route", "pageBuilder", "Box")]


def test_screens_to_endpoints_by_hand(spark):
    nodes = [("Cart", "Component"), ("api.inventoryClient.getItems", "Function"), ("helper", "Function"), ("InventoryController.get_inventory", "Method"), ("api.other", "Function")]
    g = make(spark, nodes, [("Cart", "CALLS", "api.inventoryClient.getItems"), ("helper", "CALLS", "api.inventoryClient.getItems"), ("Cart", "CALLS", "api.other")])
    assert got(repos.ui_calls(g), "ui", "client") == [("Cart", "api.inventoryClient.getItems"), ("Cart", "api.other")]
    nodes = [("web.app", "Module"), ("lib.fetcher", "Module")]
    assert got(repos.ui_calls(make(spark, nodes, [("web.app", "IMPORTS", "lib.fetcher")])), "ui", "client") == [("web.app", "lib.fetcher")]
    assert repos.ui_calls(make(spark, nodes, [])).where(F.col("ui").isNotNull()).count() == 0


def test_summaries_and_pages_of_cypher(graph, spark):
    g = graph[0]
    sections = lambda df: {r.section for r in df.select("section").distinct().collect()}
    assert {"schema", "summary", "package", "dependency", "files", "layer by annotation", "layer by name", "language"} <= sections(registry.call(g, "get_architecture_summary"))
    package = tools.call(g, "get_module_interactions__outgoing").first().module
    assert {"contents", "calls", "hotspot"} <= sections(registry.call(g, "get_module_deep_dive", package=package))
    assert len(sections(registry.call(g, "get_frontend_architecture_summary"))) >= 8
    count = lambda **k: registry.call(g, "execute_cypher", query="MATCH (a)-[:CALLS]->(b) RETURN a.name AS a", **k).count()
    assert (count(), count(limit=7), count(limit=0), count(limit=999)) == (50, 7, 1, 200)
