"""Hand graphs with answers worked out by hand, in batch, through Cypher and through files and streams."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph import graph as G
from loomgraph.cypher import CypherError, query
from loomgraph.functions import names
from loomgraph.operators import passes, paths, preflight, tools
from loomgraph.plans import flows
from loomgraph.sources import graph_json
from loomgraph.streaming import ingest


def make(spark, nodes, edges):
    """nodes: (id, label[, visibility]); edges: (src, type, dst[, confidence])."""
    n = [(x[0], x[1], x[0].split(".")[-1], x[0], None, None, "java", x[2] if len(x) > 2 else None, 1, None, None, None, False) for x in nodes]
    e = [(i, x[0], x[2], x[1], i, x[3] if len(x) > 3 else None) for i, x in enumerate(edges)]
    return G.connected(spark.createDataFrame(n, "id string, label string, name string, qn string, repo string, path string, language string, visibility string, line long, end_line long, statement_type string, code string, external boolean"), spark.createDataFrame(e, "rel_id long, src string, dst string, type string, line long, confidence double"))


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def calls(spark):
    return make(spark, [(x, "Method") for x in "abcdt"], [("a", "CALLS", "t", 0.95), ("b", "CALLS", "t", 0.5), ("c", "CALLS", "t", None), ("d", "CALLS", "t", 0.9), ("a", "CALLS", "gone", 0.9)])


def test_null_confidence_passes_in_tools_and_fails_in_passes(calls):
    assert got(tools.call(calls, "get_callers", callee="t"), "caller") == [("a",), ("c",), ("d",)]
    w = passes.workflows(calls, calls.nodes.where("id IN ('a', 'b', 'c', 'd')"), F.col("id") == "t")
    assert got(w, "entry", "step_count") == [("a", 2), ("d", 2)]


def test_degrees_count_edges_and_callers_count_once(spark):
    g = make(spark, [(x, "Method") for x in "abt"], [("a", "CALLS", "t"), ("a", "CALLS", "t"), ("b", "CALLS", "t")])
    assert got(tools.call(g, "get_hotspots__fan_in"), "id", "fan_in") == [("t", 2)]
    assert got(tools.call(g, "get_hotspots__coupling"), "id") == []  # t has no out-edge, a and b no in-edge


def test_packages(spark):
    g = make(spark, [("P1", "Package"), ("P2", "Package"), ("X", "Class"), ("Y", "Class"), ("Z", "Class")], [("P1", "CONTAINS", "X"), ("P1", "CONTAINS", "Y"), ("P2", "CONTAINS", "Z"), ("X", "CALLS", "Z"), ("Y", "EXTENDS", "Z"), ("Z", "OF_TYPE", "X")])
    assert got(tools.call(g, "get_architecture_overview__dependencies"), "from_pkg", "to_pkg", "weight") == [("P1", "P2", 2), ("P2", "P1", 1)]
    assert got(tools.call(g, "detect_circular_dependencies__packages"), "package_a") == []
    assert got(tools.call(g, "get_component_coupling_matrix__both_ways"), "package_a", "package_b", "forth", "back") == [("P1", "P2", 2, 1)]


def test_cycle_and_walks(spark):
    g = make(spark, [(x, "Method") for x in "abc"], [("a", "CALLS", "b"), ("b", "CALLS", "a"), ("b", "CALLS", "c"), ("c", "CALLS", "c")])
    assert got(tools.call(g, "detect_circular_dependencies__calls"), "method_a", "method_b") == [("a", "b")]
    a = g.nodes.where("id = 'a'")
    assert got(paths.expand(g, ["CALLS"], 3, starts=a), "distance", "node") == [(1, "b"), (2, "a"), (2, "c"), (3, "b"), (3, "c")]
    assert got(paths.expand(g, ["CALLS"], 1, 0, starts=a, backwards=True), "distance", "node") == [(0, "a"), (1, "b")]
    assert got(paths.shortest_paths(g, a, g.nodes.where("id = 'c'")), "path", "length") == [(["a", "b", "c"], 2)]
    assert got(paths.call_chains(g, a, g.nodes.where("id = 'c'"), 5), "path", "depth") == [(["a", "b", "c"], 2)]


def test_inheritance_to_roots(spark):
    g = make(spark, [(x, "Class") for x in "ABCDE"], [("D", "EXTENDS", "C"), ("C", "EXTENDS", "B"), ("B", "EXTENDS", "A"), ("E", "EXTENDS", "A"), ("E", "EXTENDS", "A")])
    assert got(paths.walks_to_roots(g, ["EXTENDS"], 10), "start", "root", "depth", "walks") == [("B", "A", 1, 1), ("C", "A", 2, 1), ("D", "A", 3, 1), ("E", "A", 1, 2)]


def test_unused(spark):
    g = make(spark, [("m1", "Method", "public"), ("m2", "Method", "public"), ("m3", "Method", "protected"), ("m4", "Method", "private"), ("x.main", "Method", "public"), ("o", "Method", "private")], [("m4", "CALLS", "m1"), ("o", "OVERRIDES", "m3")])
    assert got(tools.call(g, "get_unused_code__methods"), "method") == [("m2",)]


def test_workflows(spark):
    nodes = [("h", "Method"), ("s", "Method"), ("q", "Method"), ("x.repository.r1", "Method"), ("x.repository.r2", "Method"), ("x.repository.r3", "Method"), ("GetMapping", "AnnotationType")]
    edges = [("h", "HAS_ANNOTATION", "GetMapping"), ("h", "CALLS", "s", 0.95), ("s", "CALLS", "x.repository.r1", 0.9), ("s", "CALLS", "x.repository.r2", 0.9), ("h", "CALLS", "x.repository.r3", 0.5), ("h", "CALLS", "q", 0.95), ("q", "CALLS", "x.repository.r1", 0.95)]
    g = make(spark, nodes, edges)
    e = passes.http_entries(g)
    assert got(e, "id", "verb") == [("h", "GET")]
    w = passes.workflows(g, e)
    assert got(w, "path") == [(["h", "q", "x.repository.r1"],), (["h", "s", "x.repository.r1"],), (["h", "s", "x.repository.r2"],)]
    assert passes.workflow_steps(w).count() == 9
    spread = passes.workflow_spread(passes.workflow_steps(w), spark.createDataFrame([("h", "D"), ("s", "D"), ("q", "E")], "id string, domain string"))
    assert sorted(r.type for r in spread.collect()) == ["cross-domain", "intra-domain", "intra-domain"]


def test_domains_and_cohesion(spark):
    g = make(spark, [("p.one.a", "Method"), ("p.one.b", "Method"), ("p.two.x", "Method"), ("p.two.y", "Method"), ("p.ATest", "Class")], [("p.one.a", "CALLS", "p.one.b", 0.95), ("p.one.b", "CALLS", "p.one.a", 0.95), ("p.one.a", "CALLS", "p.two.x", 0.1), ("p.two.y", "CALLS", "p.one.b", 0.1), ("p.two.x", "CONTAINS", "p.two.y")])
    d = passes.domains(g)
    rows = {r.name: r for r in d.domains.collect()}
    assert rows["One"].cohesion == 0.5 and rows["Two"].cohesion == 0.0 and rows["One"].members == 2
    assert got(d.members, "id", "domain") == [("p.one.a", "p.one.a"), ("p.one.b", "p.one.a"), ("p.two.x", "p.two.x"), ("p.two.y", "p.two.x")]


def test_members_over_all_rounds_fit_the_domains(spark, monkeypatch):
    ids = [f"p.n{i:02}" for i in range(12)]
    g = make(spark, [(x, "Method") for x in ids], [(a, "CALLS", b, 0.95) for a, b in zip(ids, ids[1:])])
    monkeypatch.setattr(flows.G, "load", lambda *_: g)

    def labels(rounds):
        at = {x: x for x in ids}
        for _ in range(rounds):
            votes = {x: Counter([at[x], *(at[y] for j, y in enumerate(ids) if abs(i - j) == 1)]) for i, x in enumerate(ids)}
            at = {x: min(v, key=lambda k: (-v[k], k)) for x, v in votes.items()}
        return at

    full = dict(got(flows.QUERIES["get_domains__members_full"](spark, ""), "id", "domain"))
    assert full == labels(10) != labels(4) and dict(got(flows.domain_members(spark, ""), "id", "domain")) == labels(4)
    sizes = dict(got(flows.get_domains(spark, ""), "domain", "members"))
    assert sizes == Counter(full.values())


def test_flows_of_all_nodes_over_the_default_depths(spark, monkeypatch):
    ids = ["x.a", "x.b", "x.c", "x.d", "x.e", "x.UserClient.f", "x.g", "x.h", "x.i", "x.j"]
    g = make(spark, [(x, "Method") for x in ids] + [("E", "Class"), ("src/f", "File")], [(a, "CALLS", b, 0.95) for a, b in zip(ids, ids[1:])] + [("x.UserClient.f", "THROWS", "E"), ("x.UserClient.f", "SOURCE_FILE", "src/f")])
    g = G.Graph(g.nodes.withColumn("path", F.when(F.col("label") == "File", F.col("id"))), g.edges)
    monkeypatch.setattr(flows.G, "load", lambda *_: g)
    run = lambda name, *cols: got(flows.QUERIES[name](spark, ""), *cols)
    far = lambda lo, hi: sorted((a, b, j - i) for i, a in enumerate(ids) for j, b in enumerate(ids) if lo <= j - i <= hi)
    assert run("trace_user_flow__calls_full", "entry", "called_method", "depth") == far(1, 5)
    assert run("get_call_chain__full", "start", "finish", "depth") == far(1, 8)
    extra = [(a, b, 5 - i + 1) for i, a in enumerate(ids[:6]) for b in ("E", "src/f") if 5 - i + 1 <= 6]
    assert run("find_path_between__full", "source", "target", "length") == sorted(far(1, 6) + extra)
    assert run("trace_user_flow__exceptions_full", "start", "exception") == sorted((a, "E") for a in ids[:6])
    assert run("trace_user_flow__boundaries_full", "method", "boundary") == sorted((a, ids[5]) for a in ids[:5])
    assert run("trace_user_flow__files", "start", "file_path") == sorted((a, "src/f") for a in ids[:6])


def test_external_groups(spark):
    g = make(spark, [(x, "Class") for x in ("java.util.List", "java.util.Map", "org.x.y.z.T", "Foo")], [("Foo", "CALLS", "Foo")])
    g = G.Graph(g.nodes.withColumn("external", F.lit(True)), g.edges)
    assert got(tools.call(g, "get_external_dependencies"), "grp", "symbols") == [("Foo", 1), ("java.util", 2), ("org.x.y", 1)]


def test_name_tokens(spark):
    df = spark.createDataFrame([("api.inventoryClient.getItems",), ("InventoryController.getInventory",), ("",)], "n string")
    assert [sorted(r[0]) for r in df.select(names.tokens(F.col("n"))).collect()] == [["inventory", "items"], ["inventory"], []]
    assert got(names.overlaps(df, "n", df.withColumnRenamed("n", "m").where("m LIKE 'Inv%'"), "m"), "n", "m") == [("InventoryController.getInventory", "InventoryController.getInventory"), ("api.inventoryClient.getItems", "InventoryController.getInventory")]


def test_dedupe_policies_merge_and_limit(spark):
    df = spark.createDataFrame([("i", 1, "old"), ("i", 2, "new"), (None, 3, "x")], "id string, seq int, v string")
    assert got(G.dedupe(df, ["seq"]), "v") == [("new",)] and got(G.dedupe(df, ["seq"], first=True), "v") == [("old",)]
    g = make(spark, [("a", "Class"), ("b", "Class")], [("a", "CALLS", "b")])
    assert G.merge(g, g).edges.count() == 2 and G.merge(g, g).nodes.count() == 2
    assert tools.call(g, "get_class_hierarchy", limit=1).count() == 0
    with pytest.raises(KeyError):
        tools.call(g, "nothing")
    assert tools.search(g, "A*", "Class").count() == 1


CYPHER = [
    ("MATCH (a)-[r:CALLS]->(b) WHERE b.name = $x AND (r.confidence IS NULL OR r.confidence >= 0.9) RETURN a.qualifiedName AS caller ORDER BY caller", [("a",), ("c",), ("d",)]),
    ("MATCH (m:Method) WHERE NOT EXISTS { MATCH (x)-[:CALLS]->(m) } RETURN count(*) AS n", [(4,)]),
    ("MATCH (a)-[:CALLS]->(b:Method) WITH b, count(DISTINCT a) AS n WHERE n >= 2 RETURN b.name AS name, n", [("t", 4)]),
    ("MATCH p = (a {name: 'a'})-[:CALLS*1..3]->(b) WHERE ALL(e IN relationships(p) WHERE e.confidence >= 0.9) RETURN length(p) AS len, nodes(p)[0] AS first", [(1, "a")]),
    ("MATCH (n:Method) OPTIONAL MATCH (n)-[:CALLS]->(b) WHERE b.name =~ '(?i)T' RETURN n.name AS n, b.name AS b ORDER BY n DESC LIMIT 2", [("t", None), ("d", "t")]),
    ("UNWIND [1, 2, 2] AS x RETURN DISTINCT x AS x ORDER BY x", [(1,), (2,)]),
    ("MATCH (n) WHERE n.name IN ['a', 'b'] RETURN n.name AS v UNION MATCH (n) WHERE n.name STARTS WITH 'a' RETURN n.name AS v", [("a",), ("b",)]),
    ("MATCH (a)<-[:CALLS]-(b) RETURN label(a) AS l, collect(b.name)[0..2] AS some, sum(CASE WHEN b.name = 'a' THEN 1 ELSE 0 END) AS n", [("Method", ["a", "b"], 1)]),
    ("MATCH (a)-[:CALLS]-(b) WHERE a.name = 't' RETURN b.name AS b ORDER BY b SKIP 1 LIMIT 2", [("b",), ("c",)]),
]


@pytest.mark.parametrize("text,want", CYPHER)
def test_cypher(calls, text, want):
    rows = [tuple(r) for r in query(calls, text, x="t").collect()]
    assert (rows if "ORDER" in text else sorted(rows)) == want


@pytest.mark.parametrize("text", ["CREATE (n)", "MATCH (n) DELETE n RETURN n", "MATCH (n) SET n.a = 1 RETURN n", "MATCH (a), (b) RETURN a, b", "MATCH (n) RETURN m", "MATCH (a)-[*]->(b) RETURN a", "MATCH (n)", "RETURN foo(1)", "CALL db.x()", "MATCH (n RETURN n"])
def test_cypher_refuses(calls, text):
    with pytest.raises(CypherError):
        query(calls, text)


def files(path):
    a = {"nodes": [{"id": "x", "type": "Class", "name": "X", "qualifiedName": "p.X", "properties": {"visibility": "public", "path": "None", "lineNumber": "3"}}, {"id": "y", "type": "Method", "name": 'q"<y>', "qualifiedName": "p.y", "properties": {}}], "relationships": [{"sourceId": "x", "targetId": "y", "type": "CONTAINS", "properties": {}}, {"sourceId": "x", "targetId": "missing", "type": "CALLS"}]}
    b = {"nodes": [{"id": "z", "type": "Method", "name": "z"}], "relationships": [{"source": "z", "target": "z", "type": "calls", "properties": {"resolved": "true"}}]}
    for i, g in enumerate((a, b)):
        (path / f"{i}.json").write_text(json.dumps(g, indent=1))


def test_graph_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    files(src)
    g = graph_json.read(spark, str(src))
    assert got(g.nodes, "id", "label", "line") and got(g.edges, "src", "dst", "type", "confidence") == [("x", "y", "CONTAINS", None), ("z", "z", "CALLS", 0.9)]
    assert g.nodes.where("id = 'x'").first().path is None
    graph_json.save(g, str(tmp_path / "store"))
    again = graph_json.open_saved(spark, str(tmp_path / "store"))
    assert got(again.nodes, "id", "label") == got(g.nodes, "id", "label") and again.edges.count() == 2
    dot = [r.value for r in graph_json.to_dot(g).orderBy("ord", "value").collect()]
    assert dot[0].startswith("digraph") and dot[-1] == "}" and any(r'q\"<y>' in x for x in dot)
    assert any("q&quot;&lt;y&gt;" in r.value for r in graph_json.to_graphml(g).collect())
    assert {json.loads(r.value).get("id") for r in graph_json.to_json(g).collect()} == {"x", "y", "z", None}
    assert "null" not in graph_json.render(g.nodes.select("id", "path")).first().value
    graph_json.write_lines(graph_json.to_dot(g), str(tmp_path / "dot"))
    assert spark.read.text(str(tmp_path / "dot")).count() == len(dot)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    files(src)
    q = ingest.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert got(ingest.current(spark, str(tmp_path / "out")).edges, "src", "dst") == [("x", "y"), ("z", "z")]
    rows = [("parent", "k", "2025-01-02", False, None, None), ("reference", "k", "2025-01-01", None, 1, "target"), ("reference", "k", "2025-01-03", None, 2, "target")]
    land = tmp_path / "events"
    spark.createDataFrame(rows, "kind string, key string, at string, gone boolean, rel_id long, side string").withColumn("at", F.col("at").cast("timestamp_ntz")).write.parquet(str(land))
    s = ingest.OrphanStream(spark, str(tmp_path / "state"))
    schema = spark.read.parquet(str(land)).schema
    s.start(spark.readStream.schema(schema).parquet(str(land)), str(tmp_path / "cp2")).awaitTermination()
    one = s.store.snapshots().first()
    assert (one.refs, one.orphans, one.open_now, one.resolved) == (2, 1, 0, 1)


def test_preflight(spark):
    rows = [("r", "App.java", "class A {\n}\n\n", 1), ("r", "src/api.ts", "a\r\n \r\nb", 1), ("r", "node_modules/x.js", "x", 1), ("r", "build/y.py", "y", 1), ("r", "readme.md", "z", 1), ("r", "src/n.py", None, 1)]
    f = spark.createDataFrame(rows, "repo string, path string, code string, loaded_at long")
    m = preflight.metrics(f).first()
    assert (m.files, m.loc, m.families, m.band, m.risk) == (3, 4, "js, jvm, python", "small", "medium")
    after = f.where("path <> 'readme.md'").withColumn("code", F.when(F.col("path") == "App.java", "changed").otherwise(F.col("code"))).unionByName(spark.createDataFrame([("r", "new.py", "1", 1)], f.schema))
    assert got(preflight.changes(preflight.manifest(f), preflight.manifest(after)), "path", "change") == [("App.java", "changed"), ("new.py", "added"), ("readme.md", "removed")]
