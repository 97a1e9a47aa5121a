"""Queries of expansions, paths, workflows and domains, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import graph as G
from loomgraph.operators import passes, paths
from loomgraph.operators.tools import BOUNDARY
from loomgraph.plans.tools import oracle

DEPENDS = ["CALLS", "EXTENDS", "IMPLEMENTS", "OF_TYPE"]


def _named(g: G.Graph, d: DataFrame, *ids: str) -> DataFrame:
    for c in ids:
        d = d.join(g.nodes.select(F.col("id").alias(c), F.col("qn").alias(f"{c}_qn"), F.col("label").alias(f"{c}_type")), c)
    return d


def dependency_graph(spark: SparkSession, d: str, depth: int = 2) -> DataFrame:
    return paths.expand(G.load(spark, d), DEPENDS, depth)


def impact(spark: SparkSession, d: str, depth: int = 3) -> DataFrame:
    """All callers of all nodes up to ``depth`` calls away: the walks of the callers, told from their ends."""
    return paths.expand(G.load(spark, d), ["CALLS"], depth).select(F.col("node").alias("changed"), F.col("start").alias("affected"), "distance")


def descendants(spark: SparkSession, d: str) -> DataFrame:
    return paths.expand(G.load(spark, d), ["EXTENDS", "IMPLEMENTS"], 3).select(F.col("node").alias("changed"), F.col("start").alias("affected"), "distance")


def inheritance(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return paths.walks_to_roots(g, ["EXTENDS"], 10)


def exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Classes that extend classes, over up to five steps, where either is named an exception or an error."""
    g = G.load(spark, d)
    e = paths.expand(g, ["EXTENDS"], 5)
    for c in ("start", "node"):
        e = e.join(g.nodes.where("label = 'Class'").select(F.col("id").alias(c), F.col("qn").alias(f"{c}_qn"), F.col("name").alias(f"{c}_name")), c)
    like = "(Exception|Error)"
    return e.where(F.col("start_name").rlike(like) | F.col("node_name").rlike(like)).select(F.col("start_qn").alias("exception"), F.col("node_qn").alias("parent"), "distance")


def _ends(g: G.Graph) -> tuple[DataFrame, DataFrame]:
    methods = g.nodes.where("label IN ('Method', 'Function') AND NOT external")
    return methods.where(F.col("qn").rlike(r"Controller\.[^.]*$")), methods.where(F.col("qn").rlike(r"Repository\.[^.]*$"))


def find_path(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths from methods of controllers to methods of repositories, over relationships of any type."""
    g = G.load(spark, d)
    s, t = _ends(g)
    return paths.shortest_paths(g, s, t, 4).select("source", "target", F.array_join("path", " > ").alias("path"), "length")


def call_chain(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    s, t = _ends(g)
    return paths.call_chains(g, s, t, 4).select("start", F.col("end").alias("finish"), F.array_join("path", " > ").alias("path"), "depth")


def user_flow(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the methods of controllers reach over up to three calls, with what they throw."""
    g = G.load(spark, d)
    return _named(g, paths.expand(g, ["CALLS"], 3, starts=_ends(g)[0]), "start", "node").select(F.col("start_qn").alias("entry"), F.col("node_qn").alias("called_method"), F.col("node_type").alias("type"), F.col("distance").alias("depth"))


def user_flow_exceptions(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    reach = paths.expand(g, ["CALLS"], 3, 0, starts=_ends(g)[0])
    throws = g.edges.where("type = 'THROWS'").select(F.col("src").alias("node"), F.col("dst").alias("exception")).distinct()
    return reach.join(throws, "node").select("start", "exception", F.col("node").alias("thrown_by")).distinct()


# The queries above answer for the ends and depths of their SQL; those below for all nodes, over the tools' default depths.


def find_path_full(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return paths.shortest_paths(g, g.nodes, g.nodes).select("source", "target", F.array_join("path", " > ").alias("path"), "length")


def call_chain_full(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return paths.call_chains(g, g.nodes, g.nodes).select("start", F.col("end").alias("finish"), F.array_join("path", " > ").alias("path"), "depth")


def user_flow_full(spark: SparkSession, d: str, depth: int = 5) -> DataFrame:
    g = G.load(spark, d)
    return _named(g, paths.expand(g, ["CALLS"], depth), "start", "node").select(F.col("start_qn").alias("entry"), F.col("node_qn").alias("called_method"), F.col("node_type").alias("type"), F.col("distance").alias("depth"))


def user_flow_exceptions_full(spark: SparkSession, d: str, depth: int = 5) -> DataFrame:
    g = G.load(spark, d)
    throws = g.edges.where("type = 'THROWS'").select(F.col("src").alias("node"), F.col("dst").alias("exception")).distinct()
    return paths.expand(g, ["CALLS"], depth, 0).join(throws, "node").select("start", "exception", F.col("node").alias("thrown_by")).distinct()


def user_flow_boundaries_full(spark: SparkSession, d: str, depth: int = 5) -> DataFrame:
    """Repositories, clients and the like that a node reaches over up to ``depth`` calls."""
    g = G.load(spark, d)
    pairs = _named(g, paths.expand(g, ["CALLS"], depth).select("start", "node").distinct(), "start", "node")
    return pairs.where(F.col("node_qn").rlike(f"(?i)({BOUNDARY})")).select(F.col("start_qn").alias("method"), F.col("node_qn").alias("boundary"), F.col("node_type").alias("type")).distinct()


def user_flow_files(spark: SparkSession, d: str, depth: int = 5) -> DataFrame:
    """Source files of a node and of all it reaches over up to ``depth`` calls."""
    g = G.load(spark, d)
    files = g.edges.where("type = 'SOURCE_FILE'").join(g.nodes.where("label = 'File' AND path IS NOT NULL").select(F.col("id").alias("dst"), F.col("path").alias("file_path")), "dst").select(F.col("src").alias("node"), "file_path").distinct()
    return paths.expand(g, ["CALLS"], depth, 0).join(files, "node").select("start", "file_path").distinct()


def _entries(g: G.Graph) -> DataFrame:
    return _ends(g)[0]


def get_workflows(spark: SparkSession, d: str) -> DataFrame:
    """Ways from methods of controllers to methods of repositories over sure calls."""
    g = G.load(spark, d)
    return passes.workflows(g, _entries(g), F.col("qn").rlike(r"Repository\.[^.]*$")).withColumn("path", F.array_join("path", " > "))


def get_workflow_steps(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return passes.workflow_steps(passes.workflows(g, _entries(g), F.col("qn").rlike(r"Repository\.[^.]*$")))


def http_workflows(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return passes.workflows(g, passes.http_entries(g)).withColumn("path", F.array_join("path", " > "))


def get_domains(spark: SparkSession, d: str) -> DataFrame:
    return passes.domains(G.load(spark, d)).domains


def domain_members(spark: SparkSession, d: str) -> DataFrame:
    """Members after four rounds, as the SQL of this name unrolls them; ``domain_members_full`` has the domains of ``get_domains``."""
    return passes.domains(G.load(spark, d), 4).members


def domain_members_full(spark: SparkSession, d: str) -> DataFrame:
    """Members of the domains that ``get_domains`` lists, over all its rounds."""
    return passes.domains(G.load(spark, d)).members


QUERIES = {
    "get_dependency_graph": dependency_graph, "impact_analysis__callers": impact, "impact_analysis__descendants": descendants, "get_hotspots__inheritance": inheritance, "get_exception_handling__hierarchy": exceptions, "find_path_between": find_path, "get_call_chain": call_chain, "trace_user_flow__calls": user_flow, "trace_user_flow__exceptions": user_flow_exceptions,
    "get_workflows": get_workflows, "get_workflow_steps": get_workflow_steps, "get_workflows__http": http_workflows, "get_domains": get_domains, "get_domains__members": domain_members, "get_domains__members_full": domain_members_full,
    "find_path_between__full": find_path_full, "get_call_chain__full": call_chain_full, "trace_user_flow__calls_full": user_flow_full, "trace_user_flow__exceptions_full": user_flow_exceptions_full, "trace_user_flow__boundaries_full": user_flow_boundaries_full, "trace_user_flow__files": user_flow_files,
}


def _hops(types: str, depth: int, start: str = "TRUE") -> str:
    """Distinct ends of walks of each length up to ``depth``, as common table expressions h1..hn."""
    out = [f"g AS (SELECT DISTINCT src, dst FROM {{e}} WHERE type IN ({types}))", f"h1 AS (SELECT DISTINCT src AS start, dst AS node FROM g WHERE {start})"]
    out += [f"h{i} AS (SELECT DISTINCT h.start, g.dst AS node FROM h{i - 1} h JOIN g ON g.src = h.node)" for i in range(2, depth + 1)]
    return ", ".join(out)


def _union(depth: int, cols: str) -> str:
    return " UNION ALL ".join(f"SELECT {cols}, {i} AS distance FROM h{i}" for i in range(1, depth + 1))


_DEP = "'CALLS', 'EXTENDS', 'IMPLEMENTS', 'OF_TYPE'"
_CONTROLLERS = "src IN (SELECT id FROM {n} WHERE label IN ('Method', 'Function') AND NOT external AND @re(qn, 'Controller\\.[^.]*$'))"


def _walk_sql() -> str:
    out = ["g AS (SELECT src, dst, count(*) AS m FROM {e} WHERE type = 'EXTENDS' GROUP BY src, dst)", "h1 AS (SELECT src AS start, dst AS node, m AS walks FROM g)"]
    out += [f"h{i} AS (SELECT h.start, g.dst AS node, CAST(sum(h.walks * g.m) AS BIGINT) AS walks FROM h{i - 1} h JOIN g ON g.src = h.node GROUP BY h.start, g.dst)" for i in range(2, 11)]
    u = " UNION ALL ".join(f"SELECT start, node AS root, {i} AS depth, walks FROM h{i}" for i in range(1, 11))
    return f"WITH {', '.join(out)} SELECT * FROM ({u}) u WHERE root NOT IN (SELECT src FROM g)"


def _shortest_sql(depth: int) -> str:
    s = _CONTROLLERS.replace("src IN (SELECT id", "SELECT id", 1)[:-1]
    t = s.replace("Controller", "Repository")
    out = ["g AS (SELECT DISTINCT src, dst FROM {e})", f"l0 AS (SELECT id AS source, id AS node, [id] AS path FROM ({s}) z)"]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT source, node FROM l{j}" for j in range(i))
        out.append(f"l{i} AS MATERIALIZED (SELECT x.source, x.node, min(x.path) AS path FROM (SELECT l.source, g.dst AS node, list_append(l.path, g.dst) AS path FROM l{i - 1} l JOIN g ON g.src = l.node) x LEFT JOIN ({seen}) o ON o.source = x.source AND o.node = x.node WHERE o.source IS NULL GROUP BY x.source, x.node)")
    u = " UNION ALL ".join(f"SELECT source, node AS target, array_to_string(path, ' > ') AS path, {i} AS length FROM l{i}" for i in range(1, depth + 1))
    return f"WITH {', '.join(out)} SELECT * FROM ({u}) u WHERE target IN ({t})"


def _chain_sql(depth: int) -> str:
    s = _CONTROLLERS.replace("src IN (SELECT id", "SELECT id", 1)[:-1]
    t = s.replace("Controller", "Repository")
    out = ["g AS (SELECT DISTINCT src, dst FROM {e} WHERE type = 'CALLS' AND (confidence IS NULL OR confidence >= 0.9))", f"l0 AS (SELECT id AS start, id AS node, [id] AS path FROM ({s}) z)"]
    out += [f"l{i} AS (SELECT l.start, g.dst AS node, list_append(l.path, g.dst) AS path FROM l{i - 1} l JOIN g ON g.src = l.node WHERE NOT list_contains(l.path, g.dst))" for i in range(1, depth + 1)]
    u = " UNION ALL ".join(f"SELECT start, node AS finish, path, {i} AS depth FROM l{i}" for i in range(1, depth + 1))
    return f"WITH {', '.join(out)} SELECT start, finish, array_to_string(path, ' > ') AS path, depth FROM (SELECT *, row_number() OVER (PARTITION BY start, finish ORDER BY depth, path) AS k FROM ({u}) u WHERE finish IN ({t})) y WHERE k <= 10"


def _lpa_sql(rounds: int) -> str:
    keep = "label IN ('Class', 'Interface', 'Enum', 'Method', 'Component', 'Module', 'AsyncFunction', 'Function', 'ArrowFunction') AND NOT external AND NOT (@re(coalesce(path, ''), '/tests?/') OR @re(coalesce(qn, ''), '(Test|IT|Spec)$') OR contains(coalesce(qn, ''), 'Test.') OR contains(coalesce(path, ''), '.test.'))"
    out = [f"k AS (SELECT id FROM {{n}} WHERE {keep})", "w AS (SELECT src, dst FROM {e} WHERE src <> dst AND (type IN ('CONTAINS', 'RENDERS', 'USES_HOOK', 'IMPORTS') OR type = 'CALLS' AND confidence >= 0.9) AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k))", "a AS MATERIALIZED (SELECT src AS a, dst AS b FROM w UNION SELECT dst, src FROM w)", "r0 AS MATERIALIZED (SELECT id, id AS label FROM k)"]
    for i in range(1, rounds + 1):
        out.append(f"r{i} AS MATERIALIZED (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY c DESC, label) AS k FROM (SELECT id, label, count(*) AS c FROM (SELECT a.a AS id, r.label FROM a JOIN r{i - 1} r ON r.id = a.b UNION ALL SELECT id, label FROM r{i - 1}) x GROUP BY id, label) y) z WHERE k = 1)")
    return f"WITH {', '.join(out)} SELECT id, label AS domain FROM r{rounds}"


SQL = {
    "get_dependency_graph": oracle(f"WITH {_hops(_DEP, 2)} {_union(2, 'start, node')}"),
    "impact_analysis__callers": oracle(f"WITH {_hops(repr('CALLS'), 3)} {_union(3, 'node AS changed, start AS affected')}"),
    "impact_analysis__descendants": oracle(f"WITH {_hops(repr('EXTENDS') + ', ' + repr('IMPLEMENTS'), 3)} {_union(3, 'node AS changed, start AS affected')}"),
    "get_hotspots__inheritance": oracle(_walk_sql()),
    "get_exception_handling__hierarchy": oracle(f"WITH {_hops(repr('EXTENDS'), 5)}, u AS ({_union(5, 'start, node')}) SELECT a.qn AS exception, b.qn AS parent, distance FROM u JOIN {{n}} a ON a.id = start JOIN {{n}} b ON b.id = node WHERE a.label = 'Class' AND b.label = 'Class' AND (contains(a.name, 'Exception') OR contains(a.name, 'Error') OR contains(b.name, 'Exception') OR contains(b.name, 'Error'))"),
    "find_path_between": oracle(_shortest_sql(4)),
    "get_call_chain": oracle(_chain_sql(4)),
    "trace_user_flow__calls": oracle(f"WITH {_hops(repr('CALLS'), 3, _CONTROLLERS)}, u AS ({_union(3, 'start, node')}) SELECT a.qn AS entry, b.qn AS called_method, b.label AS type, distance AS depth FROM u JOIN {{n}} a ON a.id = start JOIN {{n}} b ON b.id = node"),
    "trace_user_flow__exceptions": oracle(f"WITH {_hops(repr('CALLS'), 3, _CONTROLLERS)}, u AS (SELECT src AS start, src AS node FROM (SELECT id AS src FROM {{n}}) q WHERE {_CONTROLLERS} UNION ALL SELECT start, node FROM h1 UNION ALL SELECT start, node FROM h2 UNION ALL SELECT start, node FROM h3) SELECT DISTINCT u.start, x.dst AS exception, u.node AS thrown_by FROM u JOIN {{e}} x ON x.src = u.node AND x.type = 'THROWS'"),
    "get_domains__members": oracle(_lpa_sql(4)),
}
