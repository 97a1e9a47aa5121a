"""Derived passes: workflows by path search, domains by label propagation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.session import materialize

#: Annotations that make a method an entry point, with their verb; names that make a node a terminal.
HTTP_VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "HTTP"}
#: Labels that are clustered and relationships that join them.
PRODUCTION = ["Class", "Interface", "Enum", "Method", "Component", "Module", "AsyncFunction", "Function", "ArrowFunction"]
ADJACENT = ["CONTAINS", "RENDERS", "USES_HOOK", "IMPORTS"]


def http_entries(graph: Graph, annotations: dict[str, str] = HTTP_VERBS) -> DataFrame:
    """``(id, verb)`` of methods with an HTTP annotation; of several the first by the order of ``annotations``."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(annotations) for x in (k, i)])
    verb = F.create_map(*[F.lit(x) for k, v in annotations.items() for x in (k, v)])
    a = graph.joined.where((F.col("type") == "HAS_ANNOTATION") & F.col("s_label").isin("Method", "Function") & F.col("d_name").isin(list(annotations)))
    return a.groupBy(F.col("s_id").alias("id")).agg(F.min_by(verb[F.col("d_name")], order[F.col("d_name")]).alias("verb"))


def jvm_terminal() -> Column:
    qn, name = F.coalesce("qn", F.lit("")), F.lower(F.coalesce("name", F.lit("")))
    return qn.contains(".repository.") | qn.contains("KafkaProducer") | qn.contains("EventPublisher") | name.contains("producer") | name.contains("kafkatemplate")


def workflows(graph: Graph, entries: DataFrame, terminal: Column | None = None, max_depth: int = 12) -> DataFrame:
    """``(workflow_id, entry, terminal, path, step_count)`` of each way found from an entry (id) to a terminal.

    Breadth first over sure calls and RENDERS. A terminal ends a way and is never
    marked as visited, so that several ways may end in it; another node keeps
    its first path: the shortest, of equal ones the first by its ids. A null
    confidence counts as 0.5 here, other than in the tools.
    """
    is_end = jvm_terminal() if terminal is None else terminal
    e = graph.edges.where((F.col("type") == "RENDERS") | (F.col("type") == "CALLS") & (F.col("confidence") >= 0.9)).select("src", "dst").distinct()
    ends = graph.nodes.where(is_end).select(F.col("id").alias("dst"), F.lit(True).alias("end"))
    e = materialize(e.join(ends, "dst", "left").select("src", "dst", F.coalesce("end", F.lit(False)).alias("end")), "calls")
    at = materialize(entries.select(F.col("id").alias("entry")).distinct().select("entry", F.col("entry").alias("node"), F.array("entry").alias("path")), "frontier")
    seen, out = at.select("entry", "node"), None
    for _ in range(max_depth):
        step = materialize(at.join(e, F.col("node") == F.col("src")).select("entry", F.col("dst").alias("node"), "end", F.concat("path", F.array("dst")).alias("path")), "step")
        part = step.where(F.col("end") & (F.col("node") != F.col("entry"))).select("entry", F.col("node").alias("terminal"), "path")
        out = part if out is None else out.unionByName(part)
        at = materialize(step.where(~F.col("end")).join(seen, ["entry", "node"], "left_anti").groupBy("entry", "node").agg(F.min("path").alias("path")), "frontier")
        if not at.take(1):
            break
        seen = seen.unionByName(at.select("entry", "node"))
    return out.select(F.concat(F.lit("workflow:"), F.substring(F.sha2(F.array_join("path", "\n"), 256), 1, 16)).alias("workflow_id"), "entry", "terminal", "path", F.size("path").alias("step_count"))


def workflow_steps(found: DataFrame) -> DataFrame:
    return found.select("workflow_id", F.posexplode("path").alias("at", "node")).select("workflow_id", (F.col("at") + 1).alias("step"), "node")


@dataclass
class Domains:
    """``members`` (id, domain), ``domains`` (domain, name, language, members, cohesion)."""

    members: DataFrame
    domains: DataFrame


def production(graph: Graph) -> DataFrame:
    """Nodes that are clustered: own code that is no test."""
    path, qn = F.coalesce("path", F.lit("")), F.coalesce("qn", F.lit(""))
    test = path.rlike("/tests?/") | qn.rlike("(Test|IT|Spec)$") | qn.contains("Test.") | path.contains(".test.")
    return graph.nodes.where(F.col("label").isin(PRODUCTION) & ~F.col("external") & ~test)


def neighbours(graph: Graph, nodes: DataFrame) -> DataFrame:
    """``(a, b)``: undirected set of sure calls, containment and the like between ``nodes``."""
    e = graph.edges.where(F.col("type").isin(ADJACENT) | (F.col("type") == "CALLS") & (F.col("confidence") >= 0.9)).where("src <> dst")
    ids = nodes.select("id")
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def propagate(nodes: DataFrame, links: DataFrame, rounds: int = 10) -> DataFrame:
    """``(id, label)`` by synchronous label propagation: each round a node takes the most frequent label among its neighbours and itself, of equal ones the smallest.

    The own label counts once, which keeps two-sided groups from swapping
    forever. Labels are counted by (node, label) before by node, so that a node
    with very many neighbours is no hot task. Ends early when nothing changes.
    """
    links = materialize(links, "links")
    at = materialize(nodes.select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        votes = links.join(at.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label").unionByName(at.select("id", "label")).groupBy("id", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("_")).select("id", F.col("_.label").alias("label"))
        new = materialize(best, "labels")
        if not new.join(at.withColumnRenamed("label", "old"), "id").where("label <> old").take(1):
            return new
        at = new
    return at


def domains(graph: Graph, rounds: int = 10) -> Domains:
    """Domains of own code, with their name, language and cohesion (calls within to calls touching; 1 without any)."""
    nodes = production(graph)
    labels = propagate(nodes, neighbours(graph, nodes), rounds)
    members = labels.select("id", F.col("label").alias("domain"))
    info = members.join(nodes.select("id", "qn", "name", "language"), "id")
    parts = F.split("qn", r"\.")
    segment = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.col("name"))
    title = F.concat(F.upper(F.substring(segment, 1, 1)), F.expr("substr(seg, 2)"))

    def mode(col: str) -> DataFrame:
        c = info.withColumn("seg", segment).withColumn("title", title).groupBy("domain", col).agg(F.count("*").alias("n"))
        return c.groupBy("domain").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(col).alias("v"))).alias("_")).select("domain", F.col("_.v").alias(col))

    calls = graph.edges.where("type = 'CALLS'").select("src", "dst")
    a = members.select(F.col("id").alias("src"), F.col("domain").alias("da"))
    b = members.select(F.col("id").alias("dst"), F.col("domain").alias("db"))
    both = calls.join(a, "src", "left").join(b, "dst", "left").withColumn("inside", F.col("da").isNotNull() & (F.col("da") == F.coalesce("db", F.lit(""))))
    touched = both.select(F.explode(F.array_distinct(F.array("da", "db"))).alias("domain"), "inside").where("domain IS NOT NULL")
    cohesion = touched.groupBy("domain").agg(F.avg(F.col("inside").cast("double")).alias("cohesion"))
    size = members.groupBy("domain").agg(F.count("*").alias("members"))
    out = size.join(mode("title"), "domain", "left").join(mode("language"), "domain", "left").join(cohesion, "domain", "left")
    return Domains(members, out.select("domain", F.col("title").alias("name"), "language", "members", F.round(F.coalesce("cohesion", F.lit(1.0)), 6).alias("cohesion")))


def workflow_spread(steps: DataFrame, members: DataFrame) -> DataFrame:
    """``(workflow_id, domains, type)``: cross-domain if a workflow's steps touch more than one."""
    d = steps.join(members, steps["node"] == members["id"], "left").groupBy("workflow_id").agg(F.count_distinct("domain").alias("domains"))
    return d.withColumn("type", F.when(F.col("domains") > 1, "cross-domain").otherwise("intra-domain"))
