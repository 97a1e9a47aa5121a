"""The property graph: nodes, edges and their joined form, as DataFrames and as SQL for the check."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.dialect import spark_sql
from loomgraph.schema import names_something, rel_type, table

#: Other spellings of a language.
ALIASES = {"py": "python", "python3": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "kt": "kotlin", "php8": "php"}
#: Language by label where none is given, and the normalised kind of labels and relationships.
LABEL_LANGUAGE = {"javascript": ["Module", "Function", "Component", "Hook", "JSXElement", "AsyncFunction", "Generator", "ArrowFunction"], "python": ["Decorator", "Comprehension"], "kotlin": ["DataClass", "SealedClass", "SealedInterface", "ObjectDecl", "CompanionObject", "ExtensionFunction", "SuspendFunction", "Property", "InitBlock", "TypeAlias", "Lambda"]}
NODE_KIND = {"CodeUnit": ["Package", "Module"], "Callable": ["Method", "Constructor", "Function", "ArrowFunction", "AsyncFunction", "Generator", "ExtensionFunction", "SuspendFunction", "Lambda"], "TypeLike": ["Class", "Interface", "Enum", "Record", "DataClass", "SealedClass", "SealedInterface", "ObjectDecl", "CompanionObject", "TypeAlias"], "DataMember": ["Field", "Parameter", "Property"], "UiComponent": ["Component", "Hook", "JSXElement"], "SourceFile": ["File"], "AnnotationLike": ["AnnotationType", "Decorator"], "Statement": ["Statement"], "Workflow": ["Workflow"], "Domain": ["Domain"]}
EDGE_KIND = {"Contains": ["CONTAINS"], "Calls": ["CALLS"], "DependsOn": ["IMPORTS", "OF_TYPE", "PROP_DEPENDENCY"], "TypeRelation": ["EXTENDS", "IMPLEMENTS", "OVERRIDES", "SEALED_SUBTYPE"], "UsesUi": ["RENDERS", "USES_HOOK"], "SemanticRelation": ["HAS_ANNOTATION", "DECORATES", "THROWS", "RETURNS", "HAS_PARAMETER", "EXPORTS", "SOURCE_FILE"], "FlowRelation": ["AST_CHILD", "CFG_NEXT", "DATA_FLOW"], "AbstractionRelation": ["WORKFLOW_STEP", "IN_DOMAIN"]}

NODE_COLUMNS = ["id", "label", "name", "qn", "repo", "path", "language", "visibility", "line", "end_line", "statement_type", "code", "external"]


def _case(of: str, groups: dict[str, list[str]], default: str) -> str:
    return f"CASE {' '.join(f'''WHEN {of} IN ({', '.join(repr(v) for v in vs)}) THEN {k!r}''' for k, vs in groups.items())} ELSE {default} END"


def _language(lang: str, label: str) -> str:
    by_alias = " ".join(f"WHEN {a!r} THEN {b!r}" for a, b in ALIASES.items())
    return f"CASE WHEN {lang} IS NULL THEN {_case(label, LABEL_LANGUAGE, repr('java'))} ELSE CASE lower(trim({lang})) {by_alias} ELSE lower(trim({lang})) END END"


#: The graph as SQL on the tables, for the check. A node is its latest version, unless that is a tombstone.
PREFIX = f"""v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, extracted_at DESC) AS rn FROM code_nodes WHERE id IS NOT NULL),
n AS (SELECT id, node_type AS label, name, qualified_name AS qn, repo, path, {_language('lang', 'node_type')} AS language, visibility, line_number AS line, end_line_number AS end_line, statement_type, code, FALSE AS external FROM v WHERE rn = 1 AND NOT is_deleted
  UNION ALL SELECT id, node_type, name, qualified_name, NULL, NULL, {_language('NULL', 'node_type')}, NULL, NULL, NULL, NULL, NULL, TRUE FROM external_symbols WHERE id NOT IN (SELECT id FROM v)),
e AS (SELECT rel_id, source_id AS src, target_id AS dst, upper(trim(rel_type)) AS type, line_number AS line, confidence FROM code_relationships WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)),
t AS (SELECT e.rel_id, e.type, e.line, e.confidence, {', '.join(f'{a}.{c} AS {a}_{c}' for a in ('s', 'd') for c in NODE_COLUMNS if c not in ('code',) or True)} FROM e JOIN n s ON s.id = e.src JOIN n d ON d.id = e.dst)"""


@dataclass
class Graph:
    """``nodes`` (one row an id) and ``edges`` (a multigraph: rel_id, src, dst, type, line, confidence), whose ends all exist."""

    nodes: DataFrame
    edges: DataFrame
    #: edges before those with a missing end are dropped, where that is known: joining them with the nodes drops them as well
    raw: DataFrame | None = field(default=None, repr=False)
    _joined: DataFrame | None = field(default=None, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @property
    def joined(self) -> DataFrame:
        """Edges with the columns of both nodes, as ``s_`` and ``d_``; only what a query uses is read and shuffled."""
        if self._joined is None:
            s = self.nodes.select(*[F.col(c).alias(f"s_{c}") for c in NODE_COLUMNS])
            d = self.nodes.select(*[F.col(c).alias(f"d_{c}") for c in NODE_COLUMNS])
            edges = self.edges if self.raw is None else self.raw
            self._joined = edges.join(s, F.col("src") == F.col("s_id")).join(d, F.col("dst") == F.col("d_id")).drop("src", "dst")
        return self._joined

    def sql(self, text: str) -> DataFrame:
        """A query over ``{n}``, ``{e}`` and ``{t}`` in the shared dialect."""
        frames = {k: v for k, v in (("n", self.nodes), ("e", self.edges)) if f"{{{k}}}" in text}
        if "{t}" in text:
            frames["t"] = self.joined
        return self.spark.sql(spark_sql(text), **frames)


def dedupe(nodes: DataFrame, order: list[str], first: bool = False) -> DataFrame:
    """One row an id: the last by ``order`` (or the first), as graph builders with either policy keep it.

    One aggregate a column, so that columns a query does not use are not read.
    ``order`` is to be total within an id but for repeated rows.
    """
    at = F.struct(*order)
    best = F.min_by if first else F.max_by
    return nodes.where("id IS NOT NULL").groupBy("id").agg(*[best(c, at).alias(c) for c in nodes.columns if c != "id"])


def merge(*graphs: Graph) -> Graph:
    """Nodes of all graphs (a later graph wins) and all their edges, repeated ones kept."""
    nodes = edges = None
    for i, g in enumerate(graphs):
        part = g.nodes.withColumn("_graph", F.lit(i))
        nodes = part if nodes is None else nodes.unionByName(part)
        edges = g.edges if edges is None else edges.unionByName(g.edges)
    return connected(dedupe(nodes, ["_graph"]).drop("_graph"), edges)


def connected(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Edges with a missing end are dropped, as the store does on saving."""
    ids = nodes.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    cols = ["rel_id", "src", "dst", "type", "line", "confidence"]
    return Graph(nodes, e.select(cols), edges.select(cols))


def load(spark: SparkSession, folder: str) -> Graph:
    """The graph of the tables code_nodes, external_symbols and code_relationships."""
    raw = table(spark, folder, "code_nodes")
    live = dedupe(raw, ["loaded_at", "extracted_at"]).where("NOT is_deleted")
    own = live.selectExpr("id", "node_type AS label", "name", "qualified_name AS qn", "repo", "path", f"{_language('lang', 'node_type')} AS language", "visibility", "line_number AS line", "end_line_number AS end_line", "statement_type", "code", "FALSE AS external")
    ext = table(spark, folder, "external_symbols").join(raw.select("id"), "id", "left_anti")
    none = "CAST(NULL AS STRING) AS {}".format
    ext = ext.selectExpr("id", "node_type AS label", "name", "qualified_name AS qn", none("repo"), none("path"), f"{_case('node_type', LABEL_LANGUAGE, repr('java'))} AS language", none("visibility"), "CAST(NULL AS BIGINT) AS line", "CAST(NULL AS BIGINT) AS end_line", none("statement_type"), none("code"), "TRUE AS external")
    rel = table(spark, folder, "code_relationships").where(names_something(F.col("source_id")) & names_something(F.col("target_id")))
    edges = rel.select("rel_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), rel_type(F.col("rel_type")).alias("type"), F.col("line_number").alias("line"), "confidence")
    return connected(own.unionByName(ext), edges)
