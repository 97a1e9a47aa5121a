"""Graph files: the interchange JSON (both spellings of an edge's ends), partitioned Parquet, and the exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import NODE_COLUMNS, Graph, connected, dedupe

_PROPS = "properties: map<string, string>"
SCHEMA = f"nodes array<struct<id: string, type: string, name: string, qualifiedName: string, {_PROPS}>>, relationships array<struct<sourceId: string, targetId: string, source: string, target: string, type: string, {_PROPS}>>"


def _null(col: str):
    """Writers put null properties as the texts None and null."""
    c = F.col(col)
    return F.when(~c.isin("None", "null"), c)


def frames(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of rows of ``SCHEMA``; unknown properties are kept in none of the columns. Nodes without id and edges without an end are left out."""
    n = raw.select(F.explode("nodes").alias("_")).select("_.*")
    p = lambda k: _null(f"properties.`{k}`")
    nodes = n.select(
        "id", F.col("type").alias("label"), "name", F.col("qualifiedName").alias("qn"), p("repo").alias("repo"), p("path").alias("path"), p("language").alias("language"), p("visibility").alias("visibility"), p("lineNumber").cast("bigint").alias("line"), p("endLineNumber").cast("bigint").alias("end_line"),
        p("statementType").alias("statement_type"), p("code").alias("code"), F.coalesce(p("external").cast("boolean"), F.lit(False)).alias("external"),
    ).where("id IS NOT NULL")
    e = raw.select(F.explode("relationships").alias("_")).select("_.*")
    sure = F.coalesce(p("confidence").cast("double"), F.when(p("resolved") == "true", F.lit(0.9)).when(p("resolved") == "false", F.lit(0.5)))
    edges = e.select(F.coalesce("sourceId", "source").alias("src"), F.coalesce("targetId", "target").alias("dst"), F.upper(F.trim("type")).alias("type"), p("lineNumber").cast("bigint").alias("line"), sure.alias("confidence")).where("src IS NOT NULL AND dst IS NOT NULL")
    return nodes, edges.withColumn("rel_id", F.xxhash64("src", "dst", "type", "line"))


def read(spark: SparkSession, path: str, first: bool = False) -> Graph:
    """Graph of all JSON files at ``path``; of nodes with one id the last in file order is kept (or the first)."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True)
    nodes, edges = frames(raw)
    at = nodes.withColumn("_at", F.monotonically_increasing_id())
    return connected(dedupe(at, ["_at"], first).drop("_at"), edges)


def save(graph: Graph, path: str) -> None:
    """Nodes partitioned by label, edges by type: a label or type in a query prunes partitions."""
    graph.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def open_saved(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes").select(NODE_COLUMNS), spark.read.parquet(f"{path}/edges").select("rel_id", "src", "dst", "type", "line", "confidence"))


def to_json(graph: Graph) -> DataFrame:
    """One JSON text a node and an edge (``value``), null values left out."""
    n = graph.nodes.select(F.to_json(F.struct("id", F.col("label").alias("type"), "name", F.col("qn").alias("qualifiedName"), "path", "language", "visibility", F.col("line").alias("lineNumber"))).alias("value"))
    e = graph.edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type", F.col("line").alias("lineNumber"), "confidence")).alias("value"))
    return n.unionByName(e)


def _dot(c: str):
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\\", r"\\\\"), '"', r'\\"')


def to_dot(graph: Graph) -> DataFrame:
    """Lines of a DOT graph (``ord``, ``value``); ``ord`` orders head, nodes, edges and end."""
    spark = graph.spark
    head = spark.createDataFrame([(0, "digraph code {"), (3, "}")], "ord int, value string")
    n = graph.nodes.select(F.lit(1).alias("ord"), F.concat(F.lit('  "'), _dot("id"), F.lit('" [label="'), _dot("name"), F.lit('", type="'), F.col("label"), F.lit('"];')).alias("value"))
    e = graph.edges.select(F.lit(2).alias("ord"), F.concat(F.lit('  "'), _dot("src"), F.lit('" -> "'), _dot("dst"), F.lit('" [label="'), F.col("type"), F.lit('"];')).alias("value"))
    return head.unionByName(n).unionByName(e)


def _xml(c: str):
    out = F.coalesce(F.col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def to_graphml(graph: Graph) -> DataFrame:
    spark = graph.spark
    head = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="l" for="all" attr.name="type" attr.type="string"/><key id="n" for="node" attr.name="name" attr.type="string"/><graph edgedefault="directed">'), (3, "</graph></graphml>")], "ord int, value string")
    n = graph.nodes.select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), _xml("id"), F.lit('"><data key="l">'), _xml("label"), F.lit('</data><data key="n">'), _xml("name"), F.lit("</data></node>")).alias("value"))
    e = graph.edges.select(F.lit(2).alias("ord"), F.concat(F.lit('<edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('"><data key="l">'), _xml("type"), F.lit("</data></edge>")).alias("value"))
    return head.unionByName(n).unionByName(e)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in their order over several text files, none gathered in one task."""
    lines.repartitionByRange("ord", "value").sortWithinPartitions("ord", "value").select("value").write.mode("overwrite").text(path)


def render(rows: DataFrame, max_rows: int = 150, max_chars: int = 8000) -> DataFrame:
    """Result rows as JSON lines with nulls left out, up to max_rows rows and max_chars characters: what a tool shows."""
    from pyspark.sql import Window

    shown = rows.orderBy(*[F.col(c).asc_nulls_last() for c in rows.columns]).limit(max_rows).select(F.to_json(F.struct("*")).alias("value"))
    at = shown.withColumn("_at", F.monotonically_increasing_id())
    return at.withColumn("_sum", F.sum(F.length("value") + 1).over(Window.partitionBy(F.lit(0)).orderBy("_at"))).where(F.col("_sum") <= max_chars).orderBy("_at").select("value")
