"""Queries of the general data-processing operators (P1, P4, P5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import hierarchy as H
from loomgraph.operators import orphans as O
from loomgraph.operators import weighted as V
from loomgraph.schema import names_something, rel_type, table
from loomgraph.session import workspace

NAMED = "({c} IS NOT NULL AND {c} NOT IN ('', 'null', 'None'))"


def parent_links(spark: SparkSession, d: str) -> DataFrame:
    """``(tree, child, parent)`` of CONTAINS (parent to child) and EXTENDS (child to parent)."""
    r = table(spark, d, "code_relationships").withColumn("rel_type", rel_type(F.col("rel_type"))).where(F.col("rel_type").isin("CONTAINS", "EXTENDS"))
    down = F.col("rel_type") == "CONTAINS"
    child, parent = F.when(down, F.col("target_id")).otherwise(F.col("source_id")), F.when(down, F.col("source_id")).otherwise(F.col("target_id"))
    return H.latest_parent(r, [F.col("loaded_at"), F.col("rel_id")], F.col("rel_type"), child, parent)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return H.roots(parent_links(spark, d)).select(F.col("tree").alias("rel_type"), F.col("child").alias("node_id"), F.col("root").alias("root_id"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = H.hierarchy(parent_links(spark, d))
    return h.select(F.col("tree").alias("rel_type"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", " > ").alias("path"), "cyclic", "in_cycle")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    x = H.descendants(H.hierarchy(parent_links(spark, d)))
    return x.select(F.col("tree").alias("rel_type"), F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


_LINKS = f"""links AS (
  SELECT rel_type, child, parent FROM (
    SELECT rel_type, child, parent, row_number() OVER (PARTITION BY rel_type, child ORDER BY loaded_at DESC, rel_id DESC) AS rn FROM (
      SELECT upper(trim(rel_type)) AS rel_type, CASE WHEN upper(trim(rel_type)) = 'CONTAINS' THEN target_id ELSE source_id END AS child,
             CASE WHEN upper(trim(rel_type)) = 'CONTAINS' THEN source_id ELSE target_id END AS parent, loaded_at, rel_id
      FROM code_relationships WHERE upper(trim(rel_type)) IN ('CONTAINS', 'EXTENDS')) x
    WHERE {NAMED.format(c='child')} AND {NAMED.format(c='parent')}) y WHERE rn = 1),
walk AS (
  SELECT rel_type, child AS node, child AS cur, [child] AS path, FALSE AS looped FROM links
  UNION ALL
  SELECT w.rel_type, w.node, l.parent, list_append(w.path, l.parent), list_contains(w.path, l.parent)
  FROM walk w JOIN links l ON l.rel_type = w.rel_type AND l.child = w.cur WHERE NOT w.looped),
ends AS (
  SELECT w.rel_type, w.node, w.cur, w.path, w.looped,
         CASE WHEN w.looped THEN list_aggregate(list_slice(w.path, list_position(w.path, w.cur), len(w.path)), 'min') ELSE w.cur END AS root
  FROM walk w LEFT JOIN links l ON l.rel_type = w.rel_type AND l.child = w.cur WHERE w.looped OR l.child IS NULL)"""

_P1_TREE = f"""WITH RECURSIVE {_LINKS},
upward AS (
  SELECT rel_type, node, root, looped,
         CASE WHEN looped THEN list_slice(path, 1, CASE WHEN node = root THEN 1 ELSE list_position(path, root) END) ELSE path END AS up,
         looped AND (node = cur) AS ring
  FROM ends),
tops AS (SELECT DISTINCT rel_type, root AS node, root, FALSE AS looped, [root] AS up, FALSE AS ring FROM upward WHERE NOT looped),
nodes AS (SELECT * FROM upward UNION ALL SELECT * FROM tops)
"""

P4_STATS = """SELECT target_id, count(*) AS rel_rows, count(DISTINCT CASE WHEN source_id NOT IN ('', 'null', 'None') THEN source_id END) AS distinct_sources, round(avg(confidence), 6) AS mean_confidence
FROM code_relationships WHERE target_id IS NOT NULL AND target_id NOT IN ('', 'null', 'None') GROUP BY target_id"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "code_relationships").where(names_something(F.col("target_id")))
    return V.compress(r, F.col("target_id"), F.when(names_something(F.col("source_id")), F.col("source_id")), F.col("confidence"))


def p4_targets(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct sources that name something and mean confidence of every target."""
    k = V.per_key(_targets(spark, d))
    return k.select(F.col("key").alias("target_id"), F.col("rows").alias("rel_rows"), F.col("distinct_values").alias("distinct_sources"), F.round("mean", 6).alias("mean_confidence"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that stand in at least 1 % of all rows; the total is a count of the table's metadata, not of gathered rows."""
    every = table(spark, d, "code_relationships").agg(F.count("*").alias("n"))
    return p4_targets(spark, d).where(F.col("rel_rows") * 100 >= every.scalar()).select("target_id")


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent line (mode) of each target and exact median and 90th percentile of its line numbers."""
    r = table(spark, d, "code_relationships").where(names_something(F.col("target_id")))
    w = materialized = V.compress(r, F.col("target_id"), F.col("line_number"))
    top = V.per_key(materialized).select("key", F.col("top_value").alias("mode_line"), F.col("top_rows").alias("mode_rows"))
    p = V.percentiles(w, [0.5, 0.9]).groupBy("key").agg(F.max(F.when(F.col("share") == 0.5, F.col("value"))).alias("median_line"), F.max(F.when(F.col("share") == 0.9, F.col("value"))).alias("p90_line"))
    return top.join(p, "key", "left").select(F.col("key").alias("target_id"), "mode_line", "mode_rows", "median_line", "p90_line")


def _arrivals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return O.versions(table(spark, d, "code_nodes")), O.ends(table(spark, d, "code_relationships"), table(spark, d, "external_symbols"))


def _arrived(spark: SparkSession, d: str, payload: list[str]) -> DataFrame:
    """Both ends of all relationships against all node versions, as one batch of arrivals."""
    parents, refs = _arrivals(spark, d)
    store = O.OrphanStore(spark, workspace(spark, "orphans"), ["side"])
    store.put(0, parents, refs.withColumn("month", F.date_format("at", "yyyy-MM")).select("key", "at", *payload), payload)
    return store.references().where("orphan")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _arrived(spark, d, ["rel_id", "side"]).select("rel_id", "side")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _arrived(spark, d, ["rel_id", "side", "repo", "month"]).groupBy("side", "repo", "month").agg(F.count("*").alias("orphans"))


def p5_snapshots(spark: SparkSession, d: str, cuts: tuple[str, ...] = ("2025-04-01", "2025-07-01", "2025-10-01")) -> DataFrame:
    """The incremental run: arrivals in batches up to each cut and after the last; the counts of each snapshot by side."""
    parents, refs = _arrivals(spark, d)
    store = O.OrphanStore(spark, workspace(spark, "orphans"), ["side"])
    ends = [*cuts, "end"]
    for number, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):
        span = F.lit(True)
        if lo:
            span &= F.col("at") >= F.lit(lo).cast("timestamp_ntz")
        if hi:
            span &= F.col("at") < F.lit(hi).cast("timestamp_ntz")
        store.put(number, parents.where(span), refs.where(span), ["rel_id", "side"])
    return store.snapshots().select(F.element_at(F.array(*map(F.lit, ends)), F.col("batch") + 1).alias("up_to"), "side", *O.COUNTED)


_ENDS = f"""refs AS (
  SELECT rel_id, side, id, repo, loaded_at FROM (
    SELECT rel_id, 'source' AS side, source_id AS id, repo, loaded_at FROM code_relationships
    UNION ALL SELECT rel_id, 'target', target_id, repo, loaded_at FROM code_relationships) x
  WHERE {NAMED.format(c='id')} AND id NOT IN (SELECT id FROM external_symbols)),
seen AS (
  SELECT r.rel_id, r.side, r.repo, r.loaded_at, arg_max(n.is_deleted, n.loaded_at) AS gone
  FROM refs r LEFT JOIN code_nodes n ON n.id = r.id AND n.loaded_at <= r.loaded_at GROUP BY ALL),
orphans AS (SELECT * FROM seen WHERE gone IS NULL OR gone)"""


def _snapshot_sql() -> str:
    parts = []
    for hi in ("2025-04-01", "2025-07-01", "2025-10-01", "end"):
        upto = "TRUE" if hi == "end" else f"{{t}}.loaded_at < TIMESTAMP '{hi}'"
        parts.append(f"""SELECT '{hi}' AS up_to, side, count(*) AS refs, CAST(sum(o) AS BIGINT) AS orphans, CAST(sum(w) AS BIGINT) AS open_now, CAST(sum(CASE WHEN o = 1 AND w = 0 THEN 1 ELSE 0 END) AS BIGINT) AS resolved, CAST(sum(CASE WHEN o = 0 AND w = 1 THEN 1 ELSE 0 END) AS BIGINT) AS reopened FROM (
  SELECT r.side, CASE WHEN s.gone IS NULL OR s.gone THEN 1 ELSE 0 END AS o, CASE WHEN l.gone IS NULL OR l.gone THEN 1 ELSE 0 END AS w
  FROM refs r JOIN seen s ON s.rel_id = r.rel_id AND s.side = r.side
  LEFT JOIN (SELECT n.id, arg_max(n.is_deleted, n.loaded_at) AS gone FROM code_nodes n WHERE {upto.format(t='n')} GROUP BY n.id) l ON l.id = r.id
  WHERE {upto.format(t='r')}) z GROUP BY side""")
    return f"WITH {_ENDS} " + " UNION ALL ".join(parts)


QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants, "p4_found": p4_found, "p4_targets": p4_targets, "p4_lines": p4_lines, "p5_found": p5_found, "p5_counts": p5_counts, "p5_snapshots": p5_snapshots}

SQL = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT DISTINCT rel_type, node AS node_id, root AS root_id FROM ends",
    "p1_hierarchy": _P1_TREE
    + """, bad AS (SELECT DISTINCT rel_type, root FROM upward WHERE looped)
SELECT n.rel_type, n.node AS node_id, n.root AS root_id, CAST(len(n.up) - 1 AS BIGINT) AS depth, array_to_string(list_reverse(n.up), ' > ') AS path, b.root IS NOT NULL AS cyclic, n.ring AS in_cycle
FROM nodes n LEFT JOIN bad b ON b.rel_type = n.rel_type AND b.root = n.root""",
    "p1_descendants": _P1_TREE + "SELECT rel_type, up[i] AS node_id, node AS descendant_id, CAST(i - 1 AS BIGINT) AS distance FROM (SELECT rel_type, node, up, unnest(range(2, len(up) + 1)) AS i FROM nodes) z",
    "p4_found": f"SELECT target_id FROM ({P4_STATS}) z WHERE rel_rows * 100 >= (SELECT count(*) FROM code_relationships)",
    "p4_targets": P4_STATS,
    "p4_lines": """WITH r AS (SELECT target_id, line_number AS v FROM code_relationships WHERE target_id IS NOT NULL AND target_id NOT IN ('', 'null', 'None')),
f AS (SELECT target_id, v, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY 1, 2),
m AS (SELECT target_id, v, n, row_number() OVER (PARTITION BY target_id ORDER BY n DESC, v) AS rn FROM f),
p AS (SELECT target_id, CAST(quantile_disc(v, 0.5) AS BIGINT) AS median_line, CAST(quantile_disc(v, 0.9) AS BIGINT) AS p90_line FROM r GROUP BY 1)
SELECT t.target_id, m.v AS mode_line, m.n AS mode_rows, p.median_line, p.p90_line FROM (SELECT DISTINCT target_id FROM r) t LEFT JOIN m ON m.target_id = t.target_id AND m.rn = 1 LEFT JOIN p ON p.target_id = t.target_id""",
    "p5_found": f"WITH {_ENDS} SELECT rel_id, side FROM orphans",
    "p5_counts": f"WITH {_ENDS} SELECT side, repo, strftime(loaded_at, '%Y-%m') AS month, count(*) AS orphans FROM orphans GROUP BY ALL",
    "p5_snapshots": _snapshot_sql(),
}
