"""Queries in Cypher over the whole graph, with SQL."""

from __future__ import annotations

from loomgraph import graph as G
from loomgraph.cypher import query
from loomgraph.operators import registry
from loomgraph.plans.tools import oracle

TEXTS = {
    "cypher_uncalled": "MATCH (m:Method) WHERE m.visibility = 'public' AND NOT EXISTS { MATCH (x)-[:CALLS]->(m) } RETURN m.id AS id",
    "cypher_degrees": "MATCH (a)-[r:CALLS]->(b) WITH b, count(r) AS calls, count(DISTINCT a) AS callers WHERE callers >= 2 RETURN b.id AS id, calls, callers",
    "cypher_two_hops": "MATCH (c:Class)-[:CONTAINS]->(m:Method)-[r:CALLS*1..2]->(t) RETURN DISTINCT c.name AS class, t.name AS target",
    "cypher_owners": "MATCH (f:Field) OPTIONAL MATCH (c:Class)-[:CONTAINS]->(f) RETURN f.id AS field, c.name AS owner",
    "cypher_labels": "MATCH (n) RETURN label(n) AS label, count(*) AS n UNION ALL MATCH (a)-[r]->(b) RETURN type(r) AS label, count(*) AS n",
}


def _query(text: str):
    return lambda spark, d: query(G.load(spark, d), text)


def get_schema(spark, d):
    return registry.call(G.load(spark, d), "get_schema")


def frontend_summary(spark, d):
    return registry.call(G.load(spark, d), "get_frontend_architecture_summary")


QUERIES = {k: _query(v) for k, v in TEXTS.items()} | {"get_schema": get_schema, "get_frontend_architecture_summary": frontend_summary}

SQL = {
    "cypher_uncalled": oracle("SELECT id FROM {n} WHERE label = 'Method' AND visibility = 'public' AND id NOT IN (SELECT dst FROM {e} WHERE type = 'CALLS')"),
    "cypher_degrees": oracle("SELECT dst AS id, count(*) AS calls, count(DISTINCT src) AS callers FROM {e} WHERE type = 'CALLS' GROUP BY dst HAVING count(DISTINCT src) >= 2"),
    "cypher_two_hops": oracle("WITH m AS (SELECT s_name AS class, d_id AS id FROM {t} WHERE type = 'CONTAINS' AND s_label = 'Class' AND d_label = 'Method'), c AS (SELECT DISTINCT src, dst FROM {e} WHERE type = 'CALLS'), h AS (SELECT m.class, c.dst FROM m JOIN c ON c.src = m.id), r AS (SELECT * FROM h UNION ALL SELECT h.class, c.dst FROM h JOIN c ON c.src = h.dst) SELECT DISTINCT r.class, x.name AS target FROM r JOIN {n} x ON x.id = r.dst"),
    "cypher_owners": oracle("SELECT f.id AS field, o.s_name AS owner FROM {n} f LEFT JOIN {t} o ON o.d_id = f.id AND o.type = 'CONTAINS' AND o.s_label = 'Class' WHERE f.label = 'Field'"),
    "cypher_labels": oracle("SELECT label, count(*) AS n FROM {n} GROUP BY label UNION ALL SELECT type, count(*) FROM {e} GROUP BY type"),
}
