"""Queries of the graph tools and their SQL."""

from __future__ import annotations

from loomgraph import graph as G
from loomgraph.functions.dialect import duck_sql
from loomgraph.operators import tools
from loomgraph.plans import tool_sql


def _query(name: str):
    return lambda spark, d: tools.call(G.load(spark, d), name)


def oracle(text: str) -> str:
    """The text over the tables: the graph as common table expressions before it."""
    body = duck_sql(text.format(n="n", e="e", t="t"))
    head, rest = ("WITH ", body) if not body.lstrip().upper().startswith("WITH ") else ("WITH ", body.lstrip()[5:])
    return f"{head}{G.PREFIX}{', ' if rest is not body else ' '}{rest}"


QUERIES = {name: _query(name) for name in tools.SECTIONS}
#: Written apart where ``tool_sql`` has a text; for the rest the operator's own text, which checks the plan and not the reading.
SQL = {name: oracle(tool_sql.SQL.get(name, text)) for name, text in tools.SECTIONS.items()}
