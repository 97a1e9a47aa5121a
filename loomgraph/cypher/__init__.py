"""A read-only subset of Cypher, compiled to DataFrame plans."""

from loomgraph.cypher.compiler import CypherError, execute, query

__all__ = ["CypherError", "execute", "query"]
