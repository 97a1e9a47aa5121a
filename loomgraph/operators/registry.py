"""Operators by name: listing, calling, batches, and adding one's own."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import EDGE_KIND, NODE_COLUMNS, NODE_KIND, Graph
from loomgraph.operators import tools

_OWN: dict[str, Callable[..., DataFrame]] = {}


def operator(name: str) -> Callable:
    """Registers ``fn(graph, **parameters) -> DataFrame`` under a name."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _OWN[name] = fn
        return fn

    return add


def names() -> list[str]:
    return sorted({*_OWN, *tools.SECTIONS})


def describe(name: str) -> dict:
    """Name, summary and parameters, as a tool listing shows them."""
    fn = _OWN.get(name)
    if fn:
        return {"name": name, "summary": (inspect.getdoc(fn) or "").split("\n")[0], "parameters": [p for p in inspect.signature(fn).parameters if p != "graph"]}
    return {"name": name, "summary": tools.SECTIONS[name].split(" FROM ")[0][:120], "parameters": ["limit", "any column"]}


def call(graph: Graph, name: str, **parameters) -> DataFrame:
    return _OWN[name](graph, **parameters) if name in _OWN else tools.call(graph, name, **parameters)


def batch(graph: Graph, requests: Iterable[tuple[str, dict]]) -> list[tuple[str, DataFrame | str]]:
    """Calls one after the other on one graph; an unknown operator gives its message in place of rows."""
    out: list[tuple[str, DataFrame | str]] = []
    for name, parameters in requests:
        try:
            out.append((name, call(graph, name, **parameters)))
        except KeyError as e:
            out.append((name, str(e.args[0])))
    return out


@operator("get_schema")
def schema(graph: Graph) -> DataFrame:
    """Labels, relationship types and properties of the model, as rows."""
    rows = [("label", v, k) for k, vs in NODE_KIND.items() for v in vs] + [("relationship", v, k) for k, vs in EDGE_KIND.items() for v in vs] + [("property", c, "node") for c in NODE_COLUMNS] + [("property", c, "edge") for c in ("rel_id", "type", "line", "confidence")]
    return graph.spark.createDataFrame(rows, "what string, name string, kind string")


@operator("execute_cypher")
def execute_cypher(graph: Graph, query: str, limit: int = 50) -> DataFrame:
    """A read-only Cypher query; at most ``limit`` rows (1 to 200)."""
    from loomgraph.cypher import execute

    return execute(graph, query, limit)


def _tagged(section: str, df: DataFrame, item: str, detail: str, n: str = "CAST(NULL AS BIGINT)") -> DataFrame:
    return df.selectExpr(f"'{section}' AS section", f"{item} AS item", f"CAST({detail} AS STRING) AS detail", f"CAST({n} AS BIGINT) AS n")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@operator("get_architecture_summary")
def architecture_summary(graph: Graph) -> DataFrame:
    """Schema, languages, counts, packages with their dependencies, and layers, as tagged rows."""
    call_ = lambda name: tools.call(graph, name)
    return _union([
        _tagged("schema", schema(graph), "name", "concat(what, ' ', kind)"),
        _tagged("language", call_("get_architecture_summary__languages"), "language", "NULL", "n"),
        _tagged("summary", call_("summary"), "kind", "what", "n"),
        _tagged("package", call_("get_architecture_overview__packages"), "package", "type", "n"),
        _tagged("dependency", call_("get_architecture_overview__dependencies"), "from_pkg", "to_pkg", "weight"),
        _tagged("files", call_("get_architecture_overview__files"), "'files'", "NULL", "files"),
        _tagged("layer by annotation", call_("get_layer_classification__annotation"), "class", "concat(layer, ' @', annotation)"),
        _tagged("layer by name", call_("get_layer_classification__suffix"), "class", "concat(layer, ' ', type)"),
    ])


@operator("get_module_deep_dive")
def deep_dive(graph: Graph, package: str) -> DataFrame:
    """Contents and interactions of one package, and the ten most coupled nodes of the graph, as tagged rows."""
    return _union([
        _tagged("contents", tools.call(graph, "get_package_contents", package=package), "qn", "type"),
        _tagged("calls", tools.call(graph, "get_module_interactions__outgoing", module=package), "target_module", "sample_callers", "call_count"),
        _tagged("called by", tools.call(graph, "get_module_interactions__incoming", module=package), "source_module", "sample_targets", "call_count"),
        _tagged("inherits from", tools.call(graph, "get_module_interactions__inheritance", module=package), "child", "parent"),
        _tagged("hotspot", tools.call(graph, "get_hotspots__coupling").orderBy(F.desc("total_coupling"), "id").limit(10), "id", "concat(out_degree, ' out, ', in_degree, ' in')", "total_coupling"),
    ])


FRONTEND = {
    "get_route_map__candidates": ("name", "path"), "get_route_component_map": ("entry", "child_component"), "get_component_boundary_map": ("parent", "child"), "get_component_tree__roots": ("root", "path"), "get_hook_usage_graph": ("consumer", "target"),
    "get_state_management_summary__stores": ("name", "path"), "get_state_ownership_map__consumers": ("consumer", "state_owner"), "get_api_client_summary__clients": ("name", "path"), "get_api_client_summary__calls": ("caller", "target"),
}


@operator("get_frontend_architecture_summary")
def frontend(graph: Graph) -> DataFrame:
    """The rows of the front-end sections, each tagged with its section."""
    return _union([_tagged(name, tools.call(graph, name), *cols) for name, cols in FRONTEND.items()])
