"""Python source files to a graph, by the interpreter's own syntax tree, batch by batch where the files lie."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph, connected, dedupe

_OUT = pa.schema([("kind", pa.string()), ("id", pa.string()), ("label", pa.string()), ("name", pa.string()), ("qn", pa.string()), ("repo", pa.string()), ("path", pa.string()), ("line", pa.int64()), ("end_line", pa.int64()), ("dst", pa.string()), ("confidence", pa.float64())])
_DDL = "kind string, id string, label string, name string, qn string, repo string, path string, line long, end_line long, dst string, confidence double"


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def facts(repo: str | None, path: str, code: str) -> list[tuple]:
    """``_facts`` with ids that name the repository, where there is one: equal paths of two repositories are two nodes."""
    if not repo:
        return _facts(repo, path, code)

    def own(key: str) -> str:
        kind, _, rest = key.partition(":")
        return f"{kind}:{repo}:{rest}"

    return [(r[0], own(r[1]), *r[2:9], own(r[9]), r[10]) if r[0] == "edge" else (r[0], own(r[1]), *r[2:]) for r in _facts(repo, path, code)]


def _facts(repo: str | None, path: str, code: str) -> list[tuple]:
    """Nodes and edges of one file; a text that does not parse gives its file node only.

    Calls are resolved by name within the file (0.95) or over its imports (0.9).
    """
    module = path.rsplit(".", 1)[0].replace("/", ".")
    top = f"module:{module}"
    out = [("node", f"file:{path}", "File", path.rsplit("/", 1)[-1], path, repo, path, None, None, None, None)]
    try:
        tree = ast.parse(code.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError):
        return out
    out.append(("node", top, "Module", module.rsplit(".", 1)[-1], module, repo, path, 1, None, None, None))
    out.append(("edge", top, "SOURCE_FILE", None, None, None, None, None, None, f"file:{path}", None))
    known: dict[str, str] = {}
    imported: dict[str, str] = {}
    scopes: list[tuple[ast.AST, str, str, str]] = [(tree, top, module, "")]
    bodies: list[tuple[str, ast.AST, str]] = []

    def edge(src: str, type_: str, dst: str, line: int | None, sure: float | None = None) -> None:
        out.append(("edge", src, type_, None, None, None, None, line, None, dst, sure))

    while scopes:
        scope, owner, qn, cls = scopes.pop()
        for node in ast.iter_child_nodes(scope):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = f"{qn}.{node.name}"
                is_class = isinstance(node, ast.ClassDef)
                label = "Class" if is_class else "Method" if cls else "AsyncFunction" if isinstance(node, ast.AsyncFunctionDef) else "Function"
                key = f"{label.lower()}:{own}"
                out.append(("node", key, label, node.name, own, repo, path, node.lineno, node.end_lineno, None, None))
                edge(owner, "CONTAINS", key, node.lineno)
                edge(key, "SOURCE_FILE", f"file:{path}", None)
                known[f"{cls}.{node.name}" if cls else node.name] = key
                for d in node.decorator_list:
                    name = _dotted(d.func if isinstance(d, ast.Call) else d)
                    if name:
                        out.append(("node", f"decorator:{name}", "Decorator", name.rsplit(".", 1)[-1], name, None, None, None, None, None, None))
                        edge(f"decorator:{name}", "DECORATES", key, d.lineno)
                for b in node.bases if is_class else ():
                    bodies.append((key, b, "base"))
                if not is_class:
                    bodies.append((key, node, cls))
                scopes.append((node, key, own, node.name if is_class else ""))
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                for a in node.names:
                    target = a.name if isinstance(node, ast.Import) else f"{node.module or ''}.{a.name}".strip(".")
                    imported[a.asname or a.name.split(".")[0]] = target
                    out.append(("node", f"module:{target}", "Module", target.rsplit(".", 1)[-1], target, None, None, None, None, None, None))
                    edge(top, "IMPORTS", f"module:{target}", node.lineno)
    for key, node, cls in bodies:
        if cls == "base":
            name = _dotted(node)
            if name in known:
                edge(key, "EXTENDS", known[name], node.lineno)
            elif name and name.split(".")[0] in imported:
                edge(key, "EXTENDS", f"module:{imported[name.split('.')[0]]}", node.lineno)
            continue
        for c in ast.walk(node):
            if isinstance(c, ast.Call) and (name := _dotted(c.func)):
                own = f"{cls}.{name[5:]}" if cls and name.startswith("self.") else name
                if own in known:
                    edge(key, "CALLS", known[own], c.lineno, 0.95)
                elif name.split(".")[0] in imported:
                    edge(key, "CALLS", f"module:{imported[name.split('.')[0]]}", c.lineno, 0.9)
    return out


def read(files: DataFrame) -> Graph:
    """The graph of the Python files among ``files`` (repo, path, code); null texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for repo, path, code in zip(*(b.column(i).to_pylist() for i in range(3))) for r in facts(repo, path, code)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT)], schema=_OUT)

    own = files.select("repo", "path", "code").where(F.col("code").isNotNull() & F.col("path").rlike(r"\.pyi?$"))
    raw = own.mapInArrow(run, _DDL)
    none = F.lit(None).cast("string")
    nodes = raw.where("kind = 'node'").select("id", "label", "name", "qn", "repo", "path", F.lit("python").alias("language"), none.alias("visibility"), "line", "end_line", none.alias("statement_type"), none.alias("code"), F.col("path").isNull().alias("external"))
    edges = raw.where("kind = 'edge'").select(F.col("id").alias("src"), "dst", F.col("label").alias("type"), "line", "confidence").withColumn("rel_id", F.xxhash64("src", "dst", "type", "line"))
    return connected(dedupe(nodes.withColumn("_own", ~F.col("external")), ["_own", "line"]).drop("_own"), edges)
