"""Clauses to DataFrames, left to right.

A node variable is a column with its id and, beside it, a column for each of its
properties that the query uses; nodes are joined only where a label or property
is asked for. A relationship variable has a column for each property used. A
variable-length relationship is unrolled to joins (walks: nodes and edges may
repeat). Patterns must hang together: a second part without a common variable
would be a cross join and is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.cypher.parser import AGGREGATES, CypherError, Parser
from loomgraph.graph import Graph

#: The names properties have in queries.
NODE_PROPS = {"id": "id", "label": "label", "name": "name", "qualifiedname": "qn", "qn": "qn", "path": "path", "language": "language", "visibility": "visibility", "linenumber": "line", "line": "line", "endlinenumber": "end_line", "statementtype": "statement_type", "code": "code", "external": "external", "repo": "repo"}
EDGE_PROPS = {"linenumber": "line", "line": "line", "confidence": "confidence", "type": "type", "kind": "type", "id": "rel_id"}
MOST_HOPS = 10


def _walk(e, out: set[tuple[str, str]]) -> None:
    """All (variable, property) of an expression."""
    if isinstance(e, tuple):
        if e and e[0] == "prop" and e[1][0] == "var":
            out.add((e[1][1], e[2].lower()))
        elif e and e[0] == "call" and e[1] in ("label", "labels", "type") and e[2] and e[2][0][0] == "var":
            out.add((e[2][0][1], "label" if e[1] != "type" else "type"))
        for x in e:
            _walk(x, out)
    elif isinstance(e, list):
        for x in e:
            _walk(x, out)
    elif isinstance(e, dict):
        for x in e.values():
            _walk(x, out)


class Compiler:
    def __init__(self, graph: Graph, params: dict):
        self.g, self.params = graph, params
        self.kinds: dict[str, str] = {}  # variable -> node, edge, path, value
        self.used: set[tuple[str, str]] = set()
        self.df: DataFrame | None = None

    def run(self, clauses: list[dict]) -> DataFrame:
        _walk(clauses, self.used)
        for c in clauses:
            getattr(self, "do_" + ("project" if c["op"] in ("with", "return") else c["op"]))(c)
        return self.df

    def props(self, var: str) -> list[str]:
        return sorted({p for v, p in self.used if v == var})

    # -- matching
    def node_frame(self, n: dict, as_: str) -> DataFrame:
        d = self.g.nodes
        if n["labels"]:
            d = d.where(F.col("label").isin(n["labels"]))
        for k, e in n["props"].items():
            d = d.where(F.col(self.node_prop(k.lower())) == self.value(e))
        return d.select(F.col("id").alias(as_), *[F.col(self.node_prop(p)).alias(f"{as_}.{p}") for p in self.props(as_)])

    def node_prop(self, p: str) -> str:
        if p not in NODE_PROPS:
            raise CypherError(f"nodes have no property {p}")
        return NODE_PROPS[p]

    def value(self, e) -> Column:
        if e[0] == "lit":
            return F.lit(e[1])
        if e[0] == "param":
            if e[1] not in self.params:
                raise CypherError(f"no value for ${e[1]}")
            return F.lit(self.params[e[1]])
        raise CypherError("a value is expected in a pattern")

    def bind(self, df: DataFrame, n: dict, bound: set[str]) -> DataFrame:
        """Labels and properties of a node whose id stands in its column."""
        var = n["var"]
        if var in bound:
            if n["labels"] or n["props"]:
                plain = {**n, "var": var}
                ids = self.node_frame(plain, var).select(F.col(f"`{var}`"))
                df = df.join(ids, var, "left_semi")
            return df
        if n["labels"] or n["props"] or self.props(var):
            df = df.join(self.node_frame(n, var), var)
        bound.add(var)
        return df

    def edges(self, r: dict) -> DataFrame:
        e = self.g.edges
        if r["types"]:
            e = e.where(F.col("type").isin(r["types"]))
        cols = [F.col(EDGE_PROPS[p]).alias(f"{r['var']}.{p}") for p in self.props(r["var"])] if r["var"] else []
        if r["var"] and not r["many"]:
            cols.append(F.col("rel_id").alias(r["var"]))
        if r["dir"] == "out":
            return e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), *cols, "confidence")
        if r["dir"] == "in":
            return e.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), *cols, "confidence")
        a, b = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), *cols, "confidence"), e.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), *cols, "confidence")
        return a.unionByName(b.where("_from <> _to"))

    def steps(self, df: DataFrame, r: dict, frm: str, edge_ok: Column | None) -> DataFrame:
        """``df`` with ``_to`` behind the relationship, and ``_way`` (ids after the start) where it may be long."""
        e = self.edges(r)
        if edge_ok is not None:
            e = e.where(edge_ok)
        e = e.drop("confidence")
        if not r["many"]:
            return df.join(e, F.col(f"`{frm}`") == F.col("_from")).drop("_from")
        if r["hi"] > MOST_HOPS:
            raise CypherError(f"at most {MOST_HOPS} hops")
        at = df.withColumn("_to", F.col(f"`{frm}`")).withColumn("_way", F.array().cast("array<string>"))
        e = e.select(F.col("_from").alias("_a"), F.col("_to").alias("_b"))
        out = at if r["lo"] == 0 else None
        for d in range(1, r["hi"] + 1):
            at = at.join(e, F.col("_to") == F.col("_a")).withColumn("_way", F.concat("_way", F.array("_b"))).withColumn("_to", F.col("_b")).drop("_a", "_b")
            if d >= r["lo"]:
                out = at if out is None else out.unionByName(at)
        return out

    def pattern(self, df: DataFrame | None, paths: list[dict], bound: set[str], where=None) -> DataFrame:
        left = list(paths)
        while left:
            p = next((p for p in left if df is None or any(n["var"] in bound for n in p["nodes"])), None)
            if p is None:
                raise CypherError("the parts of a pattern have no variable in common")
            left.remove(p)
            df = self.one_path(df, p, bound, where)
        return df

    def one_path(self, df: DataFrame | None, p: dict, bound: set[str], where) -> DataFrame:
        nodes, rels = p["nodes"], p["rels"]
        k = next((i for i, n in enumerate(nodes) if n["var"] in bound), 0)
        if df is None:
            df = self.node_frame(nodes[k], nodes[k]["var"])
            bound.add(nodes[k]["var"])
        else:
            df = self.bind(df, nodes[k], bound)
        self.kinds[nodes[k]["var"]] = "node"
        ok = self.edge_filter(p, where)
        way = F.array(F.col(f"`{nodes[k]['var']}`"))
        order = [(i, i + 1, rels[i]) for i in range(k, len(rels))] + [(i + 1, i, self.turned(rels[i])) for i in range(k - 1, -1, -1)]
        for a, b, r in order:
            frm, to = nodes[a]["var"], nodes[b]["var"]
            df = self.steps(df, r, frm, ok)
            if p["var"]:
                if k:
                    raise CypherError("a path variable needs its first node new or bound before")
                df = df.withColumn("_path", F.concat(F.col("_path") if "_path" in df.columns else way, F.col("_way") if r["many"] else F.array("_to")))
            df = df.drop("_way")
            if to in bound:
                df = df.where(F.col("_to") == F.col(f"`{to}`")).drop("_to")
            else:
                df = df.withColumnRenamed("_to", to)
                df = self.bind(df, nodes[b], bound)
            self.kinds[to] = "node"
            if r["var"]:
                self.kinds[r["var"]] = "edge"
        if p["var"]:
            df = df.withColumnRenamed("_path", p["var"]) if "_path" in df.columns else df.withColumn(p["var"], way)
            self.kinds[p["var"]] = "path"
        return df

    def turned(self, r: dict) -> dict:
        return {**r, "dir": {"in": "out", "out": "in", "both": "both"}[r["dir"]]}

    def edge_filter(self, p: dict, where) -> Column | None:
        """``ALL(e IN relationships(path) WHERE ...)`` of this path, to filter edges before they are expanded."""
        for c in self.conjuncts(where):
            if c[0] == "every" and c[2][0] == "call" and c[2][1] == "relationships" and c[2][2] == [("var", p["var"])]:
                return self.edge_condition(c[3], c[1])
        return None

    def edge_condition(self, e, var: str) -> Column:
        if e[0] == "prop" and e[1] == ("var", var):
            if e[2].lower() != "confidence":
                raise CypherError("along a path only confidence can be asked for")
            return F.col("confidence")
        if e[0] == "bin":
            return self.binary(e[1], self.edge_condition(e[2], var), self.edge_condition(e[3], var))
        if e[0] == "isnull":
            c = self.edge_condition(e[1], var)
            return c.isNotNull() if e[2] else c.isNull()
        if e[0] == "not":
            return ~self.edge_condition(e[1], var)
        return self.value(e)

    def conjuncts(self, e) -> list:
        if e is None:
            return []
        if e[0] == "bin" and e[1] == "and":
            return self.conjuncts(e[2]) + self.conjuncts(e[3])
        return [e]

    def filtered(self, df: DataFrame, where, bound: set[str]) -> DataFrame:
        for c in self.conjuncts(where):
            if c[0] == "every":
                continue
            turned = c[0] == "not" and c[1][0] == "exists"
            x = c[1] if turned else c
            if x[0] == "exists":
                inner: set[str] = set()
                sub = self.pattern(None, x[1], inner, x[2])
                sub = self.filtered(sub, x[2], inner)
                keys = [v for v in inner if v in bound]
                if not keys:
                    raise CypherError("EXISTS needs a variable of the query")
                df = df.join(sub.select(*[F.col(f"`{v}`") for v in keys]).distinct(), keys, "left_anti" if turned else "left_semi")
            else:
                df = df.where(self.expr(c))
        return df

    def do_match(self, c: dict) -> None:
        bound = {v for v, k in self.kinds.items() if k == "node"}
        if c["optional"] and self.df is not None:
            names = {n["var"] for p in c["paths"] for n in p["nodes"]}
            keys = sorted(names & bound)
            if not keys:
                raise CypherError("OPTIONAL MATCH needs a variable of the query")
            start = self.df.select(*[F.col(f"`{v}`") for v in keys]).distinct()
            extra = [x for x in self.df.columns if "." in x and x.split(".")[0] in keys]
            inner = set(keys)
            sub = self.pattern(start, c["paths"], inner, c["where"])
            for x in extra:  # conditions may ask for properties bound before
                v, p = x.split(".")
                if x not in sub.columns:
                    sub = sub.join(self.g.nodes.select(F.col("id").alias(v), F.col(self.node_prop(p)).alias(x)), v)
            sub = self.filtered(sub, c["where"], inner).drop(*extra)
            self.df = self.df.join(sub, keys, "left")
            return
        self.df = self.pattern(self.df, c["paths"], bound, c["where"])
        self.df = self.filtered(self.df, c["where"], bound)

    def do_unwind(self, c: dict) -> None:
        base = self.df if self.df is not None else self.g.spark.range(1).select()
        self.df = base.withColumn(c["as"], F.explode(self.expr(c["expr"])))
        self.kinds[c["as"]] = "value"

    # -- projections
    def has_aggregate(self, e) -> bool:
        return isinstance(e, tuple) and (e[:1] == ("call",) and e[1] in AGGREGATES or any(self.has_aggregate(x) for x in e)) or isinstance(e, list) and any(self.has_aggregate(x) for x in e)

    def do_project(self, c: dict) -> None:
        df, kinds = self.df if self.df is not None else self.g.spark.range(1).select(), {}
        keep: list[Column] = []
        groups, aggs = [], []
        for e, alias in c["items"]:
            if e[0] == "var" and self.kinds.get(e[1]) in ("node", "edge"):
                own = [x for x in df.columns if x == e[1] or x.startswith(e[1] + ".")] if c["op"] == "with" else [e[1]]
                cols = [F.col(f"`{x}`").alias(alias + x[len(e[1]) :]) for x in own]
                kinds[alias] = self.kinds[e[1]]
                groups += cols
                keep += cols
                for p in self.props(e[1]) if alias != e[1] else []:
                    self.used.add((alias, p))
            else:
                kinds[alias] = self.kinds.get(e[1], "value") if e[0] == "var" else "value"
                col = self.expr(e).alias(alias)
                (aggs if self.has_aggregate(e) else groups).append(col)
                keep.append(col)
        if aggs:
            df = df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)
        else:
            df = df.select(*keep)
        if c["distinct"]:
            df = df.distinct()
        if c["order"]:
            known = {a: e for e, a in c["items"]}
            keys = []
            for e, down in c["order"]:
                if e[0] == "var" and e[1] in known:
                    col = F.col(f"`{e[1]}`")
                else:
                    same = next((a for x, a in c["items"] if x == e), None)
                    if same is None:
                        raise CypherError("ORDER BY takes returned columns")
                    col = F.col(f"`{same}`")
                keys.append(col.desc_nulls_last() if down else col.asc_nulls_last())
            rest = [F.col(f"`{x}`").asc_nulls_last() for x in df.columns] if c["skip"] or c["limit"] else []
            df = df.orderBy(*keys, *rest)
        elif c["skip"] or c["limit"]:
            df = df.orderBy(*[F.col(f"`{x}`").asc_nulls_last() for x in df.columns])
        if c["skip"]:
            df = df.offset(int(c["skip"][1]))
        if c["limit"]:
            n = self.params[c["limit"][1]] if c["limit"][0] == "param" else c["limit"][1]
            df = df.limit(int(n))
        self.df, self.kinds = df, kinds
        if c["where"] is not None:
            self.df = self.filtered(df, c["where"], {v for v, k in kinds.items() if k == "node"})

    # -- expressions
    def binary(self, op: str, a: Column, b: Column) -> Column:
        return {
            "and": lambda: a & b, "or": lambda: a | b, "xor": lambda: (a | b) & ~(a & b), "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "contains": lambda: F.contains(a, b), "starts": lambda: F.startswith(a, b), "ends": lambda: F.endswith(a, b), "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
        }[op]()

    def expr(self, e) -> Column:
        k = e[0]
        if k in ("lit", "param"):
            return self.value(e)
        if k == "var":
            if e[1] not in self.kinds:
                raise CypherError(f"no variable {e[1]}")
            return F.col(f"`{e[1]}`")
        if k == "prop":
            if e[1][0] != "var":
                raise CypherError("a property of a variable is expected")
            kind = self.kinds.get(e[1][1])
            if kind not in ("node", "edge"):
                raise CypherError(f"no variable {e[1][1]}")
            if kind == "edge" and e[2].lower() not in EDGE_PROPS:
                raise CypherError(f"edges have no property {e[2]}")
            return F.col(f"`{e[1][1]}.{e[2].lower()}`")
        if k == "bin":
            if e[1] == "in" and e[3][0] == "list":
                return self.expr(e[2]).isin([self.value(x) for x in e[3][1]])
            if e[1] == "in":
                return F.array_contains(self.expr(e[3]), self.expr(e[2]))
            return self.binary(e[1], self.expr(e[2]), self.expr(e[3]))
        if k == "not":
            return ~self.expr(e[1])
        if k == "neg":
            return -self.expr(e[1])
        if k == "isnull":
            c = self.expr(e[1])
            return c.isNotNull() if e[2] else c.isNull()
        if k == "list":
            return F.array(*[self.expr(x) for x in e[1]])
        if k == "item":
            return F.get(self.expr(e[1]), self.expr(e[2]))
        if k == "slice":
            a = self.expr(e[1])
            lo = self.expr(e[2]) if e[2] is not None else F.lit(0)
            hi = self.expr(e[3]) if e[3] is not None else F.size(a)
            return F.slice(a, lo + 1, F.greatest(F.least(hi, F.size(a)) - lo, F.lit(0)))
        if k == "case":
            out = None
            for c, v in e[1]:
                out = F.when(self.expr(c), self.expr(v)) if out is None else out.when(self.expr(c), self.expr(v))
            return out.otherwise(self.expr(e[2]))
        if k == "call":
            return self.function(e[1], e[2], e[3])
        raise CypherError("EXISTS and ALL stand alone between ANDs of a WHERE")

    def function(self, f: str, args: list, distinct: bool) -> Column:
        if f == "count":
            if args == [("star",)]:
                return F.count("*")
            a = self.expr(args[0])
            return F.count_distinct(a) if distinct else F.count(a)
        if f in ("label", "labels", "type"):
            return F.col(f"`{args[0][1]}.{'type' if f == 'type' else 'label'}`")
        if f == "id" and args[0][0] == "var":
            return self.expr(args[0])
        x = [self.expr(a) for a in args]
        if f == "collect":
            return F.array_sort(F.collect_set(x[0]) if distinct else F.collect_list(x[0]))
        if f in ("sum", "min", "max", "avg"):
            if distinct:
                raise CypherError(f"{f}(DISTINCT) is outside the subset")
            return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[f](x[0])
        known = {"coalesce": lambda: F.coalesce(*x), "tolower": lambda: F.lower(x[0]), "toupper": lambda: F.upper(x[0]), "size": lambda: F.size(x[0]), "nodes": lambda: x[0], "length": lambda: F.size(x[0]) - 1, "trim": lambda: F.trim(x[0]), "tostring": lambda: x[0].cast("string"), "split": lambda: F.split(x[0], x[1]), "substring": lambda: F.substring(x[0], x[1] + 1, x[2]), "replace": lambda: F.replace(x[0], x[1], x[2])}
        if f not in known:
            raise CypherError(f"no function {f}")
        return known[f]()


def query(graph: Graph, text: str, **params) -> DataFrame:
    """The result of a read-only query; ``$name`` in it takes the parameter ``name``. Results have no cap but the query's own LIMIT."""
    out = None
    for how, clauses in Parser(text).query():
        df = Compiler(graph, params).run(clauses)
        out = df if out is None else out.unionByName(df)
        if how == "distinct":
            out = out.distinct()
    return out


def execute(graph: Graph, text: str, limit: int = 50, **params) -> DataFrame:
    """``query`` for a reader who wants a page: the first ``limit`` rows, which is kept between 1 and 200."""
    return query(graph, text, **params).limit(max(1, min(limit, 200)))
