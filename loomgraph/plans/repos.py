"""Queries over source files and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import graph as G
from loomgraph.functions import names
from loomgraph.operators import preflight, tools
from loomgraph.plans.tools import oracle
from loomgraph.schema import table
from loomgraph.sources import graph_json, python_source

CUT = "2025-01-20"


def repo_metrics(spark: SparkSession, d: str) -> DataFrame:
    return preflight.metrics(table(spark, d, "source_files"))


def incremental_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files added or changed since a cut, by the hash of their text."""
    f = table(spark, d, "source_files")
    return preflight.changes(preflight.manifest(f.where(F.col("loaded_at") < F.lit(CUT).cast("timestamp_ntz"))), preflight.manifest(f))


def get_method_source(spark: SparkSession, d: str) -> DataFrame:
    return preflight.method_source(G.load(spark, d), table(spark, d, "source_files"))


def ui_calls(g: G.Graph) -> DataFrame:
    """``(ui, ui_type, client, line)``: calls of screens to what is named like a client; without any, imports of UI modules of such modules."""
    like = lambda c, words: F.coalesce(F.col(c), F.lit("")).rlike(f"(?i)({words})")
    t = g.joined
    screen = F.col("s_label").isin("Component", "Hook", "Function", "ArrowFunction", "AsyncFunction") & ((F.col("s_label") == "Component") | like("s_name", tools.ROUTE_NAME) | like("s_path", tools.UI_CALL_PATH))
    calls = t.where((F.col("type") == "CALLS") & screen & (like("d_name", tools.UI_CALL) | like("d_qn", tools.UI_CALL)))
    module = (F.col("s_label") == "Module") & (F.col("d_label") == "Module") & (like("s_path", tools.UI_MODULE_PATH) | like("s_qn", tools.UI_MODULE_NAME))
    imports = t.where((F.col("type") == "IMPORTS") & module & (like("d_name", tools.CLIENT_CALL) | like("d_qn", tools.CLIENT_CALL)))
    cols = [F.col("s_qn").alias("ui"), F.col("s_label").alias("ui_type"), F.col("d_qn").alias("client"), "line"]
    calls, imports = calls.select(*cols).distinct(), imports.select(*cols).distinct()
    return calls.unionByName(imports.where(calls.agg(F.count("*").alias("n")).scalar() == 0))


def ui_to_api(spark: SparkSession, d: str) -> DataFrame:
    """Calls of screens to clients, each with the first three endpoints whose names have a word in common with the client's."""
    g = G.load(spark, d)
    calls = ui_calls(g)
    ends = tools.call(g, "get_api_endpoints__named").select("endpoint")
    found = names.overlaps(calls.select("client"), "client", ends, "endpoint").groupBy("client").agg(F.array_join(F.array_sort(F.collect_list("endpoint")), ", ").alias("_found"))  # three at most
    return calls.join(found, "client", "left").select("ui", "ui_type", "client", "line", F.coalesce("_found", F.lit("no direct endpoint match")).alias("probable_endpoints"))


def export_dot(spark: SparkSession, d: str) -> DataFrame:
    return graph_json.to_dot(G.load(spark, d))


def export_graphml(spark: SparkSession, d: str) -> DataFrame:
    return graph_json.to_graphml(G.load(spark, d))


def export_json(spark: SparkSession, d: str) -> DataFrame:
    return graph_json.to_json(G.load(spark, d))


def python_source_edges(spark: SparkSession, d: str) -> DataFrame:
    """What the Python files' own syntax tells: containment, imports, inheritance, decorators and calls."""
    g = python_source.read(table(spark, d, "source_files"))
    return g.edges.select("src", "type", "dst", "line", "confidence")


QUERIES = {"python_source_edges": python_source_edges, "repo_metrics": repo_metrics, "incremental_changes": incremental_changes, "get_method_source": get_method_source, "get_ui_to_api_call_map": ui_to_api, "export_dot": export_dot, "export_graphml": export_graphml, "export_json": export_json}

_FAMILY = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in preflight.FAMILIES.items()) + " END"
_LATEST = "SELECT repo, path, code, row_number() OVER (PARTITION BY repo, path ORDER BY loaded_at DESC) AS k FROM source_files"

_WORDS = "list_filter(string_split_regex(lower(trim(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' +'), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(map(repr, names.STOP)) + "], w))"

SQL = {
    "get_ui_to_api_call_map": oracle(f"""WITH pairs AS (SELECT r.type, r.line, a.label AS al, a.name AS an, coalesce(a.path, '') AS ap, a.qn AS aq, b.label AS bl, concat(coalesce(b.name, ''), chr(10), coalesce(b.qn, '')) AS bt, b.qn AS bq FROM {{e}} r JOIN {{n}} a ON a.id = r.src JOIN {{n}} b ON b.id = r.dst),
u AS (SELECT DISTINCT aq AS ui, al AS ui_type, bq AS client, line FROM pairs WHERE type = 'CALLS' AND al IN ('Component', 'Hook', 'Function', 'ArrowFunction', 'AsyncFunction') AND (al = 'Component' OR an ~ '(?is).*(route|router|page|screen|layout|view).*' OR ap ~ '(?is).*(components|pages|screens|views|routes|app/|src/app).*') AND bt ~ '(?is).*(client|api|fetch|axios|gateway|service|query|request|get|post|put|delete).*'),
i AS (SELECT DISTINCT aq AS ui, al AS ui_type, bq AS client, line FROM pairs WHERE type = 'IMPORTS' AND al = 'Module' AND bl = 'Module' AND (ap ~ '(?is).*(components|pages|screens|views|routes|app/|src/app|admin-frontend|frontend).*' OR aq ~ '(?is).*(components|pages|screens|views|routes|app|admin-frontend|frontend).*') AND bt ~ '(?is).*(client|api|fetch|axios|gateway|service|query|request).*' AND NOT EXISTS (SELECT 1 FROM u)),
c AS (SELECT * FROM u UNION ALL SELECT * FROM i),
p AS (SELECT DISTINCT qn AS endpoint FROM {{n}} WHERE label IN ('Function', 'ArrowFunction', 'Method') AND regexp_matches(name, '(?i)(route|endpoint|handler|api_|get_|post_|put_|delete_)')),
x AS (SELECT DISTINCT client, unnest({_WORDS.replace('{c}', 'client')}) AS w FROM c), y AS (SELECT DISTINCT endpoint, unnest({_WORDS.replace('{c}', 'endpoint')}) AS w FROM p),
m AS (SELECT client, endpoint, row_number() OVER (PARTITION BY client ORDER BY endpoint) AS k FROM (SELECT DISTINCT client, endpoint FROM x JOIN y USING (w)) z),
f AS (SELECT client, string_agg(endpoint, ', ' ORDER BY endpoint) AS probable FROM m WHERE k <= 3 GROUP BY client)
SELECT c.ui, c.ui_type, c.client, c.line, coalesce(f.probable, 'no direct endpoint match') AS probable_endpoints FROM c LEFT JOIN f ON f.client = c.client"""),
    "repo_metrics": f"""WITH f AS (SELECT repo, path, code, {_FAMILY} AS family FROM (SELECT *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM ({_LATEST}) a WHERE k = 1 AND NOT regexp_matches(path, '{preflight.IGNORED_ANYWHERE}') AND NOT regexp_matches(path, '{preflight.IGNORED_AT_ROOT}')) b),
m AS (SELECT repo, count(*) AS files, CAST(sum(coalesce(len(list_filter(string_split_regex(code, '\\r?\\n'), lambda x: trim(replace(x, chr(9), ' ')) <> '')), 0)) AS BIGINT) AS loc, string_agg(DISTINCT family, ', ' ORDER BY family) AS families, count(DISTINCT family) AS n FROM f WHERE family IS NOT NULL GROUP BY repo),
s AS (SELECT *, CASE WHEN loc <= 10000 THEN 'small' WHEN loc <= 50000 THEN 'medium' WHEN loc <= 150000 THEN 'large' ELSE 'xlarge' END AS band,
  CASE WHEN loc <= 10000 THEN 0 WHEN loc <= 50000 THEN 1 WHEN loc <= 150000 THEN 2 ELSE 3 END + CASE WHEN files > 1000 THEN 1 ELSE 0 END + CASE WHEN n >= 3 THEN 1 ELSE 0 END + CASE WHEN loc > 50000 THEN 1 ELSE 0 END + CASE WHEN loc > 150000 THEN 1 ELSE 0 END AS risk_score FROM m)
SELECT repo, files, loc, families, band, risk_score, CASE WHEN risk_score <= 0 THEN 'low' WHEN risk_score = 1 THEN 'medium' WHEN risk_score = 2 THEN 'high' ELSE 'critical' END AS risk FROM s""",
    "incremental_changes": f"""WITH b AS (SELECT repo, path, sha256(coalesce(code, '')) AS h FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY loaded_at DESC) AS k FROM source_files WHERE loaded_at < TIMESTAMP '{CUT}') x WHERE k = 1),
a AS (SELECT repo, path, sha256(coalesce(code, '')) AS h FROM ({_LATEST}) x WHERE k = 1)
SELECT a.repo, a.path, CASE WHEN b.h IS NULL THEN 'added' ELSE 'changed' END AS change FROM a LEFT JOIN b ON b.repo = a.repo AND b.path = a.path WHERE b.h IS NULL OR b.h <> a.h""",
    "get_method_source": oracle("""WITH l AS (SELECT id, path, string_split(code, chr(10)) AS ls FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS k FROM source_files WHERE code IS NOT NULL) x WHERE k = 1),
j AS (SELECT m.qn, m.line, l.path, l.ls, least(coalesce(m.end_line, m.line + 80), m.line + 150, len(l.ls)) AS fin FROM {n} m JOIN (SELECT DISTINCT src, dst FROM {e} WHERE type = 'SOURCE_FILE') s ON s.src = m.id JOIN l ON l.id = s.dst WHERE m.label IN ('Method', 'Function', 'Constructor', 'ArrowFunction', 'Component', 'Hook', 'AsyncFunction') AND m.line > 0)
SELECT qn AS method, path, line AS start_line, fin AS end_line, array_to_string(list_slice(ls, line, fin), chr(10)) AS source FROM j WHERE line <= fin"""),
    "export_dot": oracle("SELECT 0 AS ord, 'digraph code {{' AS value UNION ALL SELECT 3, '}}' UNION ALL SELECT 1, '  \"' || replace(replace(id, '\\', '\\\\'), '\"', '\\\"') || '\" [label=\"' || replace(replace(coalesce(name, ''), '\\', '\\\\'), '\"', '\\\"') || '\", type=\"' || label || '\"];' FROM {n} UNION ALL SELECT 2, '  \"' || replace(replace(src, '\\', '\\\\'), '\"', '\\\"') || '\" -> \"' || replace(replace(dst, '\\', '\\\\'), '\"', '\\\"') || '\" [label=\"' || type || '\"];' FROM {e}"),
}
