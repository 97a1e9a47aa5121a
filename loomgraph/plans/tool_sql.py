"""SQL of tool sections, written from what each tool is asked, apart from the operators' texts.

``{n}`` are nodes and ``{e}`` edges, in DuckDB's dialect; ``[[a TYPE b]]`` is a
join of edges r of a type with their ends a and b.
"""

from __future__ import annotations

import re

_SURE = "coalesce(r.confidence, 1) >= 0.9"


def _join(m: re.Match) -> str:
    a, types, b = m.groups()
    r = f"{a}{b}"
    return f"(SELECT * FROM {{e}} WHERE type IN ({', '.join(repr(t) for t in types.split('|'))})) {r} JOIN {{n}} {a} ON {a}.id = {r}.src JOIN {{n}} {b} ON {b}.id = {r}.dst"


def expand(text: str) -> str:
    return re.sub(r"\[\[(\w) ([A-Z_|]+) (\w)\]\]", _join, text)


def _layers() -> tuple[str, str]:
    by_annotation = [
        ("Controller/API", "Controller|RestController|Resource|WebServlet|Router|Blueprint|Api|Endpoint"), ("Service/Business", "Service|Component|UseCase|Interactor|Facade|Manager"), ("Repository/Data", "Repository|Dao|Store|Mapper|Gateway|Adapter"),
        ("Config", "Configuration|Bean|ConfigurationProperties|Settings|Config"), ("Security", "Security|Auth|Authorize|Secured|Permission"), ("Messaging", "Listener|Consumer|Subscriber|Handler|Producer|Publisher"),
    ]
    by_name = [
        ("Controller/API", "Controller Resource Endpoint Handler View Router"), ("Service/Business", "Service Manager Orchestrator Facade UseCase Interactor"), ("Repository/Data", "Repository Repo Dao Store Gateway Mapper"),
        ("Model/Domain", "Entity Model Dto VO Request Response Schema"), ("Config", "Config Configuration Properties Settings"), ("Utility", "Util Utils Helper Helpers Constants Common"),
    ]
    first = " UNION ".join(f"SELECT '{k}' AS layer, c.qn AS class, a.name AS annotation FROM [[c HAS_ANNOTATION a]] WHERE a.label = 'AnnotationType' AND a.name ~ '(?is).*({w}).*'" for k, w in by_annotation)
    second = " UNION ".join(f"SELECT '{k}' AS layer, qn AS class, label AS type FROM {{n}} WHERE label IN ('Class', 'Module', 'Component') AND ({' OR '.join(f'suffix(name, {x!r})' for x in w.split())})" for k, w in by_name)
    return first, second


_PACKAGES = "FROM [[p CONTAINS x]] JOIN {e} c ON c.src = x.id AND c.type IN ({types}) JOIN [[q CONTAINS y]] ON y.id = c.dst WHERE p.label = 'Package' AND q.label = 'Package' AND p.qn <> q.qn"


def _packages(types: str) -> str:
    # a join of two joins: the second in brackets
    return _PACKAGES.replace("{types}", ", ".join(repr(t) for t in types.split())).replace("JOIN [[q CONTAINS y]]", "JOIN (SELECT q.label AS label, q.qn AS qn, y.id AS yid, y.name AS yname, y.qn AS yqn FROM [[q CONTAINS y]]) q").replace("ON y.id = c.dst", "ON q.yid = c.dst")


_ROUTE = "(name ~ '(?is).*(route|router|page|screen|layout|view).*' OR coalesce(path, '') ~ '(?is).*(pages|screens|views|routes|app/|src/app).*')"
_SPA = "(name ~ '(?is).*(app|root|shell|main).*' OR coalesce(path, '') ~ '(?is).*(components|src/|admin-frontend|frontend).*')"
_STATE = "name ~ '(?is).*(store|context|provider|state|query|cache|reducer).*'"
_CLIENT = "'(?is).*(client|api|fetch|axios|gateway|service|query|request).*'"
_OWNED = "(SELECT o.qn AS owner, c.id AS cid FROM [[o CONTAINS c]])"
_UI = "label IN ('Component', 'Function', 'ArrowFunction', 'Module')"

_TEXTS = {
    "get_callers": f"SELECT a.qn AS caller, b.qn AS callee, b.name AS callee_name, ab.line AS line, ab.confidence AS confidence FROM [[a CALLS b]] WHERE {_SURE.replace('r.', 'ab.')}",
    "get_callees": f"SELECT a.qn AS caller, a.name AS caller_name, b.qn AS callee, ab.line AS line, ab.confidence AS confidence FROM [[a CALLS b]] WHERE {_SURE.replace('r.', 'ab.')}",
    "get_class_hierarchy": "SELECT a.qn AS child, b.qn AS parent, ab.type AS rel, a.name AS child_name, b.name AS parent_name FROM [[a EXTENDS|IMPLEMENTS b]]",
    "get_package_contents": "SELECT p.qn AS package, c.name AS name, c.qn AS qn, c.label AS type, c.visibility AS visibility, c.path AS path FROM [[p CONTAINS c]] WHERE p.label = 'Package'",
    "get_architecture_overview__dependencies": f"SELECT p.qn AS from_pkg, q.qn AS to_pkg, count(*) AS weight {_packages('CALLS EXTENDS IMPLEMENTS OF_TYPE')} GROUP BY ALL",
    "get_component_coupling_matrix": f"SELECT p.qn AS source, q.qn AS target, count(*) AS weight, array_to_string(list_sort(list(DISTINCT c.type)), ', ') AS rel_types {_packages('CALLS EXTENDS IMPLEMENTS OF_TYPE')} GROUP BY ALL",
    "get_module_interactions__outgoing": f"SELECT p.qn AS module, q.qn AS target_module, count(*) AS call_count, array_to_string(list_sort(list(DISTINCT x.name))[1:5], ', ') AS sample_callers {_packages('CALLS')} GROUP BY ALL",
    "get_module_interactions__incoming": f"SELECT q.qn AS module, p.qn AS source_module, count(*) AS call_count, array_to_string(list_sort(list(DISTINCT q.yname))[1:5], ', ') AS sample_targets {_packages('CALLS')} GROUP BY ALL",
    "get_module_interactions__inheritance": f"SELECT p.qn AS module, x.qn AS child, q.yqn AS parent, q.qn AS parent_module {_packages('EXTENDS IMPLEMENTS')}",
    "get_hotspots__fan_in": "SELECT b.id AS id, any_value(b.qn) AS method, any_value(b.label) AS type, count(DISTINCT a.id) AS fan_in FROM [[a CALLS b]] GROUP BY b.id",
    "get_hotspots__fan_out": "SELECT a.id AS id, any_value(a.qn) AS method, any_value(a.label) AS type, count(DISTINCT b.id) AS fan_out FROM [[a CALLS b]] GROUP BY a.id",
    "get_hotspots__god_class": "SELECT a.id AS id, any_value(a.qn) AS class, count(*) AS member_count FROM [[a CONTAINS b]] WHERE a.label = 'Class' GROUP BY a.id",
    "get_hotspots__coupling": "SELECT id, out_degree, in_degree, out_degree + in_degree AS total_coupling FROM (SELECT x.id, (SELECT count(*) FROM {e} r WHERE r.src = x.id AND r.type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS', 'OF_TYPE')) AS out_degree, (SELECT count(*) FROM {e} r WHERE r.dst = x.id AND r.type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS', 'OF_TYPE')) AS in_degree FROM {n} x) y WHERE out_degree > 0 AND in_degree > 0",
    "detect_circular_dependencies__calls": "SELECT DISTINCT a.qn AS method_a, b.qn AS method_b FROM [[a CALLS b]] WHERE a.qn < b.qn AND EXISTS (SELECT 1 FROM (SELECT c.qn AS cq, d.qn AS dq FROM [[c CALLS d]]) z WHERE z.cq = b.qn AND z.dq = a.qn)",
    "get_layer_classification__annotation": _layers()[0],
    "get_layer_classification__suffix": _layers()[1],
    "get_entry_points__uncalled": "SELECT qn AS method, name FROM {n} WHERE label = 'Method' AND visibility = 'public' AND NOT external AND id NOT IN (SELECT dst FROM {e} WHERE type = 'CALLS')",
    "get_design_patterns__factory": "SELECT c.qn AS factory, m.name AS method, z.qn AS product FROM [[c CONTAINS m]] JOIN {e} w ON w.src = m.id AND w.type = 'RETURNS' JOIN {n} z ON z.id = w.dst WHERE c.label = 'Class' AND m.label = 'Method' AND z.label = 'Interface'",
    "get_design_patterns__strategy": "WITH i AS (SELECT b.id, b.qn, count(*) AS impls FROM [[a IMPLEMENTS b]] WHERE a.label = 'Class' AND b.label = 'Interface' GROUP BY b.id, b.qn HAVING count(*) >= 2) SELECT i.qn AS strategy, i.impls AS impl_count, c.qn AS consumer FROM [[c CONTAINS f]] JOIN {e} w ON w.src = f.id AND w.type = 'OF_TYPE' JOIN i ON i.id = w.dst WHERE c.label = 'Class' AND f.label = 'Field'",
    "get_design_patterns__observer": "SELECT qn AS class, name, label AS type FROM {n} WHERE contains(name, 'Listener') OR contains(name, 'Observer') OR contains(name, 'EventHandler') OR contains(name, 'Subscriber')",
    "get_domain_model__fields": "SELECT c.qn AS owner_class, f.name AS field_name, y.name AS type_name FROM [[c CONTAINS f]] LEFT JOIN (SELECT w.src, z.name FROM {e} w JOIN {n} z ON z.id = w.dst WHERE w.type = 'OF_TYPE') y ON y.src = f.id WHERE c.label = 'Class' AND f.label = 'Field' AND NOT c.external",
    "get_domain_model__modules": "SELECT m.name AS module, y.name AS entity_name, y.label AS node_type FROM {n} m LEFT JOIN (SELECT w.src, z.name, z.label FROM {e} w JOIN {n} z ON z.id = w.dst WHERE w.type = 'CONTAINS' AND NOT z.external) y ON y.src = m.id WHERE m.label = 'Module' AND (contains(m.name, '.model') OR contains(m.name, '.schema') OR contains(m.name, '.entity') OR contains(m.name, '.entities'))",
    "get_domain_model__entities": f"SELECT qn AS entity, name, label AS type FROM {{n}} WHERE label = 'Class' AND NOT external AND ({' OR '.join(f'suffix(name, {x!r})' for x in 'Model Schema Entity Document Record Dto DTO'.split())})",
    "get_domain_model__implementors": "SELECT DISTINCT b.qn AS interface, a.qn AS implementor FROM [[a IMPLEMENTS b]] WHERE a.label = 'Class'",
    "get_unused_code__methods": "SELECT qn AS method, visibility FROM {n} WHERE label = 'Method' AND visibility IN ('public', 'protected') AND name <> 'main' AND id NOT IN (SELECT dst FROM {e} WHERE type = 'CALLS' OR type = 'OVERRIDES')",
    "get_unused_code__classes": "SELECT qn AS class FROM {n} WHERE label = 'Class' AND id NOT IN (SELECT dst FROM {e} WHERE type IN ('EXTENDS', 'IMPLEMENTS', 'OF_TYPE', 'CALLS')) AND NOT (id IN (SELECT dst FROM {e} WHERE type = 'CONTAINS') AND id IN (SELECT src FROM {e} WHERE type = 'HAS_ANNOTATION'))",
    "get_unused_code__interfaces": "SELECT qn AS interface FROM {n} WHERE label = 'Interface' AND id NOT IN (SELECT dst FROM {e} WHERE type = 'IMPLEMENTS')",
    "get_exception_handling": "SELECT b.qn AS exception, count(*) AS throws, count(DISTINCT a.id) AS methods, array_to_string(list_sort(list(DISTINCT a.qn))[1:5], ', ') AS samples FROM [[a THROWS b]] WHERE b.qn IS NOT NULL GROUP BY b.qn",
    "get_route_map__candidates": f"SELECT DISTINCT name, label AS type, path, owner FROM {{n}} x LEFT JOIN {_OWNED} w ON w.cid = x.id WHERE {_UI} AND {_ROUTE}",
    "get_route_map__exports": "SELECT a.qn AS module, b.name AS exported, b.label AS type FROM [[a EXPORTS b]] WHERE a.label = 'Module' AND b.name ~ '(?is).*(route|router|page|screen|layout|view).*'",
    "get_hook_usage_graph": f"SELECT 'use' AS what, a.qn AS consumer, a.label AS consumer_type, b.qn AS target, ab.line AS line FROM [[a USES_HOOK b]] WHERE b.label = 'Hook' UNION ALL SELECT 'call', a.qn, a.label, b.qn, ab.line FROM [[a CALLS b]] WHERE a.label = 'Hook' AND (b.name ~ {_CLIENT} OR coalesce(b.qn, '') ~ {_CLIENT})",
    "get_state_ownership_map__owners": f"SELECT DISTINCT qn AS state_owner, label AS state_type, path FROM {{n}} WHERE label IN ('Hook', 'Component', 'Module', 'Function') AND (label = 'Hook' OR {_STATE})",
    "get_state_ownership_map__consumers": f"SELECT DISTINCT a.qn AS consumer, a.label AS consumer_type, b.qn AS state_owner, b.label AS state_type FROM [[a USES_HOOK|CALLS|IMPORTS b]] WHERE b.label = 'Hook' OR b.{_STATE}",
    "get_route_component_map": f"""WITH x AS (SELECT a.qn AS entry, a.label AS entry_type, a.name AS name, a.path AS path, b.qn AS child, ab.line AS line FROM [[a RENDERS b]] WHERE b.label = 'Component'),
one AS (SELECT DISTINCT qn, label, path, owner, {_ROUTE} AS route FROM {{n}} y LEFT JOIN {_OWNED} w ON w.cid = y.id WHERE {_UI} AND ({_ROUTE} OR {_SPA})),
spa AS (SELECT DISTINCT qn, label, path, owner FROM {{n}} y LEFT JOIN {_OWNED} w ON w.cid = y.id WHERE {_UI} AND {_SPA}),
any_ AS (SELECT EXISTS (SELECT 1 FROM one WHERE route) OR EXISTS (SELECT 1 FROM x WHERE {_ROUTE}) AS yes)
SELECT 'route' AS found_by, qn AS entry, label AS entry_type, path, owner, NULL::VARCHAR AS child_component, NULL::BIGINT AS line FROM one WHERE route
UNION ALL SELECT 'route', entry, entry_type, path, NULL, child, line FROM x WHERE {_ROUTE}
UNION ALL SELECT 'fallback', qn, label, path, owner, NULL, NULL FROM spa WHERE NOT (SELECT yes FROM any_)
UNION ALL SELECT 'fallback', entry, entry_type, path, NULL, child, line FROM x WHERE NOT (SELECT yes FROM any_) AND {_SPA}""",
    "impact_analysis__overrides": "SELECT b.qn AS method, a.qn AS affected FROM [[a OVERRIDES b]]",
    "get_api_endpoints__annotated": "SELECT a.qn AS method, a.name AS name, b.name AS annotation, a.line AS line, a.label AS type FROM [[a HAS_ANNOTATION b]] WHERE a.label IN ('Method', 'Function') AND b.name ~ '(?is).*(Mapping|Route|Endpoint|Api|GET|POST|PUT|DELETE|PATCH|Path|Produces|Consumes).*'",
    "get_scheduled_jobs": "SELECT a.qn AS method, a.name AS name, b.name AS annotation, a.line AS line, a.label AS type FROM [[a HAS_ANNOTATION b]] WHERE b.name ~ '(?is).*(Scheduled|Async|Cron|Timer|EventListener|Listener|Subscriber|Consumer|Handler|Retryable|Cacheable|Task|Worker|Job|Celery|periodic).*'",
}

SQL = {name: expand(text) for name, text in _TEXTS.items()}
