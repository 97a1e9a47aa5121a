"""The named graph tools, each a set of sections over the whole graph.

A section is one query over nodes ``{n}``, edges ``{e}`` and joined edges
``{t}``. Where a tool asks about one name, the section answers for all names and
``call`` narrows it by its columns (the filter is pushed down to the scan).
Sections have no row caps; only ``top_k`` reports keep one, with a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph

SURE = "(confidence IS NULL OR confidence >= 0.9)"

#: The patterns tools classify names, paths and annotations by.
ENTRY_ANNOTATION = "Controller|Application|Servlet|WebSocket|Endpoint|Router|Blueprint|App|Main|Command|CLI"
HTTP_ANNOTATION = "Mapping|Route|Endpoint|Api|GET|POST|PUT|DELETE|PATCH|Path|Produces|Consumes"
CONTROLLER_ANNOTATION = "Controller|RestController|Resource|Router|Blueprint|Api"
ENDPOINT_NAME = "route|endpoint|handler|controller|api|get_|post_|put_|delete_"
ENDPOINT_FUNCTION = "route|endpoint|handler|api_|get_|post_|put_|delete_"
ROUTE_NAME, ROUTE_PATH = "route|router|page|screen|layout|view", "pages|screens|views|routes|app/|src/app"
UI_PATH = "components|pages|screens|views|routes|app/|src/app"
SPA_NAME, SPA_PATH = "app|root|shell|main", "components|src/|admin-frontend|frontend"
STORE_NAME = "store|context|provider|state|query|cache|reducer"
CLIENT_NAME, CLIENT_CALL = "client|api|fetch|axios|gateway|service|query", "client|api|fetch|axios|gateway|service|query|request"
CLIENT_IMPORT = "axios|fetch|graphql|apollo|swr|react-query"
JOB_ANNOTATION = "Scheduled|Async|Cron|Timer|EventListener|Listener|Subscriber|Consumer|Handler|Retryable|Cacheable|Task|Worker|Job|Celery|periodic"
EXTENSION_NAME = "plugin|extension|hook|adapter|strategy|callback|listener|provider"
BOUNDARY = "repository|dao|client|gateway|adapter|kafka|rabbit|redis|cache|db|http|rest|feign|grpc"
OBSERVER = "Listener|Observer|EventHandler|Subscriber"
UI_CALL_PATH, UI_MODULE_PATH, UI_MODULE_NAME = "components|pages|screens|views|routes|app/|src/app", "components|pages|screens|views|routes|app/|src/app|admin-frontend|frontend", "components|pages|screens|views|routes|app|admin-frontend|frontend"
UI_CALL = "client|api|fetch|axios|gateway|service|query|request|get|post|put|delete"
DOMAIN_MODULE = [".model", ".models", ".schema", ".schemas", ".entity", ".entities"]
LAYER_ANNOTATION = {"Controller/API": "Controller|RestController|Resource|WebServlet|Router|Blueprint|Api|Endpoint", "Service/Business": "Service|Component|UseCase|Interactor|Facade|Manager", "Repository/Data": "Repository|Dao|Store|Mapper|Gateway|Adapter", "Config": "Configuration|Bean|ConfigurationProperties|Settings|Config", "Security": "Security|Auth|Authorize|Secured|Permission", "Messaging": "Listener|Consumer|Subscriber|Handler|Producer|Publisher"}
LAYER_SUFFIX = {"Controller/API": ["Controller", "Resource", "Endpoint", "Handler", "View", "Router"], "Service/Business": ["Service", "Manager", "Orchestrator", "Facade", "UseCase", "Interactor"], "Repository/Data": ["Repository", "Repo", "Dao", "Store", "Gateway", "Mapper"], "Model/Domain": ["Entity", "Model", "Dto", "VO", "Request", "Response", "Schema"], "Config": ["Config", "Configuration", "Properties", "Settings"], "Utility": ["Util", "Utils", "Helper", "Helpers", "Constants", "Common"]}


def _like(col: str, words: str) -> str:
    return f"@re({col}, '(?i)({words})')"


def _rows(pairs: list[tuple[str, ...]], cols: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(repr(x) for x in p) + ')' for p in pairs)}) AS {cols}"


def _sampled(rows: str, group: str, value: str, counts: str, samples: str) -> str:
    """Counts by group and the five smallest values of each as ``samples``.

    The values are ranked, which is cut to five a group before the shuffle as
    well; no group is gathered.
    """
    return f"""WITH x AS ({rows}),
k AS (SELECT {group}, {value}, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS k FROM (SELECT DISTINCT {group}, {value} FROM x WHERE {value} IS NOT NULL) d),
f AS (SELECT {group}, @set({value}) AS {samples} FROM k WHERE k <= 5 GROUP BY {group}),
c AS (SELECT {group}, {counts} FROM x GROUP BY {group})
SELECT c.*, f.{samples} FROM c LEFT JOIN f ON {' AND '.join(f'f.{g} = c.{g}' for g in group.split(', '))}"""


_UI = "label IN ('Component', 'Function', 'ArrowFunction', 'Module') AND "
_ROUTE_ANY = f"({_like('name', ROUTE_NAME)} OR {_like('coalesce(path, %s)' % repr(''), ROUTE_PATH)})"
_SPA_ANY = f"({_like('name', SPA_NAME)} OR {_like('coalesce(path, %s)' % repr(''), SPA_PATH)})"
_ROUTE, _SPA = _UI + _ROUTE_ANY, _UI + _SPA_ANY


def _of_edge(condition: str) -> str:
    """A condition on a node as one on the start of an edge."""
    return condition.replace("(name", "(s_name").replace("coalesce(path", "coalesce(s_path")


PACKAGE_LINKS = "SELECT p1.s_qn AS from_pkg, p2.s_qn AS to_pkg, c.type AS type, c.rel_id AS rel_id, c.s_qn AS from_qn, c.d_qn AS to_qn, c.s_name AS from_name, c.d_name AS to_name FROM {t} c JOIN {t} p1 ON p1.type = 'CONTAINS' AND p1.s_label = 'Package' AND p1.d_id = c.s_id JOIN {t} p2 ON p2.type = 'CONTAINS' AND p2.s_label = 'Package' AND p2.d_id = c.d_id WHERE p1.s_qn <> p2.s_qn AND c.type IN (%s)"
DEPENDS = "'CALLS', 'EXTENDS', 'IMPLEMENTS', 'OF_TYPE'"

SECTIONS: dict[str, str] = {
    # lookup
    "summary": "SELECT 'node' AS what, label AS kind, count(*) AS n FROM {n} GROUP BY label UNION ALL SELECT 'relationship', type, count(*) FROM {e} GROUP BY type UNION ALL SELECT 'total', 'nodes', count(*) FROM {n} UNION ALL SELECT 'total', 'relationships', count(*) FROM {e}",
    "search_nodes": "SELECT id, name, qn, label, language, line, path, lower(concat(coalesce(name, ''), ' ', coalesce(qn, ''))) AS text FROM {n} WHERE label IN ('Package', 'Class', 'Interface', 'Method', 'Function', 'Module', 'Component', 'Field', 'Constructor')",
    "get_callers": f"SELECT s_qn AS caller, d_qn AS callee, d_name AS callee_name, line, confidence FROM {{t}} WHERE type = 'CALLS' AND {SURE}",
    "get_callees": f"SELECT s_qn AS caller, s_name AS caller_name, d_qn AS callee, line, confidence FROM {{t}} WHERE type = 'CALLS' AND {SURE}",
    "get_class_hierarchy": "SELECT s_qn AS child, d_qn AS parent, type AS rel, s_name AS child_name, d_name AS parent_name FROM {t} WHERE type IN ('EXTENDS', 'IMPLEMENTS')",
    "get_control_flow": "SELECT m.s_qn AS method, m.d_code AS from_stmt, m.d_line AS from_line, f.d_code AS to_stmt, f.d_line AS to_line FROM {t} m JOIN {t} f ON f.s_id = m.d_id AND f.type = 'CFG_NEXT' WHERE m.type = 'CFG_NEXT' AND m.s_label <> 'Statement' AND m.d_label = 'Statement' AND f.d_label = 'Statement'",
    "get_data_flow": "SELECT m.s_qn AS method, m.d_code AS from_stmt, m.d_line AS from_line, f.d_code AS to_stmt, f.d_line AS to_line FROM {t} m JOIN {t} f ON f.s_id = m.d_id AND f.type = 'DATA_FLOW' WHERE m.type = 'CFG_NEXT' AND m.s_label <> 'Statement' AND m.d_label = 'Statement' AND f.d_label = 'Statement'",
    "get_control_flow__full": "SELECT a.s_qn AS method, a.d_code AS from_stmt, a.d_line AS from_line, f.type AS flow, f.d_code AS to_stmt, f.d_line AS to_line FROM {t} a JOIN {t} f ON f.s_id = a.d_id AND f.type IN ('CFG_NEXT', 'DATA_FLOW') WHERE a.type = 'AST_CHILD' AND a.s_label <> 'Statement'",
    "get_package_contents": "SELECT s_qn AS package, d_name AS name, d_qn AS qn, d_label AS type, d_visibility AS visibility, d_path AS path FROM {t} WHERE type = 'CONTAINS' AND s_label = 'Package'",
    "get_class_details": "SELECT s_qn AS class, 'member' AS section, d_label AS kind, d_name AS name, d_visibility AS visibility, d_line AS line FROM {t} WHERE type = 'CONTAINS' AND s_label IN ('Class', 'Interface', 'Enum', 'Record', 'DataClass', 'SealedClass') UNION ALL SELECT s_qn, 'annotation', d_label, d_name, NULL, line FROM {t} WHERE type = 'HAS_ANNOTATION' AND s_label IN ('Class', 'Interface', 'Enum', 'Record', 'DataClass', 'SealedClass') UNION ALL SELECT s_qn, 'file', d_label, d_path, NULL, NULL FROM {t} WHERE type = 'SOURCE_FILE' AND s_label IN ('Class', 'Interface', 'Enum', 'Record', 'DataClass', 'SealedClass')",
    "get_method_signature": "SELECT qn AS method, 'self' AS section, name AS value, visibility AS extra, line FROM {n} WHERE label = 'Method' UNION ALL SELECT s_qn, CASE type WHEN 'HAS_PARAMETER' THEN 'parameter' WHEN 'RETURNS' THEN 'returns' ELSE 'annotation' END, d_name, d_qn, d_line FROM {t} WHERE s_label = 'Method' AND type IN ('HAS_PARAMETER', 'RETURNS', 'HAS_ANNOTATION') UNION ALL SELECT d_qn, 'class', s_name, s_qn, s_line FROM {t} WHERE d_label = 'Method' AND type = 'CONTAINS'",
    "get_annotations_usage": "SELECT d_name AS annotation, s_label AS target_type, count(*) AS usage_count, CAST(sum(count(*)) OVER (PARTITION BY d_name) AS BIGINT) AS annotation_total FROM {t} WHERE type = 'HAS_ANNOTATION' GROUP BY d_name, s_label UNION ALL SELECT s_name, d_label, count(*), CAST(sum(count(*)) OVER (PARTITION BY s_name) AS BIGINT) FROM {t} WHERE type = 'DECORATES' GROUP BY s_name, d_label",
    # architecture
    "get_architecture_overview__packages": "SELECT s_qn AS package, d_label AS type, count(*) AS n FROM {t} WHERE type = 'CONTAINS' AND s_label = 'Package' GROUP BY s_qn, d_label",
    "get_architecture_overview__dependencies": f"SELECT from_pkg, to_pkg, count(*) AS weight FROM ({PACKAGE_LINKS % DEPENDS}) x GROUP BY from_pkg, to_pkg",
    "get_architecture_overview__files": "SELECT count(*) AS files FROM {n} WHERE label = 'File'",
    "get_component_coupling_matrix": f"SELECT from_pkg AS source, to_pkg AS target, count(*) AS weight, @set(type) AS rel_types FROM ({PACKAGE_LINKS % DEPENDS}) x GROUP BY from_pkg, to_pkg",
    "get_component_coupling_matrix__both_ways": f"WITH w AS (SELECT from_pkg, to_pkg, count(*) AS weight FROM ({PACKAGE_LINKS % DEPENDS}) x GROUP BY from_pkg, to_pkg) SELECT a.from_pkg AS package_a, a.to_pkg AS package_b, a.weight AS forth, b.weight AS back FROM w a JOIN w b ON a.from_pkg = b.to_pkg AND a.to_pkg = b.from_pkg WHERE a.from_pkg < a.to_pkg",
    "get_module_dependency_map": "SELECT s_path AS from_path, d_path AS to_path, count(*) AS weight FROM {t} WHERE type IN ('IMPORTS', 'CALLS') AND s_path IS NOT NULL AND d_path IS NOT NULL AND s_path <> d_path GROUP BY s_path, d_path",
    "get_module_dependency_map__imports": "SELECT s_qn AS module, d_qn AS dependency, d_label AS type, count(*) AS n FROM {t} WHERE type = 'IMPORTS' GROUP BY s_qn, d_qn, d_label",
    "get_module_interactions__outgoing": _sampled("SELECT from_pkg AS module, to_pkg AS target_module, from_name FROM (" + PACKAGE_LINKS % "'CALLS'" + ") y", "module, target_module", "from_name", "count(*) AS call_count", "sample_callers"),
    "get_module_interactions__incoming": _sampled("SELECT to_pkg AS module, from_pkg AS source_module, to_name FROM (" + PACKAGE_LINKS % "'CALLS'" + ") y", "module, source_module", "to_name", "count(*) AS call_count", "sample_targets"),
    "get_module_interactions__inheritance": f"SELECT from_pkg AS module, from_qn AS child, to_qn AS parent, to_pkg AS parent_module FROM ({PACKAGE_LINKS % (repr('EXTENDS') + ', ' + repr('IMPLEMENTS'))}) x",
    "detect_circular_dependencies__packages": "WITH w AS (SELECT DISTINCT from_pkg, to_pkg FROM (" + PACKAGE_LINKS % "'CALLS', 'EXTENDS', 'IMPLEMENTS'" + ") x) SELECT a.from_pkg AS package_a, a.to_pkg AS package_b FROM w a JOIN w b ON a.from_pkg = b.to_pkg AND a.to_pkg = b.from_pkg WHERE a.from_pkg < a.to_pkg",
    "detect_circular_dependencies__calls": "WITH c AS (SELECT DISTINCT s_qn, d_qn FROM {t} WHERE type = 'CALLS' AND s_qn <> d_qn) SELECT a.s_qn AS method_a, a.d_qn AS method_b FROM c a JOIN c b ON a.s_qn = b.d_qn AND a.d_qn = b.s_qn WHERE a.s_qn < a.d_qn",
    "get_hotspots__coupling": f"WITH o AS (SELECT src AS id, count(*) AS out_degree FROM {{e}} WHERE type IN ({DEPENDS}) GROUP BY src), i AS (SELECT dst AS id, count(*) AS in_degree FROM {{e}} WHERE type IN ({DEPENDS}) GROUP BY dst) SELECT id, out_degree, in_degree, out_degree + in_degree AS total_coupling FROM o JOIN i USING (id)",
    "get_hotspots__fan_in": "SELECT d_id AS id, d_qn AS method, d_label AS type, count(DISTINCT s_id) AS fan_in FROM {t} WHERE type = 'CALLS' GROUP BY d_id, d_qn, d_label",
    "get_hotspots__fan_out": "SELECT s_id AS id, s_qn AS method, s_label AS type, count(DISTINCT d_id) AS fan_out FROM {t} WHERE type = 'CALLS' GROUP BY s_id, s_qn, s_label",
    "get_hotspots__god_class": "SELECT s_id AS id, s_qn AS class, count(*) AS member_count FROM {t} WHERE type = 'CONTAINS' AND s_label = 'Class' GROUP BY s_id, s_qn",
    "get_hotspots__top_coupling": f"WITH d AS (SELECT src AS id FROM {{e}} WHERE type IN ({DEPENDS}) UNION ALL SELECT dst FROM {{e}} WHERE type IN ({DEPENDS})) SELECT id, count(*) AS degree FROM d GROUP BY id ORDER BY degree DESC, id LIMIT 15",
    "get_external_dependencies": _sampled("SELECT qn, label, CASE WHEN instr(qn, '.') = 0 THEN qn WHEN length(qn) - length(replace(qn, '.', '')) = 1 THEN split_part(qn, '.', 1) WHEN length(qn) - length(replace(qn, '.', '')) = 2 THEN concat(split_part(qn, '.', 1), '.', split_part(qn, '.', 2)) ELSE concat(split_part(qn, '.', 1), '.', split_part(qn, '.', 2), '.', split_part(qn, '.', 3)) END AS grp FROM {n} WHERE external AND qn IS NOT NULL", "grp", "qn", "count(*) AS symbols", "samples"),
    "get_layer_classification__annotation": f"SELECT DISTINCT l.layer AS layer, s_qn AS class, d_name AS annotation FROM {{t}} JOIN {_rows(list(LAYER_ANNOTATION.items()), 'l(layer, words)')} ON @re(d_name, concat('(?i)(', l.words, ')')) WHERE type = 'HAS_ANNOTATION' AND d_label = 'AnnotationType'",
    "get_layer_classification__suffix": f"SELECT DISTINCT l.layer AS layer, qn AS class, label AS type FROM {{n}} JOIN {_rows([(k, s) for k, v in LAYER_SUFFIX.items() for s in v], 'l(layer, suffix)')} ON name LIKE concat('%', l.suffix) WHERE label IN ('Class', 'Module', 'Component')",
    "get_architecture_summary__languages": "SELECT language, count(*) AS n FROM {n} GROUP BY language",
    # discovery
    "get_entry_points__annotated": f"SELECT DISTINCT s_qn AS target, d_name AS annotation, s_label AS type FROM {{t}} WHERE type = 'HAS_ANNOTATION' AND {_like('d_name', ENTRY_ANNOTATION)}",
    "get_entry_points__main": "SELECT qn AS entry, label AS type, visibility FROM {n} WHERE label IN ('Method', 'Function') AND name = 'main'",
    "get_entry_points__exports": "SELECT s_qn AS module, d_qn AS export, d_label AS type, d_language AS language FROM {t} WHERE type = 'EXPORTS'",
    "get_entry_points__uncalled": "SELECT qn AS method, name FROM {n} WHERE label = 'Method' AND visibility = 'public' AND NOT external AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT dst FROM {e} WHERE type = 'CALLS') x WHERE x.dst = id)",
    "get_api_endpoints__named": f"SELECT DISTINCT qn AS endpoint, label AS type, language FROM {{n}} WHERE label IN ('Function', 'ArrowFunction', 'Method') AND {_like('name', ENDPOINT_FUNCTION)}",
    "get_api_endpoints__annotated": f"SELECT s_qn AS method, s_name AS name, d_name AS annotation, s_line AS line, s_label AS type FROM {{t}} WHERE type = 'HAS_ANNOTATION' AND s_label IN ('Method', 'Function') AND {_like('d_name', HTTP_ANNOTATION)}",
    "get_api_endpoints__controllers": f"SELECT s_qn AS controller, d_name AS annotation, s_path AS path, s_label AS type FROM {{t}} WHERE type = 'HAS_ANNOTATION' AND s_label IN ('Class', 'Module') AND {_like('d_name', CONTROLLER_ANNOTATION)}",
    "get_scheduled_jobs": f"SELECT s_qn AS method, s_name AS name, d_name AS annotation, s_line AS line, s_label AS type FROM {{t}} WHERE type = 'HAS_ANNOTATION' AND {_like('d_name', JOB_ANNOTATION)}",
    "get_exception_handling": _sampled("SELECT d_qn AS exception, s_qn, s_id FROM {t} WHERE type = 'THROWS' AND d_qn IS NOT NULL", "exception", "s_qn", "count(*) AS throws, count(DISTINCT s_id) AS methods", "samples"),
    "get_design_patterns__factory": "SELECT c.s_qn AS factory, c.d_name AS method, r.d_qn AS product FROM {t} c JOIN {t} r ON r.type = 'RETURNS' AND r.s_id = c.d_id AND r.d_label = 'Interface' WHERE c.type = 'CONTAINS' AND c.s_label = 'Class' AND c.d_label = 'Method'",
    "get_design_patterns__strategy": "WITH i AS (SELECT d_id AS id, d_qn AS qn, count(*) AS impls FROM {t} WHERE type = 'IMPLEMENTS' AND s_label = 'Class' AND d_label = 'Interface' GROUP BY d_id, d_qn) SELECT i.qn AS strategy, i.impls AS impl_count, c.s_qn AS consumer FROM i JOIN {t} f ON f.type = 'OF_TYPE' AND f.d_id = i.id AND f.s_label = 'Field' JOIN {t} c ON c.type = 'CONTAINS' AND c.d_id = f.s_id AND c.s_label = 'Class' WHERE i.impls >= 2",
    "get_design_patterns__observer": f"SELECT qn AS class, name, label AS type FROM {{n}} WHERE @re(name, '({OBSERVER})')",
    "get_domain_model__fields": "SELECT c.s_qn AS owner_class, c.d_name AS field_name, o.d_name AS type_name FROM {t} c LEFT JOIN {t} o ON o.type = 'OF_TYPE' AND o.s_id = c.d_id WHERE c.type = 'CONTAINS' AND c.s_label = 'Class' AND c.d_label = 'Field' AND NOT c.s_external",
    "get_domain_model__modules": f"WITH m AS (SELECT id, name FROM {{n}} WHERE label = 'Module' AND ({' OR '.join(f'instr(name, {w!r}) > 0' for w in DOMAIN_MODULE)})), c AS (SELECT s_id, d_name, d_label FROM {{t}} WHERE type = 'CONTAINS' AND s_label = 'Module' AND NOT d_external) SELECT m.name AS module, c.d_name AS entity_name, c.d_label AS node_type FROM m LEFT JOIN c ON c.s_id = m.id",
    "get_domain_model__entities": "SELECT qn AS entity, name, label AS type FROM {n} WHERE label = 'Class' AND NOT external AND @re(name, '(Model|Schema|Entity|Document|Record|Dto|DTO)$')",
    "get_domain_model__implementors": "SELECT DISTINCT d_qn AS interface, s_qn AS implementor FROM {t} WHERE type = 'IMPLEMENTS' AND s_label = 'Class'",
    "get_unused_code__methods": "SELECT qn AS method, visibility FROM {n} WHERE label = 'Method' AND visibility IN ('public', 'protected') AND name <> 'main' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT dst FROM {e} WHERE type IN ('CALLS', 'OVERRIDES')) x WHERE x.dst = id)",
    "get_unused_code__classes": "WITH k AS (SELECT DISTINCT dst FROM {e} WHERE type = 'CONTAINS'), a AS (SELECT DISTINCT src FROM {e} WHERE type = 'HAS_ANNOTATION'), used AS (SELECT DISTINCT dst AS id FROM {e} WHERE type IN ('EXTENDS', 'IMPLEMENTS', 'OF_TYPE', 'CALLS') UNION SELECT dst FROM k JOIN a ON a.src = k.dst) SELECT qn AS class FROM {n} WHERE label = 'Class' AND NOT EXISTS (SELECT 1 FROM used WHERE used.id = {n}.id)",
    "get_unused_code__interfaces": "SELECT qn AS interface FROM {n} WHERE label = 'Interface' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT dst FROM {e} WHERE type = 'IMPLEMENTS') x WHERE x.dst = id)",
    "get_public_api_surface": "SELECT 'export' AS what, s_qn AS owner, d_qn AS symbol, d_label AS type, d_path AS path FROM {t} WHERE type = 'EXPORTS' UNION ALL SELECT 'method', NULL, qn, label, path FROM {n} WHERE label = 'Method' AND visibility = 'public'",
    "get_extension_points": f"SELECT DISTINCT label AS type, qn AS name, path FROM {{n}} WHERE label IN ('Interface', 'SealedClass', 'Hook', 'Function') OR {_like('name', EXTENSION_NAME)}",
    # front end
    "get_route_map__candidates": f"WITH r AS (SELECT id, name, label, path FROM {{n}} WHERE label IN ('Component', 'Function', 'ArrowFunction', 'Module') AND ({_like('name', ROUTE_NAME)} OR {_like('coalesce(path, %s)' % repr(''), ROUTE_PATH)})), o AS (SELECT d_id, s_qn FROM {{t}} WHERE type = 'CONTAINS') SELECT DISTINCT r.name AS name, r.label AS type, r.path AS path, o.s_qn AS owner FROM r LEFT JOIN o ON o.d_id = r.id",
    "get_route_map__exports": f"SELECT s_qn AS module, d_name AS exported, d_label AS type FROM {{t}} WHERE type = 'EXPORTS' AND s_label = 'Module' AND {_like('d_name', ROUTE_NAME)}",
    "get_route_map__components": f"SELECT DISTINCT qn AS component, path FROM {{n}} WHERE label = 'Component' AND {_like('coalesce(path, %s)' % repr(''), UI_PATH)}",
    "get_component_boundary_map": "SELECT type AS relation, s_qn AS parent, d_qn AS child, d_path AS path, line FROM {t} WHERE (type = 'CONTAINS' AND d_label = 'Component') OR type IN ('RENDERS', 'PROP_DEPENDENCY')",
    "get_state_management_summary__hooks": "SELECT 'hook' AS what, NULL AS consumer, qn AS target, path FROM {n} WHERE label = 'Hook' UNION ALL SELECT 'use', s_qn, d_qn, s_path FROM {t} WHERE type = 'USES_HOOK'",
    "get_state_management_summary__stores": f"SELECT DISTINCT label AS type, qn AS name, path FROM {{n}} WHERE label IN ('Component', 'Module', 'Function') AND {_like('name', STORE_NAME)}",
    "get_state_management_summary__links": f"SELECT DISTINCT s_qn AS consumer, s_label AS consumer_type, d_qn AS state_target, d_label AS state_type FROM {{t}} WHERE type IN ('CALLS', 'IMPORTS') AND {_like('d_name', STORE_NAME)}",
    "get_api_client_summary__clients": f"SELECT DISTINCT label AS type, qn AS name, path FROM {{n}} WHERE label IN ('Module', 'Function', 'ArrowFunction', 'AsyncFunction', 'Class') AND {_like('name', CLIENT_NAME)}",
    "get_api_client_summary__imports": f"SELECT s_qn AS module, d_qn AS dependency FROM {{t}} WHERE type = 'IMPORTS' AND {_like('d_name', CLIENT_IMPORT)}",
    "get_api_client_summary__calls": f"SELECT DISTINCT s_qn AS caller, s_label AS caller_type, d_qn AS target, line FROM {{t}} WHERE type = 'CALLS' AND ({_like('d_name', CLIENT_CALL)} OR {_like('d_qn', CLIENT_CALL)})",
    "get_component_tree__roots": "SELECT DISTINCT qn AS root, path FROM {n} WHERE label = 'Component' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT dst FROM {e} WHERE type = 'RENDERS') x WHERE x.dst = id)",
    "get_component_tree__renders": "SELECT s_qn AS parent, d_qn AS child, line FROM {t} WHERE type = 'RENDERS' AND d_label = 'Component'",
    "get_hook_usage_graph": f"SELECT 'use' AS what, s_qn AS consumer, s_label AS consumer_type, d_qn AS target, line FROM {{t}} WHERE type = 'USES_HOOK' AND d_label = 'Hook' UNION ALL SELECT 'call', s_qn, s_label, d_qn, line FROM {{t}} WHERE type = 'CALLS' AND s_label = 'Hook' AND ({_like('d_name', CLIENT_CALL)} OR {_like('coalesce(d_qn, %s)' % repr(''), CLIENT_CALL)})",
    "get_state_ownership_map__owners": f"SELECT DISTINCT qn AS state_owner, label AS state_type, path FROM {{n}} WHERE label IN ('Hook', 'Component', 'Module', 'Function') AND (label = 'Hook' OR {_like('name', STORE_NAME)})",
    "get_state_ownership_map__consumers": f"SELECT DISTINCT s_qn AS consumer, s_label AS consumer_type, d_qn AS state_owner, d_label AS state_type FROM {{t}} WHERE type IN ('USES_HOOK', 'CALLS', 'IMPORTS') AND (d_label = 'Hook' OR {_like('d_name', STORE_NAME)})",
    # the primary table if it has rows, else the fallback: one plan
    "get_route_component_map": f"""WITH r AS (SELECT id, qn, label, path FROM {{n}} WHERE {_ROUTE}), s AS (SELECT id, qn, label, path FROM {{n}} WHERE {_SPA}),
x AS (SELECT s_id, s_label, s_name, s_path, s_qn, d_qn, line FROM {{t}} WHERE type = 'RENDERS' AND d_label = 'Component'), rx AS (SELECT * FROM x WHERE {_of_edge(_ROUTE_ANY)}),
g AS (SELECT (SELECT count(*) FROM r) + (SELECT count(*) FROM rx) AS found), o AS (SELECT d_id, s_qn AS owner FROM {{t}} WHERE type = 'CONTAINS')
SELECT DISTINCT 'route' AS found_by, r.qn AS entry, r.label AS entry_type, r.path AS path, o.owner AS owner, CAST(NULL AS STRING) AS child_component, CAST(NULL AS BIGINT) AS line FROM r LEFT JOIN o ON o.d_id = r.id
UNION ALL SELECT 'route', s_qn, s_label, s_path, NULL, d_qn, line FROM rx
UNION ALL SELECT * FROM (SELECT DISTINCT 'fallback', s.qn, s.label, s.path, o.owner, CAST(NULL AS STRING), CAST(NULL AS BIGINT) FROM s LEFT JOIN o ON o.d_id = s.id WHERE (SELECT found FROM g) = 0) f
UNION ALL SELECT 'fallback', s_qn, s_label, s_path, NULL, d_qn, line FROM x WHERE (SELECT found FROM g) = 0 AND {_of_edge(_SPA_ANY)}""",
    # flows
    "impact_analysis__overrides": "SELECT d_qn AS method, s_qn AS affected FROM {t} WHERE type = 'OVERRIDES'",
    "trace_user_flow__boundaries": f"SELECT DISTINCT s_qn AS method, d_qn AS boundary, d_label AS type FROM {{t}} WHERE type = 'CALLS' AND {_like('d_qn', BOUNDARY)}",
    "trace_user_flow__details": "SELECT m.qn AS method, m.label AS type, m.visibility AS visibility, m.line AS line, f.d_path AS file_path, c.s_qn AS owner FROM {n} m LEFT JOIN {t} f ON f.type = 'SOURCE_FILE' AND f.s_id = m.id LEFT JOIN {t} c ON c.type = 'CONTAINS' AND c.d_id = m.id WHERE m.label IN ('Method', 'Function')",
}


def names() -> list[str]:
    return list(SECTIONS)


def call(graph: Graph, name: str, limit: int | None = None, **where) -> DataFrame:
    """One section, narrowed by equal values of its columns; ``limit`` takes the first rows in the order of all columns."""
    if name not in SECTIONS:
        raise KeyError(f"no such operator: {name}; there are {', '.join(SECTIONS)}")
    out = graph.sql(SECTIONS[name])
    for column, value in where.items():
        out = out.where(F.col(column).isNull() if value is None else F.col(column) == value)
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in out.columns]).limit(limit) if limit is not None else out


def search(graph: Graph, pattern: str, label: str | None = None) -> DataFrame:
    """Nodes whose name and qualified name hold all parts of ``pattern`` between ``*``, without letter case."""
    out = graph.sql(SECTIONS["search_nodes"])
    for part in filter(None, pattern.lower().split("*")):
        out = out.where(F.col("text").contains(part))
    return out.where(F.col("label") == label) if label else out
