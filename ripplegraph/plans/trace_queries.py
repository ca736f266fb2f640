"""Queries over runtime traces and registries: attribution, reconciliation, rules, labels.

The tables hold no run results, so the length of a test id stands for its status, and the
root of a trace names the target whose flows it declares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import labels, paths
from ripplegraph.operators import attribution, closure, graph, rules, scoring
from ripplegraph.plans.graph_queries import EDGES, ENTRIES, NODES, REGISTRIES, TEST_PATH, Inputs, _DEPS, _FOOT, query
from ripplegraph.session import table

SCHEMA_VERSION, EXTRACTION_VERSION = 9, 28


def _status(test):
    n = F.length(test) % 4
    return F.when(n == 0, "pass").when(n == 1, "fail").when(n == 2, "skip").otherwise("error")


def _test(record, test):
    return F.concat_ws("|", F.col(record).cast("string"), test)


def traced(i: Inputs) -> DataFrame:
    """``test, relpath, qualname`` of every traced pair."""
    t = i.journeys.flat.table("traced_symbol")
    return t.select(_test("record_id", "parent_key").alias("test"), "relpath", "qualname").distinct()


def declared(i: Inputs) -> DataFrame:
    """``test, journey, verdict`` of every declaration, by the target of its trace."""
    roots = table(i.spark, i.dir, "tgtrace").where("root is not null").groupBy(F.col("trace_id").alias("record_id")).agg(F.max(F.regexp_extract("root", r"(?:/srv/ci/|agents\\)([a-z]+)", 1)).alias("target"))
    d = i.journeys.flat.table("declaration").where("journey_id is not null").join(roots.where("target <> ''"), "record_id")
    verdict = attribution.verdict_of(_status(F.col("parent_key")))
    return d.select(_test("record_id", "parent_key").alias("test"), F.concat_ws(":", "target", "journey_id").alias("journey"), verdict.alias("verdict")).distinct()


def forms(i: Inputs) -> DataFrame:
    return attribution.named_frames(i.journeys.flat.table("traced_symbol").select("relpath", "qualname"))


def strict(i: Inputs) -> DataFrame:
    return i._once("strict", lambda: attribution.resolve_strict(forms(i), i.nodes))


def ran(i: Inputs, states: list[str]) -> DataFrame:
    """``test, id`` for traced forms in one of the states; ambiguous ones count as present."""
    known = strict(i).where(F.col("state").isin(states)).select("relpath", "qualname", "id")
    return traced(i).join(known, ["relpath", "qualname"]).select("test", "id").distinct()


def reaching(i: Inputs) -> DataFrame:
    entry = i.entries.where("id is not null").select("journey", "id").distinct()
    return ran(i, ["resolved"]).join(entry, "id").select("test", "journey").distinct()


def _orphans(i: Inputs) -> DataFrame:
    key = attribution.node_key(F.col("test_id")).alias("key")
    return attribution.orphans(i.journeys.flat.table("test").select(key), i.journeys.flat.table("declaring_test").select(key))


def _e2e(i: Inputs) -> DataFrame:
    n = F.length("test") % 5
    status = F.when(n == 0, "expected").when(n == 1, "unexpected").when(n == 2, "flaky").when(n == 3, "skipped").otherwise("expected-not-passed")
    return attribution.e2e_judge(declared(i).select("journey", status.alias("status")), i.journeys.journeys)


def _misses(i: Inputs) -> DataFrame:
    covered = ran(i, ["resolved"]).join(declared(i).select("test", "journey"), "test").select("journey", "id").distinct()
    return attribution.static_misses(covered.join(i.journeys.journeys.select("journey"), "journey", "left_semi"), i.feet)


def _calls(i: Inputs) -> DataFrame:
    """Calls whose source is in some footprint and whose ends the index knows."""
    ids = i.nodes.select("id")
    met = i._once("met", lambda: closure.reachable(i.starts.select(F.lit("all").alias("source_key"), "id"), graph.dependency_relation(i.edges)).select("id"))
    calls = i.edges.where("kind = 'calls'").join(met.select(F.col("id").alias("source")), "source", "left_semi")
    return calls.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def _support(i: Inputs) -> DataFrame:
    return attribution.runtime_support(_calls(i), ran(i, ["resolved", "ambiguous"]))


def _edge_verdicts(i: Inputs) -> DataFrame:
    calls = _calls(i).select("id", F.coalesce(F.col("provenance") != "heuristic", F.lit(True)).alias("supported"))
    verdict = attribution.edge_verdict(F.col("supported"), F.col("support"))
    return _support(i).join(calls, "id").withColumn("verdict", verdict).where("verdict is not null").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def spot_check_rows(i: Inputs) -> DataFrame:
    """``registry_id, name, file, min_caller_edges, suspended`` of all registries; a reason to suspend is a text."""
    r = table(i.spark, i.dir, "signedintake").select("registry_id", "spot_checks").distinct()
    parsed = F.from_json("spot_checks", "map<string, struct<min_caller_edges: bigint, file: string, suspended: string>>")
    rows = r.select("registry_id", F.explode(parsed).alias("name", "c"))
    return rows.select("registry_id", "name", F.coalesce("c.min_caller_edges", F.lit(0).cast("bigint")).alias("min_caller_edges"), F.col("c.file").alias("file"), F.when(F.col("c.suspended") != "false", F.col("c.suspended")).alias("suspended"))


def _registry_rows(i: Inputs) -> DataFrame:
    return table(i.spark, i.dir, "signedintake").select("registry_id", "approved", "codegraph_schema_version", "codegraph_extraction_version", "blind_spots").distinct()


def _findings(i: Inputs) -> DataFrame:
    r = _registry_rows(i)
    return rules.all_findings(rules.schema_pin(r, SCHEMA_VERSION), rules.extraction_pin(r, EXTRACTION_VERSION), rules.approval(r))


def _drift(i: Inputs) -> DataFrame:
    d = table(i.spark, i.dir, "documents").where("text is not null")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    files = d.select(path.alias("path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))
    now = d.select(path.alias("path"), F.encode(F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), "UTF-8").alias("content"))
    return rules.drift(files, now)


def all_paths(i: Inputs) -> DataFrame:
    """Paths of the index, of the files table, and of documents kept beside the code."""
    ext = F.element_at(F.array(*map(F.lit, [".md", ".yaml", ".sql", ".html", ".d.ts", ""])), (F.length("source") % 6 + 1).cast("int"))
    documents = table(i.spark, i.dir, "documents").where("source is not null").select(F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("docs")), ext).alias("path"))
    rest = i.nodes.select(F.col("file_path").alias("path")).unionByName(table(i.spark, i.dir, "files").select("path")).where("path is not null")
    return rest.unionByName(documents).distinct()


def _classes(i: Inputs) -> DataFrame:
    p = F.col("path")
    return all_paths(i).select("path", paths.is_product_path(p).alias("product"), paths.is_test_path(p).alias("test"), paths.exemption(p).alias("exempt"), paths.unmodeled_kind(p).alias("label"))


def trigger_rows(i: Inputs) -> DataFrame:
    r = table(i.spark, i.dir, "signedintake").select("registry_id", "file_triggers").distinct()
    parsed = F.from_json("file_triggers", "map<string, array<string>>")
    return r.select("registry_id", F.explode(parsed).alias("glob", "ids")).select("registry_id", "glob", F.explode("ids").alias("journey_id")).distinct()


def _triggers(i: Inputs) -> DataFrame:
    return scoring.trigger_hits(trigger_rows(i), all_paths(i))


def _stride(i: Inputs) -> DataFrame:
    return scoring.stride_sample(i.candidates.select("candidate_id").distinct(), "candidate_id", 50)


QUERIES = {
    "qualified_resolution": query(lambda i: strict(i)),
    "loose_resolution": query(lambda i: attribution.resolve_loose(forms(i), i.nodes)),
    "node_test_inverted_index": query(lambda i: attribution.tests_per_node(ran(i, ["resolved"]))),
    "node_test_pairs": query(lambda i: attribution.inverted(ran(i, ["resolved"]))),
    "trace_attribution": query(reaching),
    "verdict_orphans": query(_orphans),
    "journey_verdict_max": query(lambda i: attribution.worst_verdict(declared(i), ["journey"])),
    "verify_credit": query(lambda i: attribution.worst_verdict(attribution.credited(declared(i), reaching(i)), ["journey"])),
    "e2e_judge": query(_e2e),
    "static_misses": query(_misses),
    "edge_runtime_support": query(_support),
    "edge_verdict_counts": query(_edge_verdicts),
    "spot_check_findings": query(lambda i: rules.spot_checks(spot_check_rows(i), i.nodes, graph.caller_counts(i.edges))),
    "schema_and_pin_findings": query(_findings),
    "blocked_status": query(lambda i: rules.blocked(_findings(i))),
    "content_hash_drift": query(_drift),
    "epoch_normalised": query(lambda i: table(i.spark, i.dir, "files").select("path", rules.epoch_timestamp(F.col("indexed_at")).alias("indexed_at")).distinct()),
    "nodeid_key": query(lambda i: i.journeys.flat.table("test").select("test_id", attribution.node_key(F.col("test_id")).alias("key")).distinct()),
    "qualified_name": query(lambda i: forms(i).select("qualname").distinct().select("qualname", attribution.qualified(F.col("qualname")).alias("qualified"))),
    "path_classification": query(_classes),
    "trigger_join": query(_triggers),
    "slug_ids": query(lambda i: labels.flow_ids(i.journeys.entries.where("file is not null").select("file", "name").distinct())),
    "spot_check_candidates": query(lambda i: scoring.spot_check_scores(i.candidates)),
    "churn_score": query(lambda i: scoring.caller_churn(i.edges, i.nodes, scoring.churn_of_files(table(i.spark, i.dir, "edges"), i.nodes))),
    "coupling_arms": query(lambda i: scoring.arms(i.feet, 5)),
    "suffix_lookup": query(lambda i: scoring.suffix_lookup(i.journeys.flat.table("traced_symbol").select("relpath"), i.nodes)),
    "stride_sample": query(_stride),
}

_T = "t AS (SELECT trace_id, any_value(tests) AS tests, any_value(declared) AS declared, max(regexp_extract(root, '(?:/srv/ci/|agents\\\\)([a-z]+)', 1)) AS target FROM tgtrace GROUP BY trace_id)"
_TRACED = f"""{_T}, pairs AS (SELECT trace_id, e.key AS test_id, e.value AS items FROM (SELECT trace_id, unnest(map_entries(tests)) AS e FROM t)),
tr AS (SELECT DISTINCT CAST(trace_id AS VARCHAR) || '|' || test_id AS test, p[1] AS relpath, p[2] AS qualname FROM (SELECT trace_id, test_id, unnest(items) AS p FROM pairs)),
decl AS (SELECT trace_id, target, e.key AS test_id, e.value AS items FROM (SELECT trace_id, target, unnest(map_entries(declared)) AS e FROM t)),
dc AS (SELECT DISTINCT CAST(trace_id AS VARCHAR) || '|' || test_id AS test, target || ':' || jid AS journey, CASE length(test_id) % 4 WHEN 0 THEN 'pass' WHEN 2 THEN 'skip' ELSE 'fail' END AS verdict FROM (SELECT trace_id, target, test_id, unnest(items) AS jid FROM decl) WHERE jid IS NOT NULL AND target <> ''),
fm AS (SELECT relpath, qualname, list_extract(string_split(qualname, '.'), -1) AS name FROM (SELECT DISTINCT relpath, qualname FROM tr WHERE relpath <> '' AND qualname <> '')),
fr AS (SELECT * FROM fm WHERE NOT contains(name, '<'))"""
_HITS = """ht AS (SELECT f.relpath, f.qualname, f.name, s.id, s.qualified_name, coalesce(s.qualified_name = array_to_string(list_filter(string_split(f.qualname, '.'), lambda p: p <> '<locals>'), '::'), false) AS exact
  FROM fr f JOIN sym s ON s.name = f.name AND s.kind IS DISTINCT FROM 'file' AND (s.file_path = ltrim(f.relpath, '/') OR ends_with(s.file_path, '/' || ltrim(f.relpath, '/')))),
hc AS (SELECT relpath, qualname, count(*) AS hits, count_if(exact) AS exacts FROM ht GROUP BY ALL),
st AS (SELECT relpath, qualname, id, state FROM (SELECT h.relpath, h.qualname, h.id, CASE WHEN c.exacts > 0 THEN CASE WHEN h.exact THEN 'resolved' END WHEN c.hits = 1 AND (h.qualified_name IS NULL OR h.qualified_name IN ('', h.name)) THEN 'resolved' ELSE 'ambiguous' END AS state FROM ht h JOIN hc c ON c.relpath = h.relpath AND c.qualname = h.qualname) WHERE state IS NOT NULL
  UNION ALL SELECT relpath, qualname, NULL, 'unresolved' FROM fr WHERE NOT EXISTS (SELECT 1 FROM hc WHERE hc.relpath = fr.relpath AND hc.qualname = fr.qualname)),
rn AS (SELECT DISTINCT tr.test, st.id FROM tr JOIN st ON st.relpath = tr.relpath AND st.qualname = tr.qualname WHERE st.state = 'resolved'),
pr AS (SELECT DISTINCT tr.test, st.id FROM tr JOIN st ON st.relpath = tr.relpath AND st.qualname = tr.qualname WHERE st.state IN ('resolved', 'ambiguous'))"""
_FLOWS = f"{REGISTRIES}, {ENTRIES}"
_REACH = "rc AS (SELECT DISTINCT rn.test, e.journey FROM rn JOIN (SELECT DISTINCT journey, id FROM res WHERE id IS NOT NULL) e ON e.id = rn.id)"
_RANK = "CASE verdict WHEN 'fail' THEN 3 WHEN 'pass' THEN 2 WHEN 'skip' THEN 1 END"
_KEY = r"""concat(array_to_string(list_concat([replace(regexp_replace(split_part(split_part(test_id, '[', 1), '::', 1), '\.py$', ''), '/', '.')], list_filter(string_split(substr(split_part(test_id, '[', 1), length(split_part(split_part(test_id, '[', 1), '::', 1)) + 3), '::'), lambda p: p <> '')), '.'), substr(test_id, length(split_part(test_id, '[', 1)) + 1))"""
_SUPPORT = f"""WITH RECURSIVE {NODES}, {EDGES}, {_FLOWS}, {_DEPS.format(drop='')}, {_FOOT}, {_TRACED}, {_HITS},
cl AS (SELECT * FROM lnk WHERE kind = 'calls' AND source IN (SELECT id FROM foot) AND source IN (SELECT id FROM sym) AND target IN (SELECT id FROM sym)),
ob AS (SELECT DISTINCT c.id FROM cl c JOIN pr a ON a.id = c.source JOIN pr b ON b.id = c.target AND b.test = a.test),
su AS (SELECT c.id, c.provenance, CASE WHEN c.id IN (SELECT id FROM ob) THEN 'observed' WHEN c.source IN (SELECT id FROM pr) THEN 'not-observed' ELSE 'untested' END AS support FROM cl c)"""
_PATHS = "ap AS (SELECT file_path AS path FROM sym WHERE file_path IS NOT NULL UNION SELECT path FROM files WHERE path IS NOT NULL UNION SELECT source || '/' || coalesce(lang, 'docs') || ['.md', '.yaml', '.sql', '.html', '.d.ts', ''][length(source) % 6 + 1] FROM documents WHERE source IS NOT NULL)"
_EXT = "regexp_extract(regexp_extract(path, '[^/]*$'), '[^.](\\.[^.]*)$', 1)"
_PINS = "rr AS (SELECT DISTINCT registry_id, approved, codegraph_schema_version AS sv, codegraph_extraction_version AS ev, blind_spots AS bs FROM signedintake)"
_FINDINGS = f"""{_PINS}, fi AS (SELECT 'schema' AS rule, CASE WHEN sv IS NULL THEN 'warning' ELSE 'blocking' END AS severity, CAST(registry_id AS VARCHAR) AS subject, CASE WHEN sv IS NULL THEN 'unpinned' ELSE 'differs' END AS message FROM rr WHERE sv IS NULL OR sv <> 9
  UNION ALL SELECT 'extraction', 'warning', CAST(registry_id AS VARCHAR), CASE WHEN ev IS NULL THEN 'unpinned' WHEN ev > 28 THEN 'older' ELSE 'newer' END FROM rr WHERE ev IS NULL OR ev <> 28
  UNION ALL SELECT 'approval', 'warning', CAST(registry_id AS VARCHAR), CASE WHEN approved IS NULL THEN 'approval missing' ELSE 'not approved' END || CASE WHEN len(bs) > 0 THEN '; ' || len(bs) || ' blind spots' ELSE '' END FROM rr WHERE approved IS NULL OR NOT approved)"""

ORACLES = {
    "qualified_resolution": f"WITH {NODES}, {_TRACED}, {_HITS} SELECT relpath, qualname, id, state FROM st",
    "loose_resolution": f"WITH {NODES}, {_TRACED}, {_HITS} SELECT h.relpath, h.qualname, h.id, c.hits > 1 AS ambiguous FROM ht h JOIN hc c ON c.relpath = h.relpath AND c.qualname = h.qualname",
    "node_test_inverted_index": f"WITH {NODES}, {_TRACED}, {_HITS} SELECT id, count(*) AS n_tests, min(test) AS first_test FROM rn GROUP BY id",
    "node_test_pairs": f"WITH {NODES}, {_TRACED}, {_HITS} SELECT id, test, count(*) OVER (PARTITION BY id) AS n_tests FROM rn",
    "trace_attribution": f"WITH {NODES}, {_FLOWS}, {_TRACED}, {_HITS}, {_REACH} SELECT test, journey FROM rc",
    "verdict_orphans": f"WITH {_T}, a AS (SELECT DISTINCT {_KEY} AS key FROM (SELECT unnest(map_keys(tests)) AS test_id FROM t)), b AS (SELECT DISTINCT {_KEY} AS key FROM (SELECT unnest(map_keys(declared)) AS test_id FROM t)) SELECT key, 'no-verdict' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'no-trace' FROM b WHERE key NOT IN (SELECT key FROM a)",
    "journey_verdict_max": f"WITH {_TRACED} SELECT journey, arg_max(verdict, {_RANK}) AS verdict, count(*) AS tests FROM dc GROUP BY journey",
    "verify_credit": f"WITH {NODES}, {_FLOWS}, {_TRACED}, {_HITS}, {_REACH} SELECT journey, arg_max(verdict, {_RANK}) AS verdict, count(*) AS tests FROM dc WHERE verdict = 'fail' OR EXISTS (SELECT 1 FROM rc WHERE rc.test = dc.test AND rc.journey = dc.journey) GROUP BY journey",
    "e2e_judge": f"""WITH {_FLOWS.split(', res AS')[0].rsplit(',' + chr(10) + 'res AS', 1)[0]}, {_TRACED}, flows AS (SELECT DISTINCT h.target || ':' || j.journey_id AS journey FROM jny j JOIN held h ON h.registry_id = j.registry_id),
x AS (SELECT f.journey, d.test, length(d.test) % 5 AS m FROM flows f LEFT JOIN dc d ON d.journey = f.journey),
y AS (SELECT journey, count(test) AS runs, coalesce(bool_or(m = 0), false) AS e, coalesce(bool_or(m = 1), false) AS u, coalesce(bool_or(m = 2), false) AS f, coalesce(bool_or(m = 3), false) AS s, coalesce(bool_or(m = 4), false) AS n FROM x GROUP BY journey)
SELECT journey, CASE WHEN runs = 0 THEN 'uncovered' WHEN u THEN 'fail' WHEN f THEN 'incomplete' WHEN e THEN 'pass' WHEN n AND NOT s THEN 'incomplete' ELSE 'skip' END AS verdict,
  CASE WHEN runs = 0 OR u THEN NULL WHEN f THEN 'flaky' WHEN e THEN NULL WHEN n AND NOT s THEN 'expected-fail' ELSE 'skipped' END AS reason, runs FROM y""",
    "static_misses": f"""WITH RECURSIVE {NODES}, {EDGES}, {_FLOWS}, {_DEPS.format(drop='')}, {_FOOT}, {_TRACED}, {_HITS}, flows AS (SELECT DISTINCT h.target || ':' || j.journey_id AS journey FROM jny j JOIN held h ON h.registry_id = j.registry_id)
SELECT DISTINCT d.journey, r.id FROM rn r JOIN dc d ON d.test = r.test WHERE d.journey IN (SELECT journey FROM flows) AND NOT EXISTS (SELECT 1 FROM foot f WHERE f.journey = d.journey AND f.id = r.id)""",
    "edge_runtime_support": f"{_SUPPORT} SELECT id, support FROM su",
    "edge_verdict_counts": f"{_SUPPORT} SELECT CASE support WHEN 'observed' THEN 'oracle-gap' WHEN 'not-observed' THEN 'phantom-confirmed' ELSE 'phantom-source-only' END AS verdict, count(*) AS n FROM su WHERE provenance = 'heuristic' GROUP BY 1",
    "spot_check_findings": f"""WITH {NODES}, {EDGES}, c AS (SELECT target, count(*) AS n FROM lnk WHERE kind IN ('calls', 'references', 'instantiates', 'imports') GROUP BY target),
q AS (SELECT DISTINCT r.registry_id, e.key AS name, e.value ->> '$.file' AS file, coalesce(CAST(e.value ->> '$.min_caller_edges' AS BIGINT), 0) AS least, nullif(nullif(trim(e.value ->> '$.suspended'), ''), 'false') AS held FROM (SELECT DISTINCT registry_id, spot_checks FROM signedintake WHERE json_valid(spot_checks)) r, json_each(r.spot_checks::JSON) e),
m AS (SELECT q.*, (SELECT sum(coalesce(c.n, 0)) FROM sym s LEFT JOIN c ON c.target = s.id WHERE s.name = q.name AND s.kind IS DISTINCT FROM 'file' AND (q.file IS NULL OR s.file_path = ltrim(q.file, '/') OR ends_with(s.file_path, '/' || ltrim(q.file, '/')))) AS total FROM q)
SELECT 'spot-check' AS rule, CASE WHEN held IS NOT NULL THEN 'warning' ELSE 'blocking' END AS severity, CAST(registry_id AS VARCHAR) || ':' || name AS subject, CASE WHEN held IS NOT NULL THEN 'suspended: ' || held WHEN total IS NULL THEN 'missing' ELSE 'below floor' END AS message FROM m WHERE held IS NOT NULL OR total IS NULL OR total < least""",
    "schema_and_pin_findings": f"WITH {_FINDINGS} SELECT rule, severity, subject, message FROM fi",
    "blocked_status": f"WITH {_FINDINGS} SELECT CASE WHEN count_if(severity = 'blocking') > 0 THEN 'BLOCKED' ELSE 'OK' END AS status, count_if(severity = 'blocking')::BIGINT AS blocking, count_if(severity = 'warning')::BIGINT AS warnings FROM fi",
    "content_hash_drift": "SELECT DISTINCT 'doc/' || CAST(doc_id AS VARCHAR) AS path FROM documents WHERE text IS NOT NULL AND sha256(CASE WHEN doc_id % 17 = 0 THEN text || ' ' ELSE text END) <> sha256(text)",
    "epoch_normalised": "SELECT DISTINCT path, CAST(epoch_ms(CASE WHEN indexed_at > 1000000000000 THEN indexed_at ELSE indexed_at * 1000 END) AS TIMESTAMP) AS indexed_at FROM files",
    "nodeid_key": f"WITH {_T} SELECT DISTINCT test_id, {_KEY} AS key FROM (SELECT unnest(map_keys(tests)) AS test_id FROM t)",
    "qualified_name": f"WITH {_TRACED} SELECT DISTINCT qualname, array_to_string(list_filter(string_split(qualname, '.'), lambda p: p <> '<locals>'), '::') AS qualified FROM fr",
    "path_classification": f"""WITH {NODES}, {_PATHS}, x AS (SELECT path, regexp_extract(path, '[^/]*$') AS base, {_EXT} AS ext, {TEST_PATH.format(p='path')} AS test, regexp_matches(path, '\\.d\\.(ts|mts|cts)$') AS declaration FROM ap)
SELECT path, regexp_matches(path, '\\.(py|js|jsx|mjs|cjs|ts|tsx|mts|cts|svelte|vue)$') AND NOT declaration AND NOT test AS product, test,
  CASE WHEN regexp_matches(path, '(^|/)(tests|e2e|__tests__)/') THEN 'test' WHEN declaration THEN 'type declaration' WHEN regexp_matches(path, '\\.(md|rst|adoc)$') OR regexp_matches(path, '^(docs|doc)/') OR (upper(left(base, length(base) - length(ext))) IN ('LICENSE', 'COPYING', 'CHANGELOG', 'NOTICE', 'AUTHORS') AND lower(ext) IN ('', '.txt', '.md', '.rst', '.adoc')) THEN 'docs' END AS exempt,
  CASE WHEN ext <> '' THEN ext || ' file' ELSE base END AS label FROM x""",
    "trigger_join": f"""WITH {NODES}, {_PATHS}, g AS (SELECT DISTINCT r.registry_id, e.key AS pattern, j.value ->> '$' AS journey_id FROM (SELECT DISTINCT registry_id, file_triggers FROM signedintake WHERE json_valid(file_triggers)) r, json_each(r.file_triggers::JSON) e, json_each(e.value) j)
SELECT DISTINCT registry_id, pattern AS "glob", journey_id, path FROM g JOIN ap ON pattern LIKE '**/*.%' AND regexp_matches(path, '^(?:[^/]+/)*[^/]*\\.' || substr(pattern, 6) || '$')""",
    "slug_ids": f"""WITH {REGISTRIES}, {ENTRIES.split(',' + chr(10) + 'res AS')[0]}, e AS (SELECT DISTINCT file, name FROM ent WHERE name IS NOT NULL AND file IS NOT NULL),
b AS (SELECT file, name, CASE WHEN regexp_matches(file, '^.+\\.[^./]*$') THEN regexp_replace(file, '\\.[^./]*$', '') ELSE file END AS bare FROM e),
c AS (SELECT *, CASE WHEN regexp_matches(file, '\\.(ts|tsx)$') AND regexp_extract(bare, '[^/]*$') IN ('route', 'page', 'layout', 'index', 'actions') AND contains(bare, '/') THEN split_part(bare, '/', -2) ELSE regexp_extract(bare, '[^/]*$') END AS stem FROM b),
d AS (SELECT *, 'J_' || coalesce(nullif(trim(regexp_replace(stem, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_'), ''), 'x') || '_' || coalesce(nullif(trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_'), ''), 'x') AS short,
  'J_' || coalesce(nullif(trim(regexp_replace(bare, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_'), ''), 'x') || '_' || coalesce(nullif(trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_'), ''), 'x') AS long FROM c),
f AS (SELECT file, name, CASE WHEN count(*) OVER (PARTITION BY short) = 1 THEN short ELSE long END AS candidate FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY file, name) AS k FROM f)
SELECT file, name, CASE WHEN k = 1 THEN candidate ELSE candidate || '_' || CAST(k AS VARCHAR) END AS journey_id FROM n""",
    "spot_check_candidates": f"""SELECT candidate_id, index_run, name, fan_in, CAST(trunc(fan_in * 0.8::DOUBLE) AS BIGINT) AS floor, round(fan_in / (1.0::DOUBLE + round(caller_churn, 2)), 2) AS score
  FROM (SELECT DISTINCT * FROM mealie_all) WHERE fan_in IS NOT NULL AND caller_churn IS NOT NULL AND file IS NOT NULL AND NOT {TEST_PATH.format(p='file')} AND trunc(fan_in * 0.8::DOUBLE) >= 2 AND fan_in - trunc(fan_in * 0.8::DOUBLE) >= 2""",
    "churn_score": f"""WITH {NODES}, {EDGES}, ch AS (SELECT s.file_path, count(DISTINCT e.index_run) AS churn FROM edges e JOIN sym s ON s.id = e.source WHERE s.file_path IS NOT NULL GROUP BY s.file_path)
SELECT e.target, avg(coalesce(ch.churn, 0)) AS churn, count(*) AS callers FROM lnk e LEFT JOIN sym s ON s.id = e.source LEFT JOIN ch ON ch.file_path = s.file_path WHERE e.kind IN ('calls', 'references', 'instantiates', 'imports') GROUP BY e.target""",
    "coupling_arms": f"""WITH RECURSIVE {NODES}, {EDGES}, {REGISTRIES}, {ENTRIES}, {_DEPS.format(drop='')}, {_FOOT}, total AS (SELECT count(DISTINCT journey) AS n FROM foot), core AS (SELECT id FROM foot, total GROUP BY id, n HAVING count(DISTINCT journey) >= 0.5 * n),
o AS (SELECT journey, count(c.id) AS overlap, count(*) AS size FROM foot f LEFT JOIN core c ON c.id = f.id GROUP BY journey), r AS (SELECT *, row_number() OVER (ORDER BY overlap DESC, size DESC, journey) AS top, row_number() OVER (ORDER BY overlap, size, journey DESC) AS bottom FROM o)
SELECT journey, overlap, size, CASE WHEN top <= 5 THEN 'coupled' ELSE 'apart' END AS arm FROM r WHERE top <= 5 OR bottom <= 5""",
    "suffix_lookup": f"""WITH {NODES}, {_TRACED}, q AS (SELECT DISTINCT relpath FROM tr WHERE relpath <> ''), x AS (SELECT relpath, string_split(relpath, '/') AS p FROM q), y AS (SELECT relpath, i, array_to_string(p[i:], '/') AS suffix FROM (SELECT relpath, p, unnest(range(1, len(p) + 1)) AS i FROM x)),
z AS (SELECT y.relpath, y.suffix, row_number() OVER (PARTITION BY y.relpath ORDER BY y.i) AS rn FROM y WHERE y.suffix IN (SELECT file_path FROM sym WHERE file_path IS NOT NULL)) SELECT relpath, suffix AS file_path FROM z WHERE rn = 1""",
    "stride_sample": "WITH c AS (SELECT candidate_id, row_number() OVER (ORDER BY candidate_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT candidate_id FROM mealie_all)), w AS (SELECT DISTINCT CAST(floor(i * (n / 50.0::DOUBLE)) AS BIGINT) AS pos FROM (SELECT max(n) AS n FROM c), range(50) r(i)) SELECT c.candidate_id FROM c WHERE n <= 50 OR pos IN (SELECT pos FROM w)",
}

_PRODUCT = f"regexp_matches(path, '\\.(py|js|jsx|mjs|cjs|ts|tsx|mts|cts|svelte|vue)$') AND NOT regexp_matches(path, '\\.d\\.(ts|mts|cts)$') AND NOT {TEST_PATH.format(p='path')}"
_EXEMPT = f"regexp_matches(path, '(^|/)(tests|e2e|__tests__)/') OR regexp_matches(path, '\\.d\\.(ts|mts|cts)$') OR regexp_matches(path, '\\.(md|rst|adoc)$') OR regexp_matches(path, '^(docs|doc)/') OR (upper(left(regexp_extract(path, '[^/]*$'), length(regexp_extract(path, '[^/]*$')) - length({_EXT}))) IN ('LICENSE', 'COPYING', 'CHANGELOG', 'NOTICE', 'AUTHORS') AND lower({_EXT}) IN ('', '.txt', '.md', '.rst', '.adoc'))"


def _degrade_sql() -> str:
    from ripplegraph.plans.graph_queries import ORACLES as graph_sql

    ranked = graph_sql["journey_rank"]
    head, tail = ranked.rsplit("\nSELECT t.journey", 1)
    return f"""{head}, ranked AS (SELECT t.journey{tail}), {_PATHS},
flows AS (SELECT DISTINCT h.target || ':' || j.journey_id AS journey FROM jny j JOIN held h ON h.registry_id = j.registry_id),
dp AS (SELECT path FROM ap WHERE NOT ({_PRODUCT})),
g AS (SELECT DISTINCT h.target, e.key AS pattern, j.value ->> '$' AS journey_id FROM (SELECT DISTINCT registry_id, file_triggers FROM signedintake WHERE json_valid(file_triggers)) r JOIN held h ON h.registry_id = r.registry_id, json_each(r.file_triggers::JSON) e, json_each(e.value) j),
hits AS (SELECT g.target || ':' || g.journey_id AS journey, g.pattern, dp.path FROM g JOIN dp ON g.pattern LIKE '**/*.%' AND regexp_matches(dp.path, '^(?:[^/]+/)*[^/]*\\.' || substr(g.pattern, 6) || '$')),
named AS (SELECT journey, array_to_string(list_sort(list_distinct(list(pattern))), ',') AS triggered_by FROM hits WHERE journey IN (SELECT journey FROM flows) GROUP BY journey),
um AS (SELECT count(*) AS n FROM (SELECT DISTINCT file_path FROM hunks WHERE index_run = (SELECT max(index_run) FROM hunks)) WHERE file_path NOT IN (SELECT file_path FROM seeds)),
ut AS (SELECT count(*) AS n FROM dp WHERE NOT coalesce({_EXEMPT}, false) AND path NOT IN (SELECT path FROM hits)),
both_ AS (SELECT coalesce(r.journey, n.journey) AS journey, coalesce(r.rank, 0) AS rank, coalesce(r.entries_hit, 0) AS entries_hit, coalesce(r.confidence, 1.0::DOUBLE) AS confidence, coalesce(r.verify, false) AS verify, CASE WHEN r.journey IS NULL THEN 'file-trigger' ELSE r.weak_reason END AS reason, n.triggered_by FROM ranked r FULL JOIN named n ON n.journey = r.journey)
SELECT journey, rank, entries_hit, confidence, verify, reason, triggered_by FROM both_
UNION ALL SELECT f.journey, 0, 0, 0.0::DOUBLE, true, CASE WHEN um.n > 0 THEN 'unmapped-files' ELSE 'unmodeled-paths' END, NULL FROM flows f, um, ut WHERE (um.n > 0 OR ut.n > 0) AND f.journey NOT IN (SELECT journey FROM both_)"""


ORACLES["degrade_rows"] = _degrade_sql()
