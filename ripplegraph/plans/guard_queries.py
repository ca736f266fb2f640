"""Queries over refusals, guards, order and labels.

The tables hold no source tree, so the index stands for what the sources define; writes are
those that the declared runs would make.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import labels
from ripplegraph.functions.paths import exemption, is_product_path
from ripplegraph.operators import attribution, graph, guards, impact, journeys, ledger, scoring
from ripplegraph.plans import event_queries, trace_queries
from ripplegraph.plans.graph_queries import EDGES, ENTRIES, NODES, ORACLES as GRAPH_SQL, REGISTRIES, TEST_PATH, Inputs, query
from ripplegraph.plans.trace_queries import _FINDINGS, _HITS, _RANK, _REACH, _T, _TRACED, ORACLES as TRACE_SQL
from ripplegraph.session import table

_FLOWS_SQL = f"{REGISTRIES}, {ENTRIES}"


def _registries(i: Inputs) -> DataFrame:
    return table(i.spark, i.dir, "signedintake")


def _trigger_problems(i: Inputs) -> DataFrame:
    named = i.journeys.flat.table("journey").select(F.col("record_id").alias("registry_id"), "journey_id")
    return guards.trigger_problems(_registries(i), named)


def _entry_drift(i: Inputs) -> DataFrame:
    defined = i.nodes.where("kind is distinct from 'file'").select(F.col("file_path").alias("path"), "name")
    drift = guards.live_drift(i.journeys.entries, table(i.spark, i.dir, "files").select("path"), defined)
    return drift.select("*", guards.remedy(F.col("reason")).alias("remedy"))


def _writes(i: Inputs) -> DataFrame:
    """What the declared runs would record: some with an odd verdict or revision."""
    n = F.length("test")
    commit = F.when(n % 7 == 0, F.concat(F.lit("-"), "test")).when(n % 7 == 1, F.col("test")).otherwise(F.concat(F.md5("test"), F.lit("00000000")))
    return trace_queries.declared(i).select("journey", F.when(n % 11 == 0, "maybe").otherwise(F.col("verdict")).alias("verdict"), commit.alias("commit")).distinct()


def _rank(i: Inputs) -> DataFrame:
    return impact.rank_journeys(i.reached, i.entries, graph.caller_counts(i.edges))


def _recall(i: Inputs) -> DataFrame:
    changed = i.last_hunks.select("file_path").distinct()
    documents = trace_queries.all_paths(i).where(~is_product_path(F.col("path")) & exemption(F.col("path")).isNull())
    held = journeys.resolve_registries(_registries(i)).select("registry_id")
    hits = scoring.trigger_hits(trace_queries.trigger_rows(i).join(held, "registry_id", "left_semi"), documents)
    untriggered = documents.join(hits.select("path").distinct(), "path", "left_anti")
    return guards.recall_state(changed, impact.unmapped(changed, i.seeds), untriggered, i.seeds, i.reached)


def _lost(i: Inputs) -> DataFrame:
    drifted = table(i.spark, i.dir, "files").where("content_hash is null").select("path")
    changed = i.hunks.select("file_path")
    return impact.lost_files(changed, impact.seeds_of_hunks(i.hunks, i.nodes), drifted)


def _discovery(i: Inputs) -> DataFrame:
    name = F.concat("target", F.col("registry_id").cast("string"), F.when(F.coalesce("approved", F.lit(False)), ".json").when(F.col("registry_id") % 9 == 0, ".yaml").otherwise(".draft.json"))
    found = _registries(i).select((F.col("registry_id") % 3).cast("int").alias("folder_rank"), name.alias("file_name"), "target")
    return journeys.discover(found)


def _test_map(i: Inputs) -> DataFrame:
    tests = i.journeys.flat.table("test").select(F.col("test_id").alias("test")).distinct()
    file = F.regexp_replace(F.substring_index("test", "::", 1), "^[^/]*/", "")
    files = tests.where(F.length("test") % 2 == 0).select(file.alias("key"))
    keys = files.unionByName(tests.where(F.length("test") % 6 == 0).select(F.col("test").alias("key"))).distinct()
    mapping = keys.select("key", F.concat(F.lit("M"), (F.length("key") % 5).cast("string")).alias("journey"))
    return attribution.journeys_of_tests(tests, mapping)


def _picks(i: Inputs) -> DataFrame:
    return scoring.spot_check_picks(scoring.spot_check_scores(i.candidates), i.journeys.entries)


def _export(spark, sf_dir: str) -> DataFrame:
    outcomes, selections = event_queries.outcomes(spark, sf_dir), event_queries.selections(spark, sf_dir)
    rows = ledger.buckets(outcomes, selections)
    summary = ledger.totals(rows).join(ledger.ledger_counts(outcomes, selections), "repo")
    return ledger.export_payload(summary, ledger.history(rows)).select("repo", "content")


def _expressions(i: Inputs) -> DataFrame:
    ids = F.array_sort(F.collect_set("journey_id"))
    grouped = i.journeys.journeys.groupBy("target").agg(ids.alias("ids"))
    return grouped.select("target", labels.marker_expression(F.col("ids")).alias("markers"), labels.grep_expression(F.col("ids")).alias("title_filter"), labels.name_pattern(F.col("ids")).alias("name_filter"))


def _refusals(i: Inputs) -> DataFrame:
    above = i.dir.rstrip("/").rsplit("/", 1)[0]
    return guards.index_findings(i.spark, [i.dir, f"{i.dir}/none", above]).select("rule", "severity", "message")


def _versions(i: Inputs) -> DataFrame:
    r = _registries(i)
    recorded = F.when(F.col("registry_id") % 2 == 0, F.col("codegraph_extraction_version").cast("string")).otherwise("unknown")
    metadata = r.select(F.lit("extractor").alias("key"), recorded.alias("value"))
    schema = guards.schema_version(r.select(F.col("codegraph_schema_version").alias("version")))
    return schema.select(F.lit("schema").alias("what"), "version").unionByName(guards.extraction_version(metadata, "extractor").select(F.lit("extractor").alias("what"), "version"))


def _pending(i: Inputs) -> DataFrame:
    status = F.when(F.coalesce("target", F.lit("")) == "", "pending").otherwise("resolved")
    refs = table(i.spark, i.dir, "edges").select("id", "target").distinct().select(status.alias("status"))
    found = guards.pending_guard(refs, 10, 9, 9)
    for lacking, have in ((None, 9), (refs.select(F.col("status").alias("state")), 8)):
        found = found.unionByName(guards.pending_guard(lacking, 10, 9, have))
    return found


def _unresolved_then(i: Inputs) -> DataFrame:
    """Flows that the index could not name when it was a month old."""
    raw = table(i.spark, i.dir, "nodes")
    first = raw.agg(F.date_trunc("month", F.min("indexed_at")).alias("t")).first()["t"]
    if first is None:
        return journeys.unresolved_journeys(i.entries)
    cut = F.lit(first.isoformat(sep=" ")).cast("timestamp_ntz") + F.expr("interval 1 month")
    then = graph.symbols(raw.where(F.col("indexed_at").cast("timestamp_ntz") < cut).withColumn("removed_at", F.lit(None).cast("timestamp")))
    return journeys.unresolved_journeys(journeys.resolve_entries(i.journeys.entries, then))


def _because(i: Inputs) -> DataFrame:
    warned = trace_queries._findings(i).where("severity = 'warning'")
    return guards.unknown_because(i.journeys.journeys.where("journey is null"), warned, i.seeds.limit(0), guards.unchecked_entries(i.journeys.entries))


def _states(i: Inputs) -> DataFrame:
    told = trace_queries.declared(i)
    credit = attribution.worst_verdict(attribution.credited(told, trace_queries.reaching(i)), ["journey"])
    return guards.verify_states(i.journeys.journeys, credit, told)


QUERIES = {
    "trigger_problems": query(_trigger_problems),
    "entry_drift": query(_entry_drift),
    "unchecked_entries": query(lambda i: guards.unchecked_entries(i.journeys.entries)),
    "refused_outcomes": query(lambda i: guards.refused_outcomes(_writes(i), i.journeys.journeys)),
    "accepted_outcomes": query(lambda i: guards.accepted_outcomes(_writes(i), i.journeys.journeys)),
    "answer_order": query(lambda i: impact.in_order(_rank(i)).select("position", "journey", "rank")),
    "recall_state": query(_recall),
    "lost_files": query(_lost),
    "file_node_lookup": query(lambda i: impact.file_nodes(i.hunks, i.nodes)),
    "file_map": query(lambda i: impact.file_map(i.nodes)),
    "registry_discovery": query(_discovery),
    "harness_resolution": query(lambda i: attribution.resolve_harness(i.journeys.flat.table("traced_symbol").select("relpath", "qualname"), i.nodes)),
    "test_journey_map": query(_test_map),
    "top_fanin_callers": query(lambda i: impact.fan_in_by_name(i.edges, i.nodes, 40)[1]),
    "spot_check_picks": query(_picks),
    "ledger_export": _export,
    "filter_expressions": query(_expressions),
    "index_refusals": query(_refusals),
    "index_versions": query(_versions),
    "pending_guard": query(_pending),
    "unresolved_then": query(_unresolved_then),
    "unknown_because": query(_because),
    "verify_states": query(_states),
    "last_run_dates": query(lambda i: table(i.spark, i.dir, "files").select("path", labels.date_text(F.when(F.col("indexed_at") > 10**12, F.floor(F.col("indexed_at") / 1000)).otherwise(F.col("indexed_at")).cast("long")).alias("day")).distinct()),
}

_JNY = _FLOWS_SQL.rsplit(",\nlst AS", 1)[0]
_HELD_FLOWS = "flows AS (SELECT DISTINCT h.target, j.journey_id, h.target || ':' || j.journey_id AS journey FROM jny j JOIN held h ON h.registry_id = j.registry_id)"
_ENT = _FLOWS_SQL.split(",\nres AS")[0]
_BAD_GLOB = r"(regexp_matches(pat, '[\[\]!{}\\]') OR len(list_filter(string_split(pat, '/'), lambda p: p IN ('', '.', '..') OR (contains(p, '**') AND p <> '**'))) > 0 OR len(list_filter(string_split(pat, '/'), lambda p: p = '**')) > 2)"
_BAD_IDS = "(json_type(ids) <> 'ARRAY' OR json_array_length(ids) = 0 OR len(list_filter(CAST(ids AS JSON[]), lambda x: json_type(x) <> 'VARCHAR')) > 0)"
_WRITES = f"""wr AS (SELECT DISTINCT journey, CASE WHEN length(test) % 11 = 0 THEN 'maybe' ELSE verdict END AS verdict,
  CASE length(test) % 7 WHEN 0 THEN '-' || test WHEN 1 THEN test ELSE md5(test) || '00000000' END AS "commit" FROM dc)"""
_ESCAPED = r"regexp_replace(list_string, '([\\.^$|?*+()\[\]{}\-#&~\s])', '\\\1', 'g')"


def _tags(template: str) -> str:
    return f"array_to_string(list_transform(ids, lambda j: {_ESCAPED.replace('list_string', chr(39) + template + chr(39) + ' || j')}), '|')"


def _order_sql() -> str:
    head = GRAPH_SQL["journey_rank"].rsplit("\nSELECT t.journey", 1)[0]
    parts = "regexp_extract(journey, '^(.*?)([0-9]*)$', 1), coalesce(TRY_CAST(nullif(regexp_extract(journey, '^(.*?)([0-9]*)$', 2), '') AS BIGINT), -1), journey"
    return f"{head} SELECT row_number() OVER (ORDER BY rank DESC, {parts}) AS position, journey, CAST(rank AS BIGINT) AS rank FROM top"


def _recall_sql() -> str:
    head = TRACE_SQL["degrade_rows"].rsplit(",\nboth_ AS", 1)[0]
    return f"""{head}, c AS (SELECT count(DISTINCT file_path) AS n FROM hunks WHERE index_run = (SELECT max(index_run) FROM hunks))
SELECT um.n > 0 OR ut.n > 0 AS recall_degraded, c.n AS changed_files, um.n AS unmapped_files, ut.n AS unmodeled_files, (SELECT count(DISTINCT id) FROM seeds) AS seed_symbols, (SELECT count(DISTINCT id) FROM reached) AS impacted_symbols FROM um, ut, c"""


def _export_sql() -> str:
    from ripplegraph.plans.event_queries import ORACLES as event_sql

    return f"""SELECT repo, printf('Ledger of %s: %d selections, %d outcomes, %d commits with both. ', repo, selections, outcomes, judged_commits) ||
  CASE WHEN caught + missed > 0 THEN printf('Observed recall %.2f over %d judged failures (%d missed in silence).', observed_recall, caught + missed, missed) ELSE 'No failure was judged yet, so recall is not known.' END AS content
FROM ({event_sql['ledger_totals']})"""


ORACLES = {
    "trigger_problems": f"""WITH {_JNY}, r AS (SELECT DISTINCT registry_id, trim(file_triggers) AS t FROM signedintake WHERE file_triggers IS NOT NULL),
e AS (SELECT registry_id, x.key AS pat, x.value AS ids FROM (SELECT * FROM r WHERE json_valid(t)) q, json_each(q.t::JSON) x WHERE json_type(q.t::JSON) = 'OBJECT'),
s AS (SELECT *, CASE WHEN {_BAD_GLOB} THEN 'glob' WHEN {_BAD_IDS} THEN 'ids' END AS state FROM e),
k AS (SELECT registry_id, pat, unnest(CAST(ids AS VARCHAR[])) AS jid FROM s WHERE state IS NULL)
SELECT DISTINCT 'trigger' AS rule, 'blocking' AS severity, subject, message FROM (
  SELECT CAST(registry_id AS VARCHAR) AS subject, 'shape' AS message FROM r WHERE t <> 'null' AND (NOT json_valid(t) OR json_type(CASE WHEN json_valid(t) THEN t END::JSON) <> 'OBJECT')
  UNION ALL SELECT registry_id || ':' || pat, state FROM s WHERE state IS NOT NULL
  UNION ALL SELECT registry_id || ':' || pat || ':' || jid, 'unknown journey' FROM k WHERE NOT EXISTS (SELECT 1 FROM jny j WHERE j.registry_id = k.registry_id AND j.journey_id = k.jid))""",
    "entry_drift": f"""WITH {NODES}, {_ENT}, a AS (SELECT DISTINCT journey, name, file FROM ent WHERE name IS NOT NULL AND ends_with(file, '.py')),
f AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL), c AS (SELECT DISTINCT a.file, f.path FROM (SELECT DISTINCT file FROM a) a JOIN f ON f.path = ltrim(a.file, '/') OR ends_with(f.path, '/' || ltrim(a.file, '/'))),
m AS (SELECT a.*, EXISTS (SELECT 1 FROM c WHERE c.file = a.file) AS there, EXISTS (SELECT 1 FROM c JOIN sym s ON s.file_path = c.path WHERE c.file = a.file AND s.name = a.name AND s.kind IS DISTINCT FROM 'file') AS defined FROM a)
SELECT journey, name, file, CASE WHEN there THEN 'not defined' ELSE 'no such file' END AS reason, CASE WHEN there THEN 'index again if the change is committed, else commit it; or correct the entry' ELSE 'correct the entry''s file, or bring the file back' END AS remedy FROM m WHERE NOT defined""",
    "unchecked_entries": f"WITH {_ENT} SELECT DISTINCT journey, name, file FROM ent WHERE name IS NOT NULL AND file <> '' AND NOT ends_with(file, '.py')",
    "refused_outcomes": f"""WITH {_JNY}, {_HELD_FLOWS}, {_TRACED}, {_WRITES}, z AS (SELECT *, CASE WHEN verdict NOT IN ('pass', 'fail', 'skip') THEN 'unknown verdict' WHEN journey NOT IN (SELECT journey FROM flows) THEN 'unknown journey'
  WHEN starts_with("commit", '-') THEN 'option for a revision' WHEN NOT regexp_full_match("commit", '[0-9a-f]{{40}}') THEN 'no commit' END AS reason FROM wr) SELECT journey, verdict, "commit", reason FROM z WHERE reason IS NOT NULL""",
    "accepted_outcomes": f"""WITH {_JNY}, {_HELD_FLOWS}, {_TRACED}, {_WRITES} SELECT journey, verdict, "commit" FROM wr WHERE verdict <> 'maybe' AND journey IN (SELECT journey FROM flows) AND regexp_full_match("commit", '[0-9a-f]{{40}}')""",
    "answer_order": _order_sql(),
    "recall_state": _recall_sql(),
    "lost_files": f"""WITH {NODES}, h AS (SELECT DISTINCT file AS file_path, CAST(min_caller_edges AS INT) AS lo FROM mealie_all WHERE file IS NOT NULL AND min_caller_edges IS NOT NULL)
SELECT DISTINCT file_path FROM h WHERE file_path IN (SELECT path FROM files WHERE content_hash IS NULL) OR NOT EXISTS (SELECT 1 FROM h g JOIN sym s ON s.file_path = g.file_path AND s.start_line <= g.lo + 20 AND s.end_line >= g.lo AND s.kind IS DISTINCT FROM 'file' WHERE g.file_path = h.file_path)""",
    "file_node_lookup": f"WITH {NODES} SELECT file_path, min(id) AS id FROM sym WHERE kind = 'file' AND file_path IN (SELECT file FROM mealie_all WHERE min_caller_edges IS NOT NULL) GROUP BY file_path",
    "file_map": f"WITH {NODES} SELECT id, coalesce(file_path, '') AS file_path FROM sym",
    "registry_discovery": """WITH f AS (SELECT DISTINCT CAST(registry_id % 3 AS INTEGER) AS folder_rank, target || registry_id || CASE WHEN coalesce(approved, false) THEN '.json' WHEN registry_id % 9 = 0 THEN '.yaml' ELSE '.draft.json' END AS file_name, target FROM signedintake WHERE target IS NOT NULL)
SELECT folder_rank, file_name, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY folder_rank, ends_with(file_name, '.draft.json'), file_name) AS rn FROM f WHERE ends_with(file_name, '.json')) WHERE rn = 1""",
    "harness_resolution": f"""WITH {NODES}, {_TRACED}, p AS (SELECT relpath, qualname, name FROM fr WHERE NOT contains(qualname, '<locals>'))
SELECT p.relpath, p.qualname, s.id FROM p LEFT JOIN sym s ON s.name = p.name AND s.kind IS DISTINCT FROM 'file' AND (s.file_path = ltrim(p.relpath, '/') OR ends_with(s.file_path, '/' || ltrim(p.relpath, '/')))""",
    "test_journey_map": f"""WITH {_T}, q AS (SELECT DISTINCT test FROM (SELECT unnest(map_keys(tests)) AS test FROM t)),
m AS (SELECT DISTINCT key, 'M' || (length(key) % 5) AS journey FROM (SELECT regexp_replace(split_part(test, '::', 1), '^[^/]*/', '') AS key FROM q WHERE length(test) % 2 = 0 UNION SELECT test FROM q WHERE length(test) % 6 = 0)),
a AS (SELECT test, 0 AS stage, i AS at, array_to_string(string_split(test, '/')[i:], '/') AS key FROM (SELECT test, unnest(range(1, len(string_split(test, '/')) + 1)) AS i FROM q)
  UNION ALL SELECT test, 1, i, array_to_string(string_split(split_part(test, '::', 1), '/')[i:], '/') FROM (SELECT test, unnest(range(1, len(string_split(split_part(test, '::', 1), '/')) + 1)) AS i FROM q)),
b AS (SELECT test, key FROM (SELECT a.test, a.key, row_number() OVER (PARTITION BY a.test ORDER BY a.stage, a.at) AS rn FROM a WHERE a.key IN (SELECT key FROM m)) WHERE rn = 1)
SELECT q.test, b.key, m.journey FROM q LEFT JOIN b ON b.test = q.test LEFT JOIN m ON m.key = b.key""",
    "top_fanin_callers": f"""WITH {NODES}, {EDGES}, x AS (SELECT t.name, t.file_path, s.file_path AS caller_file FROM lnk e JOIN sym t ON t.id = e.target LEFT JOIN sym s ON s.id = e.source
  WHERE e.kind IN ('calls', 'references', 'instantiates', 'imports') AND t.kind IS DISTINCT FROM 'file' AND t.name IS NOT NULL AND NOT coalesce({TEST_PATH.format(p='s.file_path')}, false)),
top AS (SELECT name, file_path, count(*) AS n FROM x GROUP BY ALL ORDER BY n DESC, name, file_path NULLS FIRST LIMIT 40)
SELECT x.name, x.file_path, x.caller_file, count(*) AS n FROM x JOIN top ON top.name = x.name AND top.file_path IS NOT DISTINCT FROM x.file_path GROUP BY ALL""",
    "spot_check_picks": f"""WITH {_ENT}, s AS ({TRACE_SQL['spot_check_candidates']}), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, fan_in DESC, name NULLS LAST, candidate_id) AS position FROM s WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.name = s.name))
SELECT name, candidate_id, index_run, fan_in, floor, score, CAST(position AS INTEGER) AS position, position <= 2 AS picked FROM k WHERE position <= 8""",
    "ledger_export": _export_sql(),
    "filter_expressions": f"""WITH {_JNY}, {_HELD_FLOWS}, g AS (SELECT target, list_sort(list(DISTINCT journey_id)) AS ids FROM flows GROUP BY target)
SELECT target, array_to_string(list_transform(ids, lambda j: 'tg_' || j), ' or ') AS markers, '(' || {_tags('@tg:')} || ')(\\s|$)' AS title_filter, '(^|\\s)(' || {_tags('@tg:')} || ')(\\s|$)' AS name_filter FROM g""",
    "index_refusals": "SELECT 'index' AS rule, 'blocking' AS severity, unnest(['missing', 'not an index']) AS message",
    "index_versions": "SELECT 'schema' AS what, max(codegraph_schema_version) AS version FROM signedintake UNION ALL SELECT 'extractor', max(TRY_CAST(CASE WHEN registry_id % 2 = 0 THEN CAST(codegraph_extraction_version AS VARCHAR) ELSE 'unknown' END AS INTEGER)) FROM signedintake",
    "pending_guard": "SELECT 'pending' AS rule, severity, 'references' AS subject, message FROM (SELECT 'blocking' AS severity, CAST(count(*) AS VARCHAR) AS message FROM (SELECT DISTINCT id, target FROM edges) WHERE coalesce(target, '') = '' HAVING count(*) > 10 UNION ALL SELECT 'blocking', 'no table' UNION ALL SELECT 'warning', 'no status')",
    "unresolved_then": f"""WITH {NODES.replace('removed_at IS NULL', "indexed_at < (SELECT date_trunc('month', min(indexed_at)) + INTERVAL 1 MONTH FROM nodes)")}, {_FLOWS_SQL}
SELECT journey, array_to_string(list_sort(list_distinct(list(name))), ',') AS names FROM res GROUP BY journey HAVING bool_and(id IS NULL)""",
    "unknown_because": f"WITH {_ENT}, {_FINDINGS} SELECT reason, n FROM (SELECT 'warnings' AS reason, count(*) AS n FROM fi WHERE severity = 'warning' UNION ALL SELECT 'unchecked entries', count(*) FROM (SELECT DISTINCT journey, name, file FROM ent WHERE name IS NOT NULL AND file <> '' AND NOT ends_with(file, '.py'))) WHERE n > 0",
    "verify_states": f"""WITH {NODES}, {_FLOWS_SQL}, {_HELD_FLOWS}, {_TRACED}, {_HITS}, {_REACH}, cr AS (SELECT journey, arg_max(verdict, {_RANK}) AS verdict FROM dc WHERE verdict = 'fail' OR EXISTS (SELECT 1 FROM rc WHERE rc.test = dc.test AND rc.journey = dc.journey) GROUP BY journey)
SELECT f.journey, CASE (SELECT verdict FROM cr WHERE cr.journey = f.journey) WHEN 'fail' THEN 'failed' WHEN 'pass' THEN 'verified' WHEN 'skip' THEN 'skipped'
  ELSE CASE WHEN EXISTS (SELECT 1 FROM dc WHERE dc.journey = f.journey AND verdict = 'pass') THEN 'incomplete' WHEN EXISTS (SELECT 1 FROM dc WHERE dc.journey = f.journey AND verdict = 'skip') THEN 'skipped' ELSE 'uncovered' END END AS state FROM (SELECT DISTINCT journey FROM flows) f""",
    "last_run_dates": "SELECT DISTINCT path, strftime(make_timestamp(CASE WHEN indexed_at > 1000000000000 THEN indexed_at // 1000 ELSE indexed_at END * 1000000), '%Y-%m-%d') AS day FROM files",
}
