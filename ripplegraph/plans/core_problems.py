"""Queries of the general data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import dense_counts, nested, orphans
from ripplegraph.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.find_orphans(spark, table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(spark, table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"))


def p1_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_snapshots(spark, table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"), months=3)


def p1_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts as they stood when each quarter's deliveries were in, late ones among them."""
    return orphans.orphan_snapshots(spark, table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"), months=3, arrival="loaded_at")


def p1_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.late_orphans(spark, table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"), months=3)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_counts.wrong_fan_in(table(spark, sf_dir, "edges"), table(spark, sf_dir, "mealie_all"))


def p2_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_counts.fan_in(table(spark, sf_dir, "edges"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nested_children(spark, table(spark, sf_dir, "tgtrace"), table(spark, sf_dir, "signedintake"))


def _flat(tag: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.FlatTables(spark, table(spark, sf_dir, "tgtrace"), table(spark, sf_dir, "signedintake")).table(tag)

    return run


def p3_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat("journey")(spark, sf_dir).select("record_id", "journey_id", "name", F.array_join("route", " > ").alias("route"), "n_entries")


def p3_traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat("traced_symbol")(spark, sf_dir).select("record_id", F.col("parent_key").alias("test_id"), "child_no", "relpath", "qualname")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_snapshots": p1_snapshots, "p1_arrivals": p1_arrivals, "p1_late": p1_late, "p2_found": p2_found, "p2_fan_in": p2_fan_in, "p3_found": p3_found, "p3_journeys": p3_journeys, "p3_traced": p3_traced}

_REFS = """refs AS (
  SELECT id AS edge_id, 'source' AS side, source AS key, seen_at FROM edges WHERE source IS NOT NULL AND source <> ''
  UNION SELECT id, 'target', target, seen_at FROM edges WHERE target IS NOT NULL AND target <> ''),
orphans AS (
  SELECT edge_id, side, key, seen_at FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM nodes n WHERE n.id = r.key AND n.indexed_at <= r.seen_at AND (n.removed_at IS NULL OR n.removed_at > r.seen_at)))"""

# by arrival: a reference comes in at the later of its two times, its first delivery counts
_ARRIVED = f"""{_REFS}, first AS (SELECT edge_id, side, key, seen_at, min(arrived) AS arrived FROM (
  SELECT id AS edge_id, 'source' AS side, source AS key, seen_at, greatest(seen_at, loaded_at) AS arrived FROM edges UNION ALL SELECT id, 'target', target, seen_at, greatest(seen_at, loaded_at) FROM edges) GROUP BY ALL),
span AS (SELECT date_trunc('month', min(arrived)) AS lo, max(arrived) AS hi FROM first WHERE key <> ''),
ends AS (SELECT row_number() OVER (ORDER BY p NULLS LAST) AS k, p FROM (SELECT lo + to_months(CAST(3 * i AS INTEGER)) AS p FROM span, range(1, 400) r(i) WHERE lo + to_months(CAST(3 * i AS INTEGER)) <= hi UNION ALL SELECT NULL)),
o AS (SELECT DISTINCT f.* FROM orphans x JOIN first f ON f.edge_id = x.edge_id AND f.side = x.side AND f.key = x.key AND f.seen_at = x.seen_at)"""

_FAN_IN = "SELECT index_run, target, CAST(count(DISTINCT id) AS BIGINT) AS fan_in FROM edges WHERE kind IN ('calls','imports','references','instantiates') AND target IS NOT NULL AND index_run IS NOT NULL GROUP BY index_run, target"

_TRACES = "t AS (SELECT trace_id, any_value(tests) AS tests, any_value(declared) AS declared FROM tgtrace GROUP BY trace_id)"
_PAIRS = "pairs AS (SELECT trace_id, e.key AS parent_key, e.value AS items FROM (SELECT trace_id, unnest(map_entries(tests)) AS e FROM t))"

ORACLES = {
    "p1_found": f"WITH {_REFS} SELECT DISTINCT edge_id, side FROM orphans",
    "p1_report": f"""WITH {_REFS} SELECT side, strftime(seen_at, '%Y-%m') AS month, count(*) AS found,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = orphans.key AND n.removed_at IS NULL)) AS waiting
  FROM orphans GROUP BY side, month""",
    "p1_snapshots": f"""WITH {_REFS}, cut AS (SELECT date_trunc('month', lo) + to_months(CAST(3 * i AS INTEGER)) AS p FROM (SELECT min(seen_at) AS lo, max(seen_at) AS hi FROM edges), range(1, 400) r(i) WHERE date_trunc('month', lo) + to_months(CAST(3 * i AS INTEGER)) <= hi),
ends AS (SELECT row_number() OVER (ORDER BY p NULLS LAST) AS k, p FROM (SELECT p FROM cut UNION ALL SELECT NULL)),
o AS (SELECT DISTINCT edge_id, side, key, seen_at FROM orphans),
st AS (SELECT e.k, e.p, o.edge_id, o.side, NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = o.key AND (n.indexed_at < e.p OR e.p IS NULL) AND (n.removed_at IS NULL OR n.removed_at >= e.p)) AS open FROM o JOIN ends e ON e.p IS NULL OR o.seen_at < e.p)
SELECT a.p AS period_end, a.side, count(*) AS found, coalesce(count_if(a.open), 0)::BIGINT AS waiting, coalesce(count_if(b.open AND NOT a.open), 0)::BIGINT AS resolved, coalesce(count_if(NOT b.open AND a.open), 0)::BIGINT AS reopened
FROM st a LEFT JOIN st b ON b.k = a.k - 1 AND b.edge_id = a.edge_id AND b.side = a.side GROUP BY a.p, a.side""",
    "p1_arrivals": f"""WITH {_ARRIVED},
st AS (SELECT e.k, e.p, o.edge_id, o.side, NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = o.key AND (n.indexed_at < e.p OR e.p IS NULL) AND (n.removed_at IS NULL OR n.removed_at >= e.p)) AS open FROM o JOIN ends e ON e.p IS NULL OR o.arrived < e.p)
SELECT a.p AS period_end, a.side, count(*) AS found, coalesce(count_if(a.open), 0)::BIGINT AS waiting, coalesce(count_if(b.open AND NOT a.open), 0)::BIGINT AS resolved, coalesce(count_if(NOT b.open AND a.open), 0)::BIGINT AS reopened
FROM st a LEFT JOIN st b ON b.k = a.k - 1 AND b.edge_id = a.edge_id AND b.side = a.side GROUP BY a.p, a.side""",
    "p1_late": f"WITH {_ARRIVED} SELECT DISTINCT o.edge_id, o.side FROM o WHERE EXISTS (SELECT 1 FROM ends e WHERE e.p IS NOT NULL AND o.seen_at < e.p AND o.arrived >= e.p)",
    "p2_found": f"WITH f AS ({_FAN_IN}) SELECT DISTINCT m.candidate_id FROM mealie_all m LEFT JOIN f ON f.index_run = m.index_run AND f.target = m.node_id WHERE m.fan_in IS NOT NULL AND m.fan_in <> coalesce(f.fan_in, 0)",
    "p2_fan_in": _FAN_IN,
    "p3_found": f"""WITH {_TRACES}, {_PAIRS},
decl AS (SELECT trace_id, e.key AS parent_key, e.value AS items FROM (SELECT trace_id, unnest(map_entries(declared)) AS e FROM t)),
r AS (SELECT registry_id, any_value(journeys) AS journeys FROM signedintake WHERE journeys IS NOT NULL AND json_valid(journeys) GROUP BY registry_id),
j AS (SELECT r.registry_id, CASE WHEN json_type(r.journeys::JSON) = 'ARRAY' THEN coalesce(e.value ->> '$.id', '') ELSE e.key END AS parent_key, e.value -> '$.entries' AS entries
  FROM r, json_each(r.journeys::JSON) e WHERE json_type(r.journeys::JSON) IN ('ARRAY', 'OBJECT')),
k AS (SELECT registry_id, parent_key, CASE WHEN entries IS NULL OR json_type(entries) = 'NULL' THEN '[]'::JSON WHEN json_type(entries) = 'ARRAY' THEN entries ELSE json_array(entries) END AS entries FROM j),
n AS (SELECT k.registry_id, k.parent_key, CAST(e.key AS BIGINT) AS child_no, CASE json_type(e.value) WHEN 'VARCHAR' THEN e.value ->> '$' WHEN 'OBJECT' THEN CASE WHEN json_type(e.value -> '$.name') = 'VARCHAR' THEN e.value ->> '$.name' END END AS child_key
  FROM k, json_each(k.entries) e)
SELECT 'tgtrace.tests' AS field, trace_id AS record_id, parent_key, CAST(i - 1 AS BIGINT) AS child_no, coalesce(items[i][2], '') AS child_key FROM (SELECT trace_id, parent_key, items, unnest(range(1, len(items) + 1)) AS i FROM pairs)
UNION ALL SELECT 'tgtrace.tests', trace_id, parent_key, CAST(-1 AS BIGINT), '' FROM pairs WHERE items IS NULL OR len(items) = 0
UNION ALL SELECT 'tgtrace.declared', trace_id, parent_key, CAST(i - 1 AS BIGINT), coalesce(items[i], '') FROM (SELECT trace_id, parent_key, items, unnest(range(1, len(items) + 1)) AS i FROM decl)
UNION ALL SELECT 'tgtrace.declared', trace_id, parent_key, CAST(-1 AS BIGINT), '' FROM decl WHERE items IS NULL OR len(items) = 0
UNION ALL SELECT 'signedintake.journeys', registry_id, parent_key, child_no, coalesce(child_key, '') FROM n
UNION ALL SELECT 'signedintake.journeys', registry_id, parent_key, CAST(-1 AS BIGINT), '' FROM k WHERE json_array_length(entries) = 0""",
    "p3_journeys": """WITH reg AS (SELECT registry_id, any_value(journeys) AS journeys FROM signedintake WHERE journeys IS NOT NULL AND json_valid(journeys) GROUP BY registry_id),
j AS (SELECT r.registry_id, CASE WHEN json_type(r.journeys::JSON) = 'ARRAY' THEN coalesce(e.value ->> '$.id', '') ELSE e.key END AS journey_id, e.value AS v FROM reg r, json_each(r.journeys::JSON) e WHERE json_type(r.journeys::JSON) IN ('ARRAY', 'OBJECT')),
k AS (SELECT *, v -> '$.entries' AS entries, v -> '$.route' AS route FROM j)
SELECT registry_id AS record_id, journey_id, CASE WHEN json_type(v) = 'OBJECT' AND json_type(v -> '$.name') = 'VARCHAR' THEN v ->> '$.name' END AS name,
  CASE json_type(route) WHEN 'VARCHAR' THEN route ->> '$' WHEN 'ARRAY' THEN array_to_string(list_transform(CAST(route AS JSON[]), lambda x: x ->> '$'), ' > ') END AS route,
  CAST(CASE WHEN entries IS NULL OR json_type(entries) = 'NULL' THEN 0 WHEN json_type(entries) = 'ARRAY' THEN json_array_length(entries) ELSE 1 END AS BIGINT) AS n_entries FROM k""",
    "p3_traced": f"""WITH {_TRACES}, {_PAIRS}
SELECT trace_id AS record_id, parent_key AS test_id, CAST(i - 1 AS BIGINT) AS child_no, items[i][1] AS relpath, items[i][2] AS qualname FROM (SELECT trace_id, parent_key, items, unnest(range(1, len(items) + 1)) AS i FROM pairs)""",
}
