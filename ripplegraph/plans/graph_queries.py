"""Queries over the symbol graph: seeds, closures, flows, ranking, reverse index.

The graph is what the index holds now (``nodes`` without ``removed_at``, ``edges`` once per
id). Changed lines are those that the spot-check candidates of ``mealie_all`` name; flows are
the journeys of the registry that holds for each target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import closure, graph, impact, journeys, reach
from ripplegraph.session import SharedTables, Workspace, table


class Inputs:
    """The cleaned tables of one run, written once to the shared folder as they are needed.

    The cleaned graph is the same for all queries of a session and is shared by them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.work = Workspace(spark, "inputs")
        self._held: dict[str, DataFrame] = {}
        self.graph = SharedTables(spark, [f"{sf_dir}/{name}.parquet" for name in ("nodes", "edges")])

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._held:
            self._held[name] = self.work.save(make(), name)
        return self._held[name]

    @property
    def nodes(self) -> DataFrame:
        return self.graph.get("nodes", lambda: graph.symbols(table(self.spark, self.dir, "nodes")))

    @property
    def edges(self) -> DataFrame:
        return self.graph.get("edges", lambda: graph.links(table(self.spark, self.dir, "edges")))

    @property
    def candidates(self) -> DataFrame:
        return table(self.spark, self.dir, "mealie_all").distinct()

    @property
    def hunks(self) -> DataFrame:
        low = F.col("min_caller_edges").cast("int")
        return self.candidates.where("file is not null and min_caller_edges is not null").select(F.col("file").alias("file_path"), low.alias("lo"), (low + 20).alias("hi"), "index_run").distinct()

    @property
    def last_hunks(self) -> DataFrame:
        """The changed lines of the newest index run."""
        newest = self.hunks.agg(F.max("index_run").alias("index_run"))
        return self.hunks.join(F.broadcast(newest), "index_run", "left_semi")

    @property
    def seeds(self) -> DataFrame:
        return self._once("seeds", lambda: impact.seeds_of_hunks(self.last_hunks, self.nodes))

    @property
    def journeys(self) -> journeys.Journeys:
        if not hasattr(self, "_journeys"):
            self._journeys = journeys.Journeys(self.spark, table(self.spark, self.dir, "tgtrace"), table(self.spark, self.dir, "signedintake"))
        return self._journeys

    @property
    def entries(self) -> DataFrame:
        return self._once("entries", lambda: journeys.resolve_entries(self.journeys.entries, self.nodes))

    @property
    def impact(self) -> DataFrame:
        return self.graph.get("impact", lambda: graph.impact_relation(self.edges, self.nodes))

    @property
    def reached(self) -> DataFrame:
        starts = self.seeds.select(F.lit("all").alias("source_key"), "id")
        return self._once("reached", lambda: closure.widest_closure(starts, self.impact))

    @property
    def starts(self) -> DataFrame:
        return self.entries.where("id is not null").select(F.col("journey").alias("source_key"), "id")

    @property
    def feet(self) -> reach.Reach:
        """All footprints in parts; as rows they are flows times nodes."""
        if not hasattr(self, "_feet"):
            self._feet = reach.reaches(self.starts, graph.dependency_relation(self.edges))[0]
        return self._feet


def query(run):
    """A query over cleaned inputs as the entry point expects it."""
    return lambda spark, sf_dir: run(Inputs(spark, sf_dir))


def _rank(i: Inputs) -> DataFrame:
    return impact.rank_journeys(i.reached, i.entries, graph.caller_counts(i.edges))


def _what_if(i: Inputs) -> DataFrame:
    """Flows that lose a symbol when every heuristic edge is taken for a phantom and left out."""
    phantom = i.edges.where("provenance = 'heuristic'").select("source", "target")
    whole, without = reach.reaches(i.starts, graph.dependency_relation(i.edges), graph.dependency_relation(i.edges, phantom))
    return whole.lost_in(without).select(F.col("source_key").alias("journey"), "id")


def _natural(i: Inputs) -> DataFrame:
    head, tail, _ = journeys.natural_key(F.col("journey_id"))
    return i.journeys.flat.table("journey").select("journey_id").distinct().select("journey_id", head.alias("head"), tail.alias("tail"))


QUERIES = {
    "edge_confidence_caps": query(lambda i: graph.weighted(i.edges, i.nodes).select("id", "conf", "cap")),
    "ambiguous_names": query(lambda i: graph.ambiguous_names(graph.symbols(table(i.spark, i.dir, "nodes")))),
    "caller_edge_count": query(lambda i: graph.caller_counts(graph.links(table(i.spark, i.dir, "edges"), graph.FAN_IN_KINDS, ("target", "kind", "source")))),
    "top_fanin": query(lambda i: impact.fan_in_by_name(i.edges, i.nodes, 40)[0]),
    "seed_interval_join": query(lambda i: impact.seeds_of_hunks(i.hunks, i.nodes)),
    "whole_file_seeds": query(lambda i: impact.seeds_of_files(i.hunks.select("file_path"), i.nodes)),
    "unmapped_antijoin": query(lambda i: impact.unmapped(i.hunks, impact.seeds_of_hunks(i.hunks, i.nodes))),
    "impacted_closure": query(lambda i: i.reached.select("id", "conf")),
    "impacted_closure_caps": query(lambda i: i.reached.select("id", "conf", "cap")),
    "footprint": query(lambda i: i.feet.rows().select(F.col("source_key").alias("journey"), "id")),
    "closure_files_complete": query(lambda i: impact.files_of_reach(i.feet, i.nodes)),
    "confined_files": query(lambda i: impact.confined_files(i.seeds, i.entries, i.impact, i.nodes)),
    "entry_map": query(lambda i: i.entries.where("id is not null").select("journey", "name", "id").distinct()),
    "unresolved_entries": query(lambda i: journeys.unresolved_journeys(i.entries)),
    "registry_resolution": query(lambda i: journeys.resolve_registries(table(i.spark, i.dir, "signedintake"))),
    "journey_rank": query(_rank),
    "reverse_index": query(lambda i: impact.reverse_index(i.entries, graph.inverse(i.impact), i.nodes)),
    "shared_core": query(lambda i: impact.core_of_reach(i.feet)),
    "coupling_overlap": query(lambda i: impact.coupling_of_reach(i.feet).select(F.col("source_key").alias("journey"), "overlap", "size")),
    "phantom_whatif": query(_what_if),
    "natural_sort_key": query(_natural),
}

_ROW = ", ".join(f"{c} DESC NULLS LAST" for c in ("indexed_at", "lower(trim(kind))", "name", "qualified_name", "file_path", "start_line", "end_line"))
NODES = f"sym AS (SELECT id, kind, name, qualified_name, file_path, start_line, end_line FROM (SELECT id, lower(trim(kind)) AS kind, name, qualified_name, file_path, start_line, end_line, row_number() OVER (PARTITION BY id ORDER BY {_ROW}) AS version FROM nodes WHERE removed_at IS NULL AND id IS NOT NULL) WHERE version = 1)"
_EDGE_ROW = ", ".join(f"{c} DESC NULLS LAST" for c in ("loaded_at", "source", "target", "kind", "metadata", "provenance", "line"))
EDGES = f"lnk AS (SELECT id, source, target, kind, metadata, provenance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_EDGE_ROW}) AS version FROM edges WHERE source IS NOT NULL AND source <> '' AND target IS NOT NULL AND target <> '') WHERE version = 1)"
_SHARED = "amb AS (SELECT name, count(*) AS n FROM sym WHERE name IS NOT NULL AND kind IS DISTINCT FROM 'file' GROUP BY name HAVING count(*) > 1), ambid AS (SELECT id FROM sym WHERE name IN (SELECT name FROM amb) AND kind IS DISTINCT FROM 'file')"
_WEIGHTED = f"""{_SHARED}, parts AS (SELECT id, source, target, coalesce(CASE WHEN json_valid(metadata) THEN CAST(json_extract_string(metadata, '$.confidence') AS DOUBLE) END, 0.9) AS meta,
  CASE WHEN provenance = 'heuristic' THEN 0.3 ELSE 1.0 END::DOUBLE AS heur,
  CASE WHEN json_valid(metadata) AND json_extract_string(metadata, '$.resolvedBy') = 'exact-match' AND target IN (SELECT id FROM ambid) THEN 0.5 ELSE 1.0 END::DOUBLE AS coll
  FROM lnk WHERE kind IN ('calls', 'references', 'instantiates', 'extends', 'imports')),
wgt AS (SELECT id, source, target, least(meta, heur, coll) AS conf, CASE WHEN coll <= meta AND coll <= heur THEN 'name-collision' WHEN heur <= meta THEN 'heuristic' WHEN meta <= 0.6 THEN 'metadata' ELSE '' END AS cap FROM parts)"""
_PROP = "prop AS (SELECT DISTINCT target AS frm, source AS nxt, conf AS ec, cap AS ecap FROM wgt UNION SELECT source, target, NULL, NULL FROM lnk WHERE kind = 'contains' AND starts_with(source, 'file:'))"
_HUNKS = "hunks AS (SELECT DISTINCT file AS file_path, CAST(min_caller_edges AS INT) AS lo, CAST(min_caller_edges AS INT) + 20 AS hi, index_run FROM mealie_all WHERE file IS NOT NULL AND min_caller_edges IS NOT NULL)"
_SEEDS = "seeds AS (SELECT DISTINCT s.file_path, s.id FROM hunks h JOIN sym s ON s.file_path = h.file_path AND s.start_line <= h.hi AND s.end_line >= h.lo WHERE s.kind IS DISTINCT FROM 'file' {where})"
_LAST = _SEEDS.format(where="AND h.index_run = (SELECT max(index_run) FROM hunks)")
_REACHED = "walk(id, conf, cap) AS (SELECT id, CAST(1.0 AS DOUBLE), '' FROM seeds UNION SELECT p.nxt, CASE WHEN p.ec IS NULL THEN w.conf ELSE least(w.conf, p.ec) END, CASE WHEN p.ec IS NULL OR p.ec > w.conf THEN w.cap ELSE p.ecap END FROM walk w JOIN prop p ON p.frm = w.id), best AS (SELECT id, max(conf) AS conf FROM walk GROUP BY id), reached AS (SELECT w.id, w.conf, max(w.cap) AS cap FROM walk w JOIN best b ON b.id = w.id AND b.conf = w.conf GROUP BY w.id, w.conf)"
REGISTRIES = "held AS (SELECT registry_id, target, approved, reviewed_at FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY coalesce(approved, false) DESC, reviewed_at DESC NULLS LAST, registry_id DESC) AS rn FROM (SELECT DISTINCT registry_id, target, approved, reviewed_at FROM signedintake WHERE target IS NOT NULL)) WHERE rn = 1)"
ENTRIES = """reg AS (SELECT registry_id, any_value(journeys) AS journeys FROM signedintake WHERE journeys IS NOT NULL AND json_valid(journeys) GROUP BY registry_id),
jny AS (SELECT r.registry_id, CASE WHEN json_type(r.journeys::JSON) = 'ARRAY' THEN coalesce(e.value ->> '$.id', '') ELSE e.key END AS journey_id, e.value -> '$.entries' AS entries
  FROM reg r, json_each(r.journeys::JSON) e WHERE json_type(r.journeys::JSON) IN ('ARRAY', 'OBJECT')),
lst AS (SELECT registry_id, journey_id, CASE WHEN entries IS NULL OR json_type(entries) = 'NULL' THEN '[]'::JSON WHEN json_type(entries) = 'ARRAY' THEN entries ELSE json_array(entries) END AS entries FROM jny),
ent AS (SELECT DISTINCT h.target, l.journey_id, h.target || ':' || l.journey_id AS journey, CASE json_type(e.value) WHEN 'VARCHAR' THEN e.value ->> '$' WHEN 'OBJECT' THEN e.value ->> '$.name' END AS name, CASE json_type(e.value) WHEN 'OBJECT' THEN e.value ->> '$.file' END AS file
  FROM lst l JOIN held h ON h.registry_id = l.registry_id, json_each(l.entries) e),
res AS (SELECT n.journey, n.name, n.file, s.id FROM (SELECT * FROM ent WHERE name IS NOT NULL) n LEFT JOIN sym s ON s.name = n.name AND s.kind IS DISTINCT FROM 'file'
  AND (n.file IS NULL OR regexp_replace(replace(s.file_path, '\\', '/'), '^(\\./|/)+', '') = ltrim(n.file, '/') OR ends_with(regexp_replace(replace(s.file_path, '\\', '/'), '^(\\./|/)+', ''), '/' || ltrim(n.file, '/'))))"""
_DEPS = "deps AS (SELECT DISTINCT source AS frm, target AS nxt FROM lnk WHERE kind IN ('calls', 'references', 'instantiates', 'extends', 'imports') {drop} UNION SELECT target, arg_max(source, id) FROM lnk WHERE kind = 'contains' AND starts_with(source, 'file:') GROUP BY target)"
_FOOT = "foot(journey, id) AS (SELECT journey, id FROM res WHERE id IS NOT NULL UNION SELECT f.journey, d.nxt FROM foot f JOIN deps d ON d.frm = f.id)"
_G = f"WITH RECURSIVE {NODES}, {EDGES}"
_CORE = "total AS (SELECT count(DISTINCT journey) AS n FROM foot), core AS (SELECT id, count(DISTINCT journey) AS in_footprints FROM foot, total GROUP BY id, n HAVING count(DISTINCT journey) >= 0.5 * n)"
_FEET = f"{_G}, {REGISTRIES}, {ENTRIES}, {_DEPS.format(drop='')}, {_FOOT}"
TEST_PATH = "(regexp_matches({p}, '(^|/)(tests|e2e|__tests__)/') OR regexp_matches({p}, '(^|/)test_[^/]*$') OR ends_with({p}, '_test.py') OR regexp_matches({p}, '\\.(test|spec)\\.[^/]*$'))"

ORACLES = {
    "edge_confidence_caps": f"{_G}, {_WEIGHTED} SELECT id, conf, cap FROM wgt",
    "ambiguous_names": f"WITH {NODES}, {_SHARED} SELECT name, n FROM amb",
    "caller_edge_count": f"WITH {EDGES} SELECT target, count(*) AS callers FROM lnk WHERE kind IN ('calls', 'references', 'instantiates', 'imports') GROUP BY target",
    "top_fanin": f"""WITH {NODES}, {EDGES} SELECT t.name, t.file_path, CAST(count(*) AS BIGINT) AS callers FROM lnk e JOIN sym t ON t.id = e.target LEFT JOIN sym s ON s.id = e.source
  WHERE e.kind IN ('calls', 'references', 'instantiates', 'imports') AND t.kind IS DISTINCT FROM 'file' AND t.name IS NOT NULL AND NOT coalesce({TEST_PATH.format(p='s.file_path')}, false)
  GROUP BY t.name, t.file_path ORDER BY callers DESC, t.name, t.file_path NULLS FIRST LIMIT 40""",
    "seed_interval_join": f"WITH {NODES}, {_HUNKS}, {_SEEDS.format(where='')} SELECT file_path, id FROM seeds",
    "whole_file_seeds": f"WITH {NODES}, {_HUNKS} SELECT file_path, id FROM sym WHERE kind IS DISTINCT FROM 'file' AND file_path IN (SELECT file_path FROM hunks)",
    "unmapped_antijoin": f"WITH {NODES}, {_HUNKS}, {_SEEDS.format(where='')} SELECT DISTINCT file_path FROM hunks WHERE file_path NOT IN (SELECT file_path FROM seeds)",
    "impacted_closure": f"{_G}, {_WEIGHTED}, {_PROP}, {_HUNKS}, {_LAST}, {_REACHED} SELECT id, conf FROM reached",
    "impacted_closure_caps": f"{_G}, {_WEIGHTED}, {_PROP}, {_HUNKS}, {_LAST}, {_REACHED} SELECT id, conf, cap FROM reached",
    "footprint": f"{_FEET} SELECT journey, id FROM foot",
    "closure_files_complete": f"""{_FEET} SELECT journey AS source_key, CASE WHEN bool_and(s.id IS NOT NULL) THEN coalesce(array_to_string(list_sort(list_distinct(list(s.file_path) FILTER (WHERE s.file_path IS NOT NULL))), ','), '') END AS files,
  CASE WHEN bool_and(s.id IS NOT NULL) THEN count(DISTINCT s.file_path) END AS n_files, count(*) AS reached FROM foot f LEFT JOIN sym s ON s.id = f.id GROUP BY journey""",
    "entry_map": f"WITH {NODES}, {REGISTRIES}, {ENTRIES} SELECT DISTINCT journey, name, id FROM res WHERE id IS NOT NULL",
    "unresolved_entries": f"WITH {NODES}, {REGISTRIES}, {ENTRIES} SELECT journey, array_to_string(list_sort(list_distinct(list(name))), ',') AS names FROM res GROUP BY journey HAVING bool_and(id IS NULL)",
    "registry_resolution": f"WITH {REGISTRIES} SELECT registry_id, target, approved, reviewed_at FROM held",
    "journey_rank": f"""{_G}, {_WEIGHTED}, {_PROP}, {_HUNKS}, {_LAST}, {_REACHED}, {REGISTRIES}, {ENTRIES}, callers AS (SELECT target, count(*) AS n FROM lnk WHERE kind IN ('calls', 'references', 'instantiates', 'imports') GROUP BY target),
hit AS (SELECT e.journey, r.conf, r.cap, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT journey, id FROM res WHERE id IS NOT NULL) e JOIN reached r ON r.id = e.id LEFT JOIN callers c ON c.target = e.id),
top AS (SELECT journey, max(conf) AS conf, sum(n) AS rank, count(*) AS entries_hit FROM hit GROUP BY journey)
SELECT t.journey, CAST(t.rank AS BIGINT) AS rank, t.entries_hit, round(t.conf, 3) AS confidence, t.conf <= 0.6 AS verify, CASE WHEN t.conf <= 0.6 THEN nullif((SELECT max(h.cap) FROM hit h WHERE h.journey = t.journey AND h.conf = t.conf), '') END AS weak_reason FROM top t""",
    "shared_core": f"{_FEET}, {_CORE} SELECT id, in_footprints FROM core",
    "coupling_overlap": f"{_FEET}, {_CORE} SELECT journey, count(c.id) AS overlap, count(*) AS size FROM foot f LEFT JOIN core c ON c.id = f.id GROUP BY journey",
    "phantom_whatif": f"""{_FEET}, ph AS (SELECT DISTINCT source, target FROM lnk WHERE provenance = 'heuristic'), deps2 AS (SELECT DISTINCT source AS frm, target AS nxt FROM lnk WHERE kind IN ('calls', 'references', 'instantiates', 'extends', 'imports') AND NOT EXISTS (SELECT 1 FROM ph WHERE ph.source = lnk.source AND ph.target = lnk.target) UNION SELECT target, arg_max(source, id) FROM lnk WHERE kind = 'contains' AND starts_with(source, 'file:') GROUP BY target),
foot2(journey, id) AS (SELECT journey, id FROM res WHERE id IS NOT NULL UNION SELECT f.journey, d.nxt FROM foot2 f JOIN deps2 d ON d.frm = f.id) SELECT journey, id FROM foot EXCEPT SELECT journey, id FROM foot2""",
    "natural_sort_key": f"WITH reg AS (SELECT registry_id, any_value(journeys) AS journeys FROM signedintake WHERE journeys IS NOT NULL AND json_valid(journeys) GROUP BY registry_id), ids AS (SELECT DISTINCT CASE WHEN json_type(r.journeys::JSON) = 'ARRAY' THEN coalesce(e.value ->> '$.id', '') ELSE e.key END AS journey_id FROM reg r, json_each(r.journeys::JSON) e WHERE json_type(r.journeys::JSON) IN ('ARRAY', 'OBJECT')) SELECT journey_id, regexp_extract(journey_id, '^(.*?)([0-9]*)$', 1) AS head, coalesce(TRY_CAST(nullif(regexp_extract(journey_id, '^(.*?)([0-9]*)$', 2), '') AS BIGINT), -1) AS tail FROM ids",
}


def _degraded(i: Inputs) -> DataFrame:
    """The whole answer: ranked flows, flows that triggers name, and the fallback."""
    from ripplegraph.functions.paths import exemption, is_product_path
    from ripplegraph.operators import scoring
    from ripplegraph.plans.trace_queries import all_paths, trigger_rows

    changed = i.last_hunks.select("file_path").distinct()
    documents = all_paths(i).where(~is_product_path(F.col("path")))
    held = journeys.resolve_registries(table(i.spark, i.dir, "signedintake")).select("registry_id", "target")
    triggers = trigger_rows(i).join(held, "registry_id")
    hits = scoring.trigger_hits(triggers.drop("target"), documents).join(held, "registry_id")
    named = hits.select(F.concat_ws(":", "target", "journey_id").alias("journey"), F.col("glob").alias("triggered_by")).distinct()
    known = named.join(i.journeys.journeys.select("journey"), "journey", "left_semi")
    untriggered = documents.where(exemption(F.col("path")).isNull()).join(hits.select("path").distinct(), "path", "left_anti")
    rows = impact.with_triggers(_rank(i), known)
    return impact.with_fallback(rows, i.journeys.journeys, impact.unmapped(changed, i.seeds), untriggered)


QUERIES["degrade_rows"] = query(_degraded)

_IMPACT = f"{_G}, {_WEIGHTED}, {_PROP}, {_HUNKS}, {_LAST}"
ORACLES["confined_files"] = f"""{_IMPACT}, {REGISTRIES}, {ENTRIES}, un AS (SELECT file_path, id FROM seeds WHERE id NOT IN (SELECT id FROM res WHERE id IS NOT NULL)),
cw(file_path, id) AS (SELECT file_path, id FROM un UNION SELECT c.file_path, p.nxt FROM cw c JOIN prop p ON p.frm = c.id)
SELECT c.file_path FROM cw c LEFT JOIN sym s ON s.id = c.id GROUP BY c.file_path HAVING bool_and(coalesce(s.file_path = c.file_path, false))"""
ORACLES["reverse_index"] = f"""{_G}, {_WEIGHTED}, {_PROP}, {REGISTRIES}, {ENTRIES}, inv(journey, id, conf) AS (SELECT journey, id, CAST(1.0 AS DOUBLE) FROM res WHERE id IS NOT NULL
  UNION SELECT v.journey, p.frm, CASE WHEN p.ec IS NULL THEN v.conf ELSE least(v.conf, p.ec) END FROM inv v JOIN prop p ON p.nxt = v.id)
SELECT v.journey, v.id, max(v.conf) AS conf FROM inv v JOIN sym s ON s.id = v.id WHERE s.file_path IS NOT NULL AND s.kind IS DISTINCT FROM 'file' AND NOT starts_with(v.id, 'file:') GROUP BY v.journey, v.id"""
