"""The engine's entry points as library calls: each takes tables and gives tables.

``nodes`` and ``edges`` are cleaned (``graph.symbols``, ``graph.links``); ``journeys`` has
``journey``; ``entries`` has ``target, journey_id, journey, name, file``; ``diffs`` has
``diff_id, text``; ``triggers`` has ``registry_id, glob, journey_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import labels, paths
from ripplegraph.operators import attribution, closure, evaluation, graph, impact, journeys, ledger, rules, scoring
from ripplegraph.sources import diff, ledger_io, source_code
from ripplegraph.sources.sinks import exit_code


@dataclass
class Selection:
    """What a diff can have broken. ``status`` is one row: BLOCKED, UNKNOWN or OK, and why."""

    status: DataFrame
    flows: DataFrame
    seeds: DataFrame
    unmapped: DataFrame
    untriggered: DataFrame
    confined: DataFrame
    findings: DataFrame


def select(nodes: DataFrame, edges: DataFrame, flows: DataFrame, entries: DataFrame, diffs: DataFrame, triggers: DataFrame, findings: DataFrame, drifted: DataFrame | None = None) -> Selection:
    """Changed lines to ranked flows, with refusal and fallback.

    A blocking finding refuses the answer: the flows are then empty and the status says so.
    Product files that no symbol answers to, or whose content no longer is what was indexed
    (``drifted``: ``path``), and other paths that no trigger names, bring in all flows.
    """
    spark = nodes.sparkSession
    parsed = diff.blocks(diffs)
    ranges, whole = diff.changed_ranges(parsed), diff.whole_files(parsed)
    by_line = impact.seeds_of_hunks(ranges.select("file_path", "lo", "hi"), nodes)
    seeds = by_line.unionByName(impact.seeds_of_files(whole.select("file_path"), nodes)).distinct()
    changed = ranges.select("file_path").unionByName(whole.select("file_path")).distinct()
    lost = impact.lost_files(changed, seeds, drifted)
    relation = graph.impact_relation(edges, nodes)
    reached = closure.widest_closure(seeds.select(F.lit("all").alias("source_key"), "id"), relation)
    resolved = journeys.resolve_entries(entries, nodes)
    ranked = impact.rank_journeys(reached, resolved, graph.caller_counts(edges))
    other = diff.all_paths(parsed).where(~paths.is_product_path(F.col("path"))).select("path").distinct()
    hits = scoring.trigger_hits(triggers, other)
    named = hits.join(entries.select("journey_id", "journey").distinct(), "journey_id").select("journey", F.col("glob").alias("triggered_by"))
    untriggered = other.where(paths.exemption(F.col("path")).isNull()).join(hits.select("path").distinct(), "path", "left_anti")
    rows = impact.with_fallback(impact.with_triggers(ranked, named), flows, lost, untriggered)
    refused = rules.blocked(findings).first()["status"] == "BLOCKED"
    if refused:
        rows = rows.limit(0)
    confined = impact.confined_files(seeds, resolved, relation, nodes)
    reasons = ["a finding blocks"] if refused else []
    none = not refused and rows.isEmpty()
    if none and not findings.where("severity = 'warning'").isEmpty():
        reasons.append("warnings")
    if none and not confined.isEmpty():
        reasons.append("changes stay within their files")
    if none and not entries.where(F.col("file").isNotNull() & ~F.col("file").endswith(".py")).isEmpty():
        reasons.append("entries that no parser covers")
    state = "BLOCKED" if refused else "UNKNOWN" if none and reasons else "OK"
    status = spark.createDataFrame([(state, ", ".join(reasons) or None)], "status string, because string")
    return Selection(status, rows, seeds, lost, untriggered, confined, findings)


def export_map(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Every symbol with the flows its change can reach, one row per symbol, ready to render."""
    from ripplegraph.sources.sinks import impact_map

    resolved = journeys.resolve_entries(entries, nodes)
    return impact_map(impact.reverse_index(resolved, graph.inverse(graph.impact_relation(edges, nodes)), nodes), nodes)


def summarize(spark, path: str, legacy_path: str | None = None, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Totals per repository and the history per flow of a ledger on disk."""
    rows = ledger_io.read_ledger(spark, path, legacy_path, repo)
    judged = ledger.buckets(ledger_io.outcomes_of(rows), ledger_io.selections_of(rows))
    return ledger.totals(judged), ledger.history(judged)


@dataclass
class Draft:
    """Flows found in source files. ``flows``: ``journey_id, file, name, title, id, fan_in``; ``unresolved``:
    handlers the graph does not know, with a reason; ``blind_spots``: what the search cannot see."""

    flows: DataFrame
    unresolved: DataFrame
    blind_spots: DataFrame


# Files of these kinds may hold entry points that no reader here finds.
UNREAD_EXTENSIONS = r"\.(svelte|vue|mjs|cjs|mts|cts|js|jsx|ts|tsx)$"


def propose(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """A draft of flows from source files: ``journey_id, file, name, title, id``; ``id`` is null
    where the graph does not know the handler."""
    python = source_code.route_handlers(sources.where(F.col("path").endswith(".py"))).where("name is not null")
    web = source_code.app_entries(sources.where(F.col("path").rlike(r"\.(ts|tsx|js|jsx|mjs|cjs|mts|cts)$")))
    routes = F.array_sort(F.collect_set(F.struct("method", F.col("route").alias("path")))).alias("routes")
    found = python.unionByName(web).groupBy(F.col("path").alias("file"), "name").agg(routes)
    titled = found.join(labels.flow_ids(found.select("file", "name")), ["file", "name"]).select("journey_id", "file", "name", labels.joined_name(F.col("name"), F.col("routes")).alias("title"))
    asked = titled.select(F.lit(None).cast("string").alias("target"), "journey_id", F.col("journey_id").alias("journey"), "name", "file")
    known = journeys.resolve_entries(asked, nodes).groupBy("journey_id").agg(F.min("id").alias("id"))
    return titled.join(known, "journey_id")


def draft(sources: DataFrame, nodes: DataFrame, edges: DataFrame) -> Draft:
    """``propose``, told apart: flows that can be registered as they are, ordered by file and id with
    the callers of all nodes of their name; handlers that cannot; and what was not looked into."""
    rows = propose(sources, nodes)
    asked = rows.select(F.lit(None).cast("string").alias("target"), "journey_id", F.col("journey_id").alias("journey"), "name", "file")
    callers = graph.caller_counts(edges).select(F.col("target").alias("node"), "callers")
    fan_in = journeys.resolve_entries(asked, nodes).select("journey_id", F.col("id").alias("node")).join(callers, "node", "left").groupBy("journey_id").agg(F.coalesce(F.sum("callers"), F.lit(0)).cast("long").alias("fan_in"))
    flows = rows.where("id is not null").join(fan_in, "journey_id").orderBy("file", "journey_id")
    lost = rows.where("id is null").select("file", "name", "title", F.lit("no node in the index").alias("reason"))
    broken = source_code.route_handlers(sources.where(F.col("path").endswith(".py"))).where("name is null").select(F.lit("does not parse").alias("what"), "path")
    read = rows.select(F.col("file").alias("path")).distinct()
    unread = sources.where(F.col("path").rlike(UNREAD_EXTENSIONS) & paths.is_product_path(F.col("path"))).join(read, "path", "left_anti").select(F.lit("no entry point was looked for or found").alias("what"), "path")
    return Draft(flows, lost, broken.unionByName(unread))


def accuracy(answers: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recall and worst rank per seeded site, and their summary in one row."""
    scores = evaluation.seeded_scores(answers, expected)
    return scores, evaluation.seeded_summary(scores)


def couple(nodes: DataFrame, edges: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The ``k`` flows deepest in what most flows share, and the ``k`` farthest from it."""
    starts = journeys.resolve_entries(entries, nodes).where("id is not null").select(F.col("journey").alias("source_key"), "id")
    return scoring.arms(closure.reachable(starts, graph.dependency_relation(edges)), k)


def unit_vs_journey(unit: DataFrame, real: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per flow what unit tests and a real run reach (``journey, relpath, qualname`` each): both, either alone."""

    def resolved(traced: DataFrame) -> DataFrame:
        hit = attribution.resolve_harness(traced, nodes).where("id is not null")
        return traced.join(hit, ["relpath", "qualname"]).select("journey", "id").distinct()

    return evaluation.unit_against_real(resolved(unit), resolved(real))


def check_push(selection: Selection, verified: DataFrame | None = None) -> int:
    """The exit code of a hook: 2 refused, 1 a flow failed, 3 a flow is not verified, else 0."""
    state = selection.status.first()["status"]
    counts = (0, 0)
    if verified is not None:
        counts = verified.agg(F.count_if(F.col("verdict") == "fail"), F.count_if(~F.col("verdict").isin("fail", "pass"))).first()
    row = selection.status.select(exit_code(F.lit(state == "BLOCKED"), F.lit(counts[0]), F.lit(counts[1]), F.lit(False)).alias("code"))
    return row.first()["code"]


def verify(selected: DataFrame, declared: DataFrame, traced: DataFrame, entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each selected flow with its verdict: pass, fail, skip or uncovered.

    ``declared`` has ``test, journey, verdict``, ``traced`` has ``test, relpath, qualname``. A pass
    or skip counts only where the test's trace reaches an entry of the flow.
    """
    known = attribution.resolve_loose(attribution.named_frames(traced), nodes)
    ran = traced.join(known.select("relpath", "qualname", "id"), ["relpath", "qualname"]).select("test", "id").distinct()
    reaching = ran.join(journeys.resolve_entries(entries, nodes).where("id is not null").select("journey", "id").distinct(), "id").select("test", "journey")
    credit = attribution.worst_verdict(attribution.credited(declared, reaching), ["journey"])
    return selected.select("journey").distinct().join(credit, "journey", "left").select("journey", F.coalesce("verdict", F.lit("uncovered")).alias("verdict"), F.coalesce("tests", F.lit(0)).cast("long").alias("tests"))


def reconcile(nodes: DataFrame, edges: DataFrame, entries: DataFrame, declared: DataFrame, traced: DataFrame, support: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Static misses, verdicts on call edges, and flows that lose a symbol without the phantoms.

    ``support`` is what the source says of an edge: ``id, support`` as ``source_support`` gives it.
    """
    frames = attribution.resolve_strict(attribution.named_frames(traced), nodes).where("id is not null")
    met = traced.join(frames, ["relpath", "qualname"])
    strict, present = met.where("state = 'resolved'").select("test", "id").distinct(), met.select("test", "id").distinct()
    resolved = journeys.resolve_entries(entries, nodes).where("id is not null")
    starts = resolved.select(F.col("journey").alias("source_key"), "id")
    foot = closure.reachable(starts, graph.dependency_relation(edges))
    covered = strict.join(declared.select("test", "journey"), "test").select("journey", "id")
    misses = attribution.static_misses(covered, foot)
    ids = nodes.select("id")
    calls = edges.where("kind = 'calls'").join(foot.select(F.col("id").alias("source")).distinct(), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    told = F.when(F.col("said") == "supported", True).when(F.col("said") == "unsupported", False)
    judged = attribution.runtime_support(calls, present).join(support.select("id", F.col("support").alias("said")), "id", "left")
    verdicts = judged.select("id", attribution.edge_verdict(told, F.col("support")).alias("verdict")).where("verdict is not null")
    phantoms = calls.join(verdicts.where(F.col("verdict").startswith("phantom")).select("id"), "id", "left_semi")
    without = closure.reachable(starts, graph.dependency_relation(edges, phantoms))
    lost = foot.join(without, ["source_key", "id"], "left_anti").select(F.col("source_key").alias("journey"), "id")
    return misses, verdicts, lost
