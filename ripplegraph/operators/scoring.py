"""Candidate scoring, churn, arms of an experiment, lookups and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.paths import glob_problem, glob_to_regex, is_test_path
from ripplegraph.operators.bitclosure import positions
from ripplegraph.operators.graph import FAN_IN_KINDS
from ripplegraph.operators.impact import coupling, coupling_of_reach, shared_core
from ripplegraph.operators.reach import Reach
from ripplegraph.operators.rules import MIN_TOLERANCE_EDGES, SPOT_CHECK_FLOOR
from ripplegraph.session import Workspace

#: Distinct globs that a registry set may hold; more are matched in several rounds.
GLOBS_AT_ONCE = 500


def spot_check_scores(candidates: DataFrame) -> DataFrame:
    """Candidates that can serve as spot checks, with floor and score.

    The floor is the whole part of 0.8 times the fan-in, at least 2 and at least 2 below it;
    the score is the fan-in per unit of caller churn.
    """
    floor = (F.col("fan_in") * F.lit(SPOT_CHECK_FLOOR)).cast("long")
    score = F.round(F.col("fan_in") / (F.lit(1.0) + F.round("caller_churn", 2)), 2)
    rows = candidates.where(F.col("fan_in").isNotNull() & F.col("caller_churn").isNotNull() & F.col("file").isNotNull() & ~is_test_path(F.col("file")))
    rows = rows.withColumn("floor", floor).where((F.col("floor") >= 2) & (F.col("fan_in") - F.col("floor") >= MIN_TOLERANCE_EDGES))
    return rows.select("candidate_id", "index_run", "name", "fan_in", "floor", score.alias("score"))


def spot_check_picks(scores: DataFrame, entry_names: DataFrame, picked: int = 2, kept: int = 8) -> DataFrame:
    """The ``kept`` best candidates that are no entry, in order, the first ``picked`` of them chosen:
    ``position, picked, ...`` by score, then fan-in, then name, then id."""
    rows = scores.join(entry_names.select("name").distinct(), "name", "left_anti")
    order = [F.desc("score"), F.desc("fan_in"), F.col("name").asc_nulls_last(), F.col("candidate_id")]
    best = rows.orderBy(*order).limit(kept)
    position = F.row_number().over(W.orderBy(*order))  # of at most ``kept`` rows
    return best.withColumn("position", position).withColumn("picked", F.col("position") <= picked)


def churn_of_files(edges: DataFrame, nodes: DataFrame, last: int | None = None) -> DataFrame:
    """Index runs, the ``last`` ones if given, in which a file's symbols made any reference: ``file_path, churn``."""
    if last is not None:
        runs = edges.where("index_run is not null").select("index_run").distinct().orderBy(F.desc("index_run")).limit(last)
        edges = edges.join(F.broadcast(runs), "index_run", "left_semi")
    home = nodes.where("file_path is not null").select(F.col("id").alias("source"), "file_path")
    return edges.select("source", "index_run").distinct().join(home, "source").groupBy("file_path").agg(F.count_distinct("index_run").alias("churn"))


def caller_churn(edges: DataFrame, nodes: DataFrame, churn: DataFrame) -> DataFrame:
    """Mean churn of a target's caller files, with repetition; unknown files count 0.

    Edges are first counted per (target, file), so that a hot target meets the churn table
    with one row per caller file.
    """
    home = nodes.select(F.col("id").alias("source"), "file_path")
    calls = edges.where(F.col("kind").isin(FAN_IN_KINDS)).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    per_file = calls.join(home, "source", "left").groupBy("target", "file_path").agg(F.sum("n").alias("n"))
    met = per_file.join(churn, "file_path", "left")
    return met.groupBy("target").agg((F.sum(F.coalesce("churn", F.lit(0)) * F.col("n")) / F.sum("n")).alias("churn"), F.sum("n").alias("callers"))


def arms(footprints: DataFrame | Reach, k: int) -> DataFrame:
    """The ``k`` flows deepest in the shared core and the ``k`` farthest from it; where a flow
    is in both, it counts as coupled."""
    rows = coupling_of_reach(footprints) if isinstance(footprints, Reach) else coupling(footprints, shared_core(footprints))
    rows = Workspace(rows.sparkSession, "arms").save(rows, "rows").withColumnRenamed("source_key", "journey")
    top = rows.orderBy(F.desc("overlap"), F.desc("size"), "journey").limit(k).withColumn("arm", F.lit("coupled"))
    bottom = rows.orderBy("overlap", "size", F.desc("journey")).limit(k).withColumn("arm", F.lit("apart"))
    return top.unionByName(bottom.join(top.select("journey"), "journey", "left_anti")).select("journey", "overlap", "size", "arm")


def suffix_lookup(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each path with the known path that is its longest suffix: ``relpath, file_path``."""
    parts = F.split("relpath", "/")
    cut = paths.where("relpath <> ''").distinct().select("relpath", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("at", "suffix"))
    known = nodes.where("file_path is not null").select(F.col("file_path").alias("suffix")).distinct()
    best = F.min(F.struct("at", "suffix"))["suffix"]
    return cut.join(known, "suffix").groupBy("relpath").agg(best.alias("file_path"))


def stride_sample(rows: DataFrame, key: str, want: int) -> DataFrame:
    """``want`` evenly spaced rows of the sorted ``key``; all if there are no more.

    Positions come from counts per range partition, so that the sort is not one task's work.
    """
    total = rows.count()
    if total <= want:
        return rows.select(key)
    chosen = rows.sparkSession.createDataFrame([(int(i * (total / want)),) for i in range(want)], "position long").distinct()
    return positions(rows, key).join(F.broadcast(chosen), "position", "left_semi").select(key)


def trigger_hits(triggers: DataFrame, paths: DataFrame) -> DataFrame:
    """``registry_id, glob, journey_id, path`` for paths that a valid glob matches.

    The distinct globs, whose number is that of patterns people wrote, are turned into
    regular expressions in blocks; each path is tested against a block's array of patterns
    in one pass, and only its hits come out.
    """
    globs = sorted(r["glob"] for r in triggers.select("glob").distinct().collect() if r["glob"] and glob_problem(r["glob"]) is None)
    hits = None
    for at in range(0, len(globs), GLOBS_AT_ONCE):
        tests = [F.when(F.col("path").rlike(glob_to_regex(g)), F.lit(g)) for g in globs[at : at + GLOBS_AT_ONCE]]
        part = paths.select("path", F.explode(F.array_compact(F.array(*tests))).alias("glob"))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = paths.select("path", F.lit("").alias("glob")).limit(0)
    return triggers.join(hits, "glob").select("registry_id", "glob", "journey_id", "path")
