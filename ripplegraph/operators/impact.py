"""From changed lines to ranked flows: seeds, unmapped files, confinement, ranking, fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.paths import is_test_path
from ripplegraph.operators.bitclosure import levels_of, positions
from ripplegraph.operators.closure import reachable, widest_closure
from ripplegraph.operators.graph import FAN_IN_KINDS, LOW_CONFIDENCE, is_file_id
from ripplegraph.operators.journeys import natural_key
from ripplegraph.operators.reach import Reach, product, widest_rows
from ripplegraph.session import Workspace


def _lines(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.coalesce(F.col("kind") != "file", F.lit(True)) & F.col("file_path").isNotNull()).select("id", "file_path", "start_line", "end_line")


def seeds_of_hunks(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symbols whose lines overlap a changed range of their file: ``file_path, id``.

    An equi-join on the file with the overlap as its residual condition; hunks are first made
    distinct, and large files are met on blocks of ``1 << 10`` lines so that neither side
    multiplies over a whole file.
    """
    block = 10
    cut = hunks.where("lo is not null and hi is not null and hi >= lo").select("file_path", "lo", "hi").distinct().withColumn("block", F.explode(F.sequence(F.shiftright("lo", block), F.shiftright("hi", block))))
    span = _lines(nodes).where("end_line >= start_line").withColumn("block", F.explode(F.sequence(F.shiftright("start_line", block), F.shiftright("end_line", block))))
    return cut.join(span, ["file_path", "block"]).where("start_line <= hi and end_line >= lo").select("file_path", "id").distinct()


def seeds_of_files(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """All symbols of wholly changed files: ``file_path, id``."""
    return _lines(nodes).join(paths.select("file_path").distinct(), "file_path", "left_semi").select("file_path", "id")


def unmapped(changed: DataFrame, seeds: DataFrame) -> DataFrame:
    """Changed files that no symbol answers to."""
    return changed.select("file_path").where("file_path is not null").distinct().join(seeds.select("file_path").distinct(), "file_path", "left_anti")


def files_of_closure(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per source key the files it reaches, or null if any id is not in the index."""
    met = reached.join(nodes.select("id", "file_path", F.lit(True).alias("known")), "id", "left")
    grouped = met.groupBy("source_key").agg(F.bool_and(F.col("known").isNotNull()).alias("whole"), F.collect_set("file_path").alias("files"), F.count(F.lit(1)).alias("reached"))
    return grouped.select("source_key", F.when(F.col("whole"), F.array_join(F.array_sort("files"), ",")).alias("files"), F.when(F.col("whole"), F.size("files").cast("long")).alias("n_files"), "reached")


def files_of_reach(reached: Reach, nodes: DataFrame) -> DataFrame:
    """The same of a closure in parts; the files of the core are gathered once, and names only of sources that are whole."""
    met = lambda df: df.join(nodes.select("id", "file_path", F.lit(True).alias("known")), "id", "left")
    sums = [F.bool_and(F.col("known").isNotNull()).alias("whole"), F.count(F.lit(1)).alias("reached")]
    work = Workspace(nodes.sparkSession, "files")
    own, core = work.save(met(reached.pairs), "own"), work.save(met(reached.core), "core")
    through = reached.through.crossJoin(F.broadcast(core.agg(*sums).where("reached > 0")))
    each = own.groupBy("source_key").agg(*sums).unionByName(through.select("source_key", "whole", "reached"))
    each = work.save(each.groupBy("source_key").agg(F.bool_and("whole").alias("whole"), F.sum("reached").alias("reached")), "each")
    whole = each.where("whole").select("source_key")
    of_core = core.where("file_path is not null").select(F.col("file_path").alias("id")).distinct()
    files = own.join(whole, "source_key", "left_semi").select("source_key", "file_path").unionByName(product(reached.through.join(whole, "source_key", "left_semi"), of_core).select("source_key", F.col("id").alias("file_path")))
    listed = files.groupBy("source_key").agg(F.collect_set("file_path").alias("files"))
    rows = each.join(listed, "source_key", "left")
    return rows.select("source_key", F.when(F.col("whole"), F.array_join(F.array_sort("files"), ",")).alias("files"), F.when(F.col("whole"), F.size("files").cast("long")).alias("n_files"), "reached")


def confined_files(seeds: DataFrame, entries: DataFrame, relation: DataFrame, nodes: DataFrame) -> DataFrame:
    """Changed files whose seeds, entries aside, reach nothing outside the file.

    One keyed closure for all files. A file all of whose seeds are entries is not confined by
    this rule, nor is one that reaches an id the index does not know.
    """
    uncovered = seeds.join(entries.where("id is not null").select("id").distinct(), "id", "left_anti")
    reached = reachable(uncovered.select(F.col("file_path").alias("source_key"), "id"), relation)
    met = reached.join(nodes.select("id", "file_path"), "id", "left")
    return met.groupBy("source_key").agg(F.bool_and(F.coalesce(F.col("file_path") == F.col("source_key"), F.lit(False))).alias("inside")).where("inside").select(F.col("source_key").alias("file_path"))


def rank_journeys(reached: DataFrame, entries: DataFrame, callers: DataFrame) -> DataFrame:
    """Flows whose entries were reached, ranked by the callers of those entries.

    ``journey, rank, entries_hit, confidence, verify, weak_reason``; the confidence is that of
    the best entry, ties in it go to the larger cap, and the reason shows only at or under
    the low mark.
    """
    hit = entries.where("id is not null").select("journey", "id").distinct().join(reached.select("id", "conf", "cap"), "id")
    counted = hit.join(callers.select(F.col("target").alias("id"), "callers"), "id", "left")
    best = F.max(F.struct("conf", "cap"))
    rows = counted.groupBy("journey").agg(F.sum(F.coalesce("callers", F.lit(0))).alias("rank"), F.count(F.lit(1)).alias("entries_hit"), best.alias("best"))
    low = F.col("best.conf") <= LOW_CONFIDENCE
    return rows.select("journey", "rank", "entries_hit", F.round("best.conf", 3).alias("confidence"), low.alias("verify"), F.when(low & (F.col("best.cap") != ""), F.col("best.cap")).alias("weak_reason"))


def with_triggers(ranked: DataFrame, triggered: DataFrame) -> DataFrame:
    """Graph rows joined in full with flows that a path trigger names (``journey, triggered_by``)."""
    by = triggered.groupBy("journey").agg(F.array_join(F.array_sort(F.collect_set("triggered_by")), ",").alias("triggered_by"))
    both = ranked.withColumn("graph", F.lit(True)).join(by, "journey", "full")
    only = F.col("graph").isNull()
    return both.select(
        "journey",
        F.coalesce("rank", F.lit(0)).cast("long").alias("rank"),
        F.coalesce("entries_hit", F.lit(0)).cast("long").alias("entries_hit"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("verify", F.lit(False)).alias("verify"),
        F.when(only, F.lit("file-trigger")).otherwise(F.col("weak_reason")).alias("reason"),
        "triggered_by",
    )


def with_fallback(rows: DataFrame, journeys: DataFrame, unmapped_files: DataFrame, untriggered: DataFrame) -> DataFrame:
    """If anything stayed unmapped or untriggered, all remaining flows join with confidence 0."""
    n_unmapped = unmapped_files.agg(F.count(F.lit(1)).alias("n_unmapped"))
    n_untriggered = untriggered.agg(F.count(F.lit(1)).alias("n_untriggered"))
    state = n_unmapped.withColumn("one", F.lit(1)).join(n_untriggered.withColumn("one", F.lit(1)), "one")
    rest = journeys.select("journey").distinct().join(rows.select("journey"), "journey", "left_anti").withColumn("one", F.lit(1)).join(F.broadcast(state), "one").where("n_unmapped > 0 or n_untriggered > 0")
    reason = F.when(F.col("n_unmapped") > 0, "unmapped-files").otherwise("unmodeled-paths")
    added = rest.select("journey", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("entries_hit"), F.lit(0.0).alias("confidence"), F.lit(True).alias("verify"), reason.alias("reason"), F.lit(None).cast("string").alias("triggered_by"))
    return rows.unionByName(added)


def in_order(rows: DataFrame) -> DataFrame:
    """An answer (``journey, rank, ...``) with its ``position`` from 1: by rank, the highest first, then
    so that J2 comes before J10. Sorted by ranges, not in one task."""
    head, tail, whole = natural_key(F.col("journey"))
    keyed = rows.withColumn("order", F.struct((-F.col("rank")).alias("rank"), head.alias("head"), tail.alias("tail"), whole.alias("id")))
    keyed = Workspace(rows.sparkSession, "answer").save(keyed, "rows")
    return keyed.join(positions(keyed, "order"), "order").drop("order").withColumn("position", F.col("position") + 1)


def lost_files(changed: DataFrame, seeds: DataFrame, drifted: DataFrame | None = None) -> DataFrame:
    """Changed files that no symbol answers to, or whose content no longer is what was indexed."""
    lost = unmapped(changed, seeds)
    if drifted is None:
        return lost
    stale = changed.where("file_path is not null").join(drifted.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("file_path")
    return lost.unionByName(stale).distinct()


def file_nodes(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node that stands for each file: ``file_path, id``; of several the smallest id."""
    held = nodes.where("kind = 'file' and file_path is not null").groupBy("file_path").agg(F.min("id").alias("id"))
    return paths.select("file_path").where("file_path is not null").distinct().join(held, "file_path")


def file_map(nodes: DataFrame) -> DataFrame:
    """Every symbol with its file, '' where it has none."""
    return nodes.select("id", F.coalesce("file_path", F.lit("")).alias("file_path"))


def fan_in_by_name(edges: DataFrame, nodes: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Callers per name and file, files and calls from tests left out: the ``k`` largest, and for
    these the files that call them with the number of calls."""
    source = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("caller_file"))
    target = nodes.where(F.coalesce(F.col("kind") != "file", F.lit(True)) & F.col("name").isNotNull()).select(F.col("id").alias("target"), "name", "file_path")
    counted = edges.where(F.col("kind").isin(FAN_IN_KINDS)).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    met = counted.join(target, "target").join(source, "source", "left").where(~F.coalesce(is_test_path(F.col("caller_file")), F.lit(False)))
    per_file = Workspace(edges.sparkSession, "fan-in").save(met.groupBy("name", "file_path", "caller_file").agg(F.sum("n").alias("n")), "files")
    top = per_file.groupBy("name", "file_path").agg(F.sum("n").alias("callers")).orderBy(F.desc("callers"), "name", "file_path").limit(k)
    chosen = top.select(F.col("name").alias("top_name"), F.col("file_path").alias("top_file"))
    callers = per_file.join(F.broadcast(chosen), per_file["name"].eqNullSafe(chosen["top_name"]) & per_file["file_path"].eqNullSafe(chosen["top_file"]), "left_semi")
    return top, callers


def reverse_index(entries: DataFrame, inverse_relation: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every symbol with the flows a change of it can reach: ``journey, id, conf``.

    One closure from all entries along the inverse relation instead of one per symbol: the
    least confidence along a path is the same from either end.
    """
    starts = entries.where("id is not null").select(F.col("journey").alias("source_key"), "id")
    shown = nodes.where(F.col("file_path").isNotNull() & F.coalesce(F.col("kind") != "file", F.lit(True)) & ~is_file_id(F.col("id"))).select("id")
    levels = levels_of(inverse_relation)
    reached = widest_rows(starts, inverse_relation, levels, shown) if levels else widest_closure(starts, inverse_relation).join(shown, "id", "left_semi")
    return reached.select(F.col("source_key").alias("journey"), "id", "conf")


def shared_core(footprints: DataFrame, share: float = 0.5) -> DataFrame:
    """Nodes in at least ``share`` of the footprints (``source_key, id``): ``id, in_footprints``."""
    total = footprints.select("source_key").distinct().agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    held = footprints.groupBy("id").agg(F.count_distinct("source_key").alias("in_footprints")).withColumn("one", F.lit(1))
    return held.join(F.broadcast(total), "one").where(F.col("in_footprints") >= F.lit(share) * F.col("n")).select("id", "in_footprints")


def coupling(footprints: DataFrame, core: DataFrame) -> DataFrame:
    """Per flow the part of its footprint that lies in the shared core: ``source_key, overlap, size``."""
    marked = footprints.join(core.select("id", F.lit(1).alias("core")), "id", "left")
    return marked.groupBy("source_key").agg(F.count("core").alias("overlap"), F.count(F.lit(1)).alias("size"))


def core_of_reach(reached: Reach, share: float = 0.5) -> DataFrame:
    """``shared_core`` of a closure in parts."""
    total = reached.sizes().agg(F.count(F.lit(1)).alias("total"))
    return reached.counts().crossJoin(F.broadcast(total)).where(F.col("n") >= F.lit(share) * F.col("total")).select("id", F.col("n").alias("in_footprints"))


def coupling_of_reach(reached: Reach) -> DataFrame:
    """``coupling`` of a closure in parts with its shared core."""
    return reached.sizes(Workspace(reached.core.sparkSession, "coupling").save(core_of_reach(reached), "shared"))
