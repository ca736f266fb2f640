"""The typed symbol graph: snapshots, edge confidence and the propagation relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the confidence model.
DEFAULT_CONFIDENCE = 0.9
HEURISTIC_CONFIDENCE = 0.3
COLLISION_CONFIDENCE = 0.5
LOW_CONFIDENCE = 0.6
FAN_IN_KINDS = ["calls", "references", "instantiates", "imports"]
WALKED_KINDS = ["calls", "references", "instantiates", "extends", "imports"]

METADATA = "confidence double, resolvedBy string, refName string, valueRef boolean"


def last_version(rows: DataFrame, key: str, columns: list, at: str) -> DataFrame:
    """One whole row per ``key``: the last by ``at`` (if there is such a column), of equal ones the
    largest; never a mixture of several rows."""
    order = [F.col(at).alias("at")] if at in rows.columns else []
    return rows.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("r")).select(key, *(F.col(f"r.{name}") for name in rows.select(*columns).columns))


def symbols(nodes: DataFrame) -> DataFrame:
    """One row per id that is in the index now; rows delivered again collapse."""
    columns = [F.lower(F.trim("kind")).alias("kind"), "name", "qualified_name", "file_path", "start_line", "end_line"]
    return last_version(nodes.where("removed_at is null and id is not null"), "id", columns, "indexed_at")


def links(edges: DataFrame, kinds: list[str] | None = None, columns: tuple[str, ...] = ("source", "target", "kind", "metadata", "provenance", "line")) -> DataFrame:
    """One row per edge id with both ends; metadata parsed once, unreadable text gives nulls.

    Deliveries of an edge differ in ``loaded_at`` at most, so ``kinds`` and ``columns`` cut the rows
    before they are shuffled.
    """
    rows = edges.where("source is not null and source <> '' and target is not null and target <> ''")
    once = last_version(rows.where(F.col("kind").isin(kinds)) if kinds else rows, "id", list(columns), "loaded_at")
    return once.withColumn("meta", F.from_json("metadata", METADATA)).drop("metadata") if "metadata" in columns else once


def is_file_id(column: Column) -> Column:
    return column.startswith("file:")


def ambiguous_names(nodes: DataFrame) -> DataFrame:
    """Names that more than one symbol (files aside) carries: ``name, n``."""
    return nodes.where(F.col("name").isNotNull() & F.coalesce(F.col("kind") != "file", F.lit(True))).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ambiguous_ids(nodes: DataFrame) -> DataFrame:
    held = nodes.where(F.col("name").isNotNull() & F.coalesce(F.col("kind") != "file", F.lit(True))).select("id", "name")
    return held.join(ambiguous_names(nodes).select("name"), "name", "left_semi").select("id")


def weighted(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``conf`` and ``cap`` to the walked edges.

    Confidence is the least of the recorded, the heuristic and the name-collision bound; the
    cap token says which of them binds, the collision bound first, then the heuristic one. An
    uncapped edge whose recorded confidence is 1.0 carries 'name-collision', as the bounds tie.
    """
    walked = edge.where(F.col("kind").isin(WALKED_KINDS))
    shared = ambiguous_ids(nodes).select(F.col("id").alias("target"), F.lit(True).alias("shared"))
    by_name = walked.where(F.col("meta.resolvedBy") == "exact-match").join(shared, "target", "left")
    rest = walked.where(F.coalesce(F.col("meta.resolvedBy") != "exact-match", F.lit(True))).withColumn("shared", F.lit(None).cast("boolean"))
    rows = by_name.unionByName(rest)
    meta = F.coalesce(F.col("meta.confidence"), F.lit(DEFAULT_CONFIDENCE))
    heuristic = F.when(F.col("provenance") == "heuristic", HEURISTIC_CONFIDENCE).otherwise(1.0)
    collision = F.when(F.col("shared"), COLLISION_CONFIDENCE).otherwise(1.0)
    cap = (
        F.when((collision <= meta) & (collision <= heuristic), "name-collision")
        .when(heuristic <= meta, "heuristic")
        .when(meta <= LOW_CONFIDENCE, "metadata")
        .otherwise("")
    )
    return rows.select("id", "source", "target", "kind", F.least(meta, heuristic, collision).alias("conf"), cap.alias("cap"))


def impact_relation(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """``frm, nxt, ec, ecap``: from what changed to what may feel it; null ``ec`` inherits."""
    back = weighted(edge, nodes).select(F.col("target").alias("frm"), F.col("source").alias("nxt"), F.col("conf").alias("ec"), F.col("cap").alias("ecap"))
    return back.unionByName(_contained(edge).select("frm", "nxt", F.lit(None).cast("double").alias("ec"), F.lit(None).cast("string").alias("ecap"))).distinct()


def inverse(relation: DataFrame) -> DataFrame:
    return relation.select(F.col("nxt").alias("frm"), F.col("frm").alias("nxt"), "ec", "ecap")


def _contained(edge: DataFrame) -> DataFrame:
    """From a file to each symbol in it."""
    return edge.where((F.col("kind") == "contains") & is_file_id(F.col("source"))).select(F.col("source").alias("frm"), F.col("target").alias("nxt"))


def dependency_relation(edge: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """``frm, nxt, ec, ecap`` of what a symbol depends on: walked edges forward, and the one
    file that holds it (its last ``contains`` edge). ``dropped`` are (source, target) pairs
    to leave out, whatever their kind."""
    ahead = edge.where(F.col("kind").isin(WALKED_KINDS)).select(F.col("source").alias("frm"), F.col("target").alias("nxt"))
    if dropped is not None:
        pairs = dropped.select(F.col("source").alias("frm"), F.col("target").alias("nxt")).distinct()
        ahead = ahead.join(pairs, ["frm", "nxt"], "left_anti")
    last = edge.where((F.col("kind") == "contains") & is_file_id(F.col("source"))).groupBy("target").agg(F.max(F.struct("id", "source"))["source"].alias("nxt"))
    return ahead.unionByName(last.select(F.col("target").alias("frm"), "nxt")).distinct().select("frm", "nxt", F.lit(None).cast("double").alias("ec"), F.lit(None).cast("string").alias("ecap"))


def caller_counts(edge: DataFrame) -> DataFrame:
    """Edges per target over the four kinds that count as fan-in (``extends`` does not)."""
    counted = edge.where(F.col("kind").isin(FAN_IN_KINDS))
    return counted.groupBy("target").agg(F.count(F.lit(1)).alias("callers"))
