"""Named flows: registries resolved per target, their entries, and entry resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.operators.nested import FlatTables


def clean_path(path: Column) -> Column:
    """Forward slashes, and no leading ``./`` or ``/``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./|/)+", "")


def suffix_match(path: Column, suffix: Column) -> Column:
    """Anchored, case-sensitive suffix match by whole segments."""
    bare = F.regexp_replace(suffix, "^/+", "")
    return (path == bare) | path.endswith(F.concat(F.lit("/"), bare))


def resolve_registries(registries: DataFrame) -> DataFrame:
    """The one registry that holds for each target: approved before draft, then the latest, then the larger id."""
    rank = W.partitionBy("target").orderBy(F.desc(F.coalesce("approved", F.lit(False))), F.desc_nulls_last("reviewed_at"), F.desc("registry_id"))
    return registries.where("target is not null").select("registry_id", "target", "approved", "reviewed_at").distinct().withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")


def discover(found: DataFrame) -> DataFrame:
    """The registry file that holds for each target, among ``folder_rank, file_name, target``.

    The first folder with a match wins; in it approved files go before ``*.draft.json``, then by
    name. Other files than ``*.json`` and those without a target are passed over.
    """
    draft = F.col("file_name").endswith(".draft.json")
    rank = W.partitionBy("target").orderBy("folder_rank", draft, "file_name")
    named = found.where(F.col("target").isNotNull() & F.col("file_name").endswith(".json")).select("folder_rank", "file_name", "target").distinct()
    return named.withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")


class Journeys:
    """Long tables of the registries that hold: ``journeys`` and ``entries``."""

    def __init__(self, spark: SparkSession, traces: DataFrame, registries: DataFrame):
        flat = FlatTables(spark, traces, registries)
        held = resolve_registries(registries).select("registry_id", "target")
        label = F.concat_ws(":", "target", "journey_id").alias("journey")
        self.flat = flat
        self.journeys = flat.table("journey").join(held, F.col("record_id") == F.col("registry_id")).select("target", "journey_id", label, "name", "route", "n_entries")
        entry = flat.table("entry").join(held, F.col("record_id") == F.col("registry_id")).withColumn("journey_id", F.col("parent_key"))
        self.entries = entry.where("name is not null").select("target", "journey_id", label, "name", "file").distinct()


def resolve_entries(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries with every node they name: equal name, and where a file is given, its path ends with it.

    ``journey, name, file, id``; ``id`` is null for entries that nothing answers to.
    """
    known = nodes.where(F.coalesce(F.col("kind") != "file", F.lit(True))).select("id", F.col("name").alias("node_name"), clean_path(F.col("file_path")).alias("path"))
    fits = F.col("file").isNull() | suffix_match(F.col("path"), F.col("file"))
    hit = entries.join(known, (F.col("name") == F.col("node_name")) & fits, "left")
    return hit.select("target", "journey_id", "journey", "name", "file", "id")


def unresolved_journeys(resolved: DataFrame) -> DataFrame:
    """Journeys none of whose entries resolves, with the names that were tried."""
    grouped = resolved.groupBy("journey").agg(F.bool_and(F.col("id").isNull()).alias("lost"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return grouped.where("lost").select("journey", "names")


def natural_key(journey_id: Column) -> list[Column]:
    """Sort key that puts J2 before J10: the text before a closing number, the number or -1, the id."""
    head = F.regexp_extract(journey_id, r"^(.*?)(\d*)$", 1)
    tail = F.regexp_extract(journey_id, r"^(.*?)(\d*)$", 2)
    return [head, F.coalesce(tail.try_cast("bigint"), F.lit(-1).cast("bigint")), journey_id]
