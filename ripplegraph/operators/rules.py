"""Data-quality rules: each gives 0..n findings ``rule, severity, subject, message``.

An input is BLOCKED as soon as one finding blocks; a refusal is a row, never an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.journeys import clean_path, suffix_match

# Fixed values of the guards.
MTIME_SLOP_SECONDS = 2
SPOT_CHECK_FLOOR = 0.8
MIN_TOLERANCE_EDGES = 2


def finding(rule: str, severity, subject: Column, message: Column) -> list[Column]:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return [F.lit(rule).alias("rule"), level.alias("severity"), subject.cast("string").alias("subject"), message.alias("message")]


def schema_pin(registries: DataFrame, version: int | None) -> DataFrame:
    """Unpinned warns; pinned but absent blocks; a different version blocks."""
    pin, have = F.col("codegraph_schema_version"), F.lit(version).cast("int")
    state = F.when(pin.isNull(), "unpinned").when(have.isNull(), "absent").when(pin != have, "differs")
    rows = registries.withColumn("state", state).where("state is not null")
    return rows.select(*finding("schema", F.when(F.col("state") == "unpinned", "warning").otherwise("blocking"), F.col("registry_id"), F.col("state")))


def extraction_pin(registries: DataFrame, version: int | None) -> DataFrame:
    """Never blocks: unpinned, absent, older and newer each warn in their own words."""
    pin, have = F.col("codegraph_extraction_version"), F.lit(version).cast("int")
    state = F.when(pin.isNull() & have.isNull(), "unknown").when(pin.isNull(), "unpinned").when(have.isNull(), "absent").when(have < pin, "older").when(have > pin, "newer")
    rows = registries.withColumn("state", state).where("state is not null")
    return rows.select(*finding("extraction", "warning", F.col("registry_id"), F.col("state")))


def approval(registries: DataFrame) -> DataFrame:
    """A registry that is not approved warns, a missing flag in other words than a false one; what it
    declares not to see is counted, if it has ``blind_spots``."""
    rows = registries.where(F.coalesce(~F.col("approved"), F.lit(True)))
    text = F.when(F.col("approved").isNull(), "approval missing").otherwise("not approved")
    if "blind_spots" in registries.columns:
        n = F.size(F.coalesce("blind_spots", F.array().cast("array<string>")))
        text = F.when(n > 0, F.concat(text, F.format_string("; %d blind spots", n))).otherwise(text)
    return rows.select(*finding("approval", "warning", F.col("registry_id"), text))


def pending(refs: DataFrame, most: int, schema_matches: bool = True) -> DataFrame:
    """Blocks if more than ``most`` references are pending (``status``)."""
    counted = refs.agg(F.count_if(F.col("status") == "pending").alias("n"))
    return counted.where(F.col("n") > most).select(*finding("pending", "blocking" if schema_matches else "warning", F.lit("references"), F.col("n").cast("string")))


def spot_checks(checks: DataFrame, nodes: DataFrame, callers: DataFrame) -> DataFrame:
    """``registry_id, name, file, min_caller_edges, suspended`` against the graph.

    A check with a reason to be suspended warns with it and is skipped; a name the index lacks (in
    that file, where one is given) blocks; callers of all its nodes under the floor block.
    """
    known = nodes.where("name is not null and kind is distinct from 'file'").select("id", "name", clean_path(F.col("file_path")).alias("path"))
    counted = known.join(callers.select(F.col("target").alias("id"), "callers"), "id", "left").groupBy("name", "path").agg(F.sum(F.coalesce("callers", F.lit(0))).alias("callers"))
    reason = F.nullif(F.trim("suspended"), F.lit(""))
    asked = checks.select("registry_id", "name", "file", "min_caller_edges", reason.alias("reason")).distinct()
    fits = F.col("file").isNull() | suffix_match(F.col("path"), F.col("file"))
    met = asked.where("reason is null").join(counted, "name", "left").groupBy("registry_id", "name", "file", "min_caller_edges").agg(F.sum(F.when(fits, F.col("callers"))).alias("total"))
    state = F.when(F.col("total").isNull(), "missing").when(F.col("total") < F.col("min_caller_edges"), "below floor")
    subject = F.concat_ws(":", F.col("registry_id").cast("string"), "name")
    judged = met.withColumn("state", state).where("state is not null").select(*finding("spot-check", "blocking", subject, F.col("state")))
    return judged.unionByName(asked.where("reason is not null").select(*finding("spot-check", "warning", subject, F.concat(F.lit("suspended: "), F.col("reason")))))


def stale(files: DataFrame, newest_change: DataFrame) -> DataFrame:
    """``path, indexed_at`` against ``path, changed_at`` (both timestamps): warns beyond the slop."""
    met = files.join(newest_change, "path").where(F.col("changed_at") > F.col("indexed_at") + F.make_interval(secs=F.lit(MTIME_SLOP_SECONDS)))
    return met.select(*finding("stale", "warning", F.col("path"), F.lit("changed after it was indexed")))


def epoch_timestamp(epoch: Column) -> Column:
    """Seconds or milliseconds since the epoch as a timestamp."""
    return F.timestamp_millis(F.when(epoch > F.lit(10**12), epoch).otherwise(epoch * 1000))


def drift(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Paths whose content (``path, content``) no longer has the recorded hash; null hashes and
    files that are not there are passed over."""
    met = files.where("content_hash is not null").select("path", "content_hash").distinct().join(contents.where("content is not null"), "path")
    return met.where(F.sha2("content", 256) != F.col("content_hash")).select("path").distinct()


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blocked(findings: DataFrame) -> DataFrame:
    """One row: BLOCKED or OK, with the counts behind it."""
    n = findings.agg(F.count_if(F.col("severity") == "blocking").alias("blocking"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return n.select(F.when(F.col("blocking") > 0, "BLOCKED").otherwise("OK").alias("status"), "blocking", "warnings")
