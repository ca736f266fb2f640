"""The append-only ledger as files: tolerant reading, appending, and a stream of it."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.session import Workspace

SCHEMA = (
    "kind string, ts string, repo string, base string, head string, commit string, base_commit string, status string, n_journeys long, journey_ids array<string>, "
    "recall_degraded boolean, closure_confined array<string>, duration_ms double, caller string, journey string, verdict string, note string, edge_provenance string, _broken string"
)


def _clean(rows: DataFrame, default_kind: str | None) -> DataFrame:
    """Torn and non-object lines go; a time that is no number sorts first, as 0."""
    whole = rows.where("_broken is null").drop("_broken")
    if default_kind:
        whole = whole.withColumn("kind", F.coalesce("kind", F.lit(default_kind)))
    return whole.withColumn("ts", F.coalesce(F.col("ts").try_cast("double"), F.lit(0.0)))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds ``seq``: file time, file, block and line, as one text that sorts."""
    at = "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    number = lambda c: F.lpad(c.cast("string"), 16, "0")
    return rows.select("*", F.concat_ws(" ", F.date_format(at[0], "yyyyMMddHHmmss.SSS"), at[1], number(F.col(at[2])), number(line)).alias("seq"))


def read_ledger(spark: SparkSession, path: str, legacy_path: str | None = None, repo: str | None = None) -> DataFrame:
    """All well-formed rows, the legacy file's without a kind being selections; order by ``ts``."""
    reader = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    rows = _clean(_placed(reader.json(path)), None)
    if legacy_path:
        rows = _clean(_placed(reader.json(legacy_path)), "selection").unionByName(rows)
    return rows if repo is None else rows.where(F.col("repo") == repo)


def append_rows(rows: DataFrame, path: str) -> bool:
    """Append rows as JSON lines, null fields left out; False where the place refuses them.

    Recording must not break what is recorded: failures to write are no errors here. Faults of the
    rows' own plan are, and raise.
    """
    rows.schema  # noqa: B018 -- a plan that cannot be resolved fails here
    try:
        rows.write.mode("append").option("ignoreNullFields", "true").json(path)
    except (AnalysisException, Py4JJavaError) as error:
        if "FileSystem" in str(error) or "IOException" in str(error) or "Mkdirs" in str(error) or "not a directory" in str(error).lower():
            return False
        raise
    return True


def write_atomically(rows: DataFrame, path: str) -> None:
    """Replace a JSON table whole or not at all: the new version is written beside the old one, then
    a small pointer is moved into place; ``read_current`` follows it."""
    place = Workspace(rows.sparkSession, "table", path)
    version = f"v-{uuid.uuid4().hex[:12]}"
    rows.write.json(place.at(version))
    before = place.read_text("current") if "current" in place.names("") else None
    place.write_text("current", version)
    if before:
        place.drop(before)


def read_current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The version of a table that ``write_atomically`` put in place last."""
    place = Workspace(spark, "table", path)
    return spark.read.schema(schema).json(place.at(place.read_text("current")))


def outcomes_of(rows: DataFrame) -> DataFrame:
    """``repo, commit, journey, verdict, ts, seq`` of outcome rows. Of equal times the later line of
    the later file counts, however the files are split over tasks."""
    o = rows.where("kind = 'outcome'")
    return o.select("repo", "commit", "journey", "verdict", "ts", "seq")


def selections_of(rows: DataFrame) -> DataFrame:
    """``repo, commit, base, status, journey_id, ts``: one row per named flow, one with null if none."""
    from ripplegraph.operators.ledger import selection_keys

    s = selection_keys(rows.where("kind = 'selection'"))
    return s.select("repo", F.col("join_commit").alias("commit"), F.col("join_base").alias("base"), "status", F.explode_outer("journey_ids").alias("journey_id"), "ts")
