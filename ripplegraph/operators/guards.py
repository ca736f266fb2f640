"""Refusals and warnings beside the quality rules: the index itself, triggers, source drift, writes.

Each rule gives 0..n rows ``rule, severity, subject, message``; an input is refused by a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.paths import glob_is_valid
from ripplegraph.operators.journeys import suffix_match
from ripplegraph.operators.ledger import is_sha
from ripplegraph.operators.rules import finding
from ripplegraph.session import Workspace

#: Tables and columns without which a folder is no index.
REQUIRED = {"files": ["path"], "nodes": ["id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line"], "edges": ["source", "target", "kind", "metadata", "provenance"]}
VERDICTS = ["pass", "fail", "skip"]


class IndexRefused(RuntimeError):
    """An index that cannot be used; ``state`` is 'missing', 'unreadable' or 'not an index'."""

    def __init__(self, state: str, folder: str, detail: str):
        super().__init__(f"{folder}: {state} ({detail})")
        self.state, self.folder, self.detail = state, folder, detail


def open_index(spark: SparkSession, folder: str, required: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The tables of an index folder, or ``IndexRefused``: a folder that is not there, one whose
    tables cannot be read, and one that holds something else are three different failures."""
    place, required = Workspace(spark, "index", folder), required or REQUIRED
    names = place.names("")
    if not names:
        raise IndexRefused("missing", folder, "no such folder, or an empty one")
    lacking = [t for t in required if f"{t}.parquet" not in names]
    if lacking:
        raise IndexRefused("not an index", folder, "no table " + ", ".join(lacking))
    tables = {}
    for name, columns in required.items():
        try:
            tables[name] = spark.read.parquet(f"{folder}/{name}.parquet")
            tables[name].limit(1).collect()
        except Exception as error:  # noqa: BLE001 -- whatever the reader says, the table cannot be read
            raise IndexRefused("unreadable", folder, f"{name}: {type(error).__name__}") from error
        absent = [c for c in columns if c not in tables[name].columns]
        if absent:
            raise IndexRefused("not an index", folder, f"{name} lacks " + ", ".join(absent))
    return tables


def index_findings(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One blocking row per folder that is no usable index."""
    rows = []
    for folder in folders:
        try:
            open_index(spark, folder)
        except IndexRefused as refused:
            rows.append(("index", "blocking", folder, refused.state))
    return spark.createDataFrame(rows, "rule string, severity string, subject string, message string")


def schema_version(versions: DataFrame) -> DataFrame:
    """One row: the highest recorded ``version``, null if none is recorded."""
    return versions.agg(F.max("version").alias("version"))


def extraction_version(metadata: DataFrame, key: str) -> DataFrame:
    """One row: the value of ``key`` as a number, null where it is absent or no number."""
    return metadata.where(F.col("key") == key).agg(F.max(F.col("value").try_cast("int")).alias("version"))


def pending_guard(refs: DataFrame | None, most: int, pin: int | None, found: int | None) -> DataFrame:
    """Too many pending references block. An index without the table or its ``status`` is an older
    one, which warns, unless its schema is the pinned one: then it is incomplete, and blocks."""
    lacks = "no table" if refs is None else "no status" if "status" not in refs.columns else None
    if lacks:
        spark = refs.sparkSession if refs is not None else SparkSession.getActiveSession()
        severity = "blocking" if pin is not None and pin == found else "warning"
        return spark.createDataFrame([("pending", severity, "references", lacks)], "rule string, severity string, subject string, message string")
    counted = refs.agg(F.count_if(F.col("status") == "pending").alias("n"))
    return counted.where(F.col("n") > most).select(*finding("pending", "blocking", F.lit("references"), F.col("n").cast("string")))


_STRING = r'"(?:[^"\\]|\\.)*"'
_STRINGS = rf"\A\[\s*{_STRING}\s*(?:,\s*{_STRING}\s*)*\]\z"


def trigger_problems(registries: DataFrame, journeys: DataFrame) -> DataFrame:
    """Path triggers that can never fire or name no journey: each blocks.

    ``registries`` has ``registry_id, file_triggers`` (JSON text), ``journeys`` has ``registry_id,
    journey_id``. 'shape': not an object; 'glob': a pattern that matches no path as written;
    'ids': not a list of names, or an empty one; 'unknown journey': a name the registry lacks.
    """
    rows = registries.where("file_triggers is not null").select("registry_id", F.trim("file_triggers").alias("text")).distinct()
    parsed = rows.select("registry_id", "text", F.from_json("text", "map<string, string>").alias("m"))
    no_object = parsed.where((F.col("text") != "null") & (~F.col("text").startswith("{") | F.col("m").isNull())).select(*finding("trigger", "blocking", F.col("registry_id"), F.lit("shape")))
    each = parsed.where(F.col("text").startswith("{")).select("registry_id", F.explode("m").alias("glob", "ids"))
    subject = F.concat_ws(":", "registry_id", "glob")
    good = F.coalesce(F.col("ids").rlike(_STRINGS), F.lit(False))
    state = F.when(~glob_is_valid(F.col("glob")), "glob").when(~good, "ids")
    bad = each.withColumn("state", state)
    shaped = bad.where("state is not null").select(*finding("trigger", "blocking", subject, F.col("state")))
    named = bad.where("state is null").select("registry_id", subject.alias("subject"), F.explode(F.from_json("ids", "array<string>")).alias("journey_id"))
    unknown = named.join(journeys.select("registry_id", "journey_id").distinct(), ["registry_id", "journey_id"], "left_anti")
    lost = unknown.select(*finding("trigger", "blocking", F.concat_ws(":", "subject", "journey_id"), F.lit("unknown journey")))
    return no_object.unionByName(shaped).unionByName(lost).distinct()


def unchecked_entries(entries: DataFrame) -> DataFrame:
    """Entries in files that no parser here reads: ``journey, name, file``."""
    return entries.where(F.col("file").isNotNull() & (F.col("file") != "") & ~F.col("file").endswith(".py")).select("journey", "name", "file").distinct()


def live_drift(entries: DataFrame, files: DataFrame, definitions: DataFrame, unparsed: DataFrame | None = None) -> DataFrame:
    """Entries (``journey, name, file``) that the sources do not define: ``journey, name, file, reason``.

    ``files`` has ``path``, ``definitions`` has ``path, name``, ``unparsed`` has ``path``. A file is meant by
    the end of its path; one candidate that defines the name is enough. Reasons: 'no such file',
    'not defined', and 'cannot parse' where no candidate could be read.
    """
    asked = entries.where(F.col("file").endswith(".py")).select("journey", "name", "file").distinct()
    base = lambda c: F.substring_index(c, "/", -1)
    known = files.where("path is not null").select("path", base(F.col("path")).alias("base")).distinct()
    wanted = asked.select("file", base(F.col("file")).alias("base")).distinct()
    candidates = wanted.join(known, "base").where(suffix_match(F.col("path"), F.col("file"))).select("file", "path")
    broken = (unparsed if unparsed is not None else files.limit(0)).select("path", F.lit(True).alias("broken")).distinct()
    defined = definitions.select("path", "name", F.lit(True).alias("defined")).distinct()
    met = asked.join(candidates, "file", "left").join(broken, "path", "left").join(defined, ["path", "name"], "left")
    state = met.groupBy("journey", "name", "file").agg(F.count("path").alias("files"), F.count_if(F.col("broken").isNull() & F.col("path").isNotNull()).alias("read"), F.count("defined").alias("defined"))
    reason = F.when(F.col("files") == 0, "no such file").when(F.col("defined") > 0, None).when(F.col("read") == 0, "cannot parse").otherwise("not defined")
    return state.select("journey", "name", "file", reason.alias("reason")).where("reason is not null")


#: What helps, by the beginning of a reason.
REMEDIES = {
    "no such file": "correct the entry's file, or bring the file back",
    "not defined": "index again if the change is committed, else commit it; or correct the entry",
    "cannot parse": "mend the syntax of the file",
}


def remedy(reason: Column) -> Column:
    out = F.lit("look the entry up in the source by hand")
    for start, text in REMEDIES.items():
        out = F.when(reason.startswith(start), text).otherwise(out)
    return out


def refused_outcomes(outcomes: DataFrame, journeys: DataFrame) -> DataFrame:
    """Rows (``journey, verdict, commit``) that must not be written, with the first ``reason`` against
    each: a verdict of no known kind, a journey of no registry, a revision that is an option or
    no commit id."""
    met = outcomes.join(journeys.select("journey", F.lit(True).alias("known")).distinct(), "journey", "left")
    reason = (
        F.when(~F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False)), "unknown verdict")
        .when(F.col("known").isNull(), "unknown journey")
        .when(F.coalesce(F.col("commit").startswith("-"), F.lit(False)), "option for a revision")
        .when(~F.coalesce(is_sha(F.col("commit")), F.lit(False)), "no commit")
    )
    return met.select("journey", "verdict", "commit", reason.alias("reason")).where("reason is not null")


def accepted_outcomes(outcomes: DataFrame, journeys: DataFrame) -> DataFrame:
    """The rows that may be written."""
    known = outcomes.join(journeys.select("journey").distinct(), "journey", "left_semi")
    return known.where(F.col("verdict").isin(VERDICTS) & is_sha(F.col("commit"))).select("journey", "verdict", "commit")


def recall_state(changed: DataFrame, unmapped: DataFrame, untriggered: DataFrame, seeds: DataFrame, reached: DataFrame) -> DataFrame:
    """One row: how far an answer can be trusted to be whole, and the counts behind it."""
    n = lambda df, c, name: df.agg(F.count_distinct(c).alias(name), F.lit(1).alias("one"))
    rows = n(changed, "file_path", "changed_files").join(n(unmapped, "file_path", "unmapped_files"), "one").join(n(untriggered, "path", "unmodeled_files"), "one")
    rows = rows.join(n(seeds, "id", "seed_symbols"), "one").join(n(reached, "id", "impacted_symbols"), "one").drop("one")
    return rows.select(((F.col("unmapped_files") > 0) | (F.col("unmodeled_files") > 0)).alias("recall_degraded"), "*")


def unknown_because(flows: DataFrame, warnings: DataFrame, confined: DataFrame, unchecked: DataFrame) -> DataFrame:
    """Why an empty answer is no answer: ``reason, n``; no rows if flows were named or nothing
    speaks against it."""
    counted = None
    for reason, rows in (("warnings", warnings), ("confined files", confined), ("unchecked entries", unchecked)):
        part = rows.agg(F.lit(reason).alias("reason"), F.count(F.lit(1)).alias("n"))
        counted = part if counted is None else counted.unionByName(part)
    named = flows.agg(F.count(F.lit(1)).alias("flows"), F.lit(1).alias("one"))
    return counted.where("n > 0").withColumn("one", F.lit(1)).join(F.broadcast(named), "one").where("flows = 0").select("reason", "n")


def verify_states(selected: DataFrame, credit: DataFrame, declared: DataFrame) -> DataFrame:
    """What was proved of each selected flow: ``journey, state``.

    'verified' and 'failed' go by the credited runs; a flow that only skipped runs declare is
    'skipped', one whose passing runs never touched an entry 'incomplete', any other 'uncovered'.
    """
    told = declared.groupBy("journey").agg(F.count_if(F.col("verdict") == "pass").alias("passes"), F.count_if(F.col("verdict") == "skip").alias("skips"))
    met = selected.select("journey").distinct().join(credit.select("journey", "verdict"), "journey", "left").join(told, "journey", "left")
    verdict = F.col("verdict")
    state = F.when(verdict == "fail", "failed").when(verdict == "pass", "verified").when(verdict == "skip", "skipped").when(F.col("passes") > 0, "incomplete").when(F.col("skips") > 0, "skipped").otherwise("uncovered")
    return met.select("journey", state.alias("state"))

