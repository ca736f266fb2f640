"""The ledger as a stream: the last verdict per flow, and totals that a batch changes where it must.

What a verdict counts for depends on its own commit's selections and on the verdicts at their
bases, all of which may come late. So a batch is judged commit by commit: the commits it brings
rows for, and those that were selected against one of them. Their rows are read again, by the
parts of the logs they lie in; what changed is added to the totals. The rest is not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import ledger
from ripplegraph.session import Workspace
from ripplegraph.sources import ledger_io

#: Parts of a log by hash of repository and commit; a batch reads those it needs.
PARTS = 64
_OUTCOMES = "repo string, commit string, journey string, verdict string, ts double, seq string, batch int, part int"
_SELECTIONS = "repo string, commit string, base string, status string, journey_id string, ts double, batch int, part int"
_BASES = "repo string, base string, commit string, batch int, part int"
_COMMITS = "repo string, commit string, caught long, missed long, judged long, batch int, part int"
_TOTALS = "repo string, judged_commits long, caught long, missed long, observed_recall double, ready boolean"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New ledger files below ``path`` as they arrive; torn lines are dropped."""
    raw = spark.readStream.schema(ledger_io.SCHEMA).option("columnNameOfCorruptRecord", "_broken").option("maxFilesPerTrigger", files_per_batch).json(path)
    return ledger_io._clean(raw, None)


def latest_verdicts(rows: DataFrame) -> DataFrame:
    """A running aggregate: ``repo, commit, journey, verdict, ts``. A maximum over (ts, verdict)
    does not depend on the order of arrival, so it needs neither watermark nor sorting."""
    best = F.max(F.struct("ts", "verdict"))
    kept = rows.where("kind = 'outcome' and commit is not null and journey is not null").groupBy("repo", "commit", "journey").agg(best.alias("best"))
    return kept.select("repo", "commit", "journey", F.col("best.verdict").alias("verdict"), F.col("best.ts").alias("ts"))


def _part(commit: Column) -> Column:
    return F.pmod(F.xxhash64("repo", commit), F.lit(PARTS)).cast("int")


class RunningTotals:
    """Totals per repository in a folder, kept up batch by batch; a batch given twice counts once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.work = spark, Workspace(spark, "totals", path)

    def _append(self, rows: DataFrame, log: str, batch: int, by: str) -> DataFrame:
        place = self.work.at(f"{log}/batch={batch}")
        rows.withColumn("part", _part(F.col(by))).write.mode("overwrite").partitionBy("part").parquet(place)
        return rows

    def _read(self, log: str, schema: str, batch: int, keys: DataFrame, by: str) -> DataFrame:
        """The rows of a log whose (repo, ``by``) is among ``keys``; only their parts are read."""
        parts = [r["p"] for r in keys.select(_part(F.col(by)).alias("p")).distinct().collect()]
        rows = self.spark.read.schema(schema).parquet(self.work.at(log)) if self.work.names(log) else self.spark.createDataFrame([], schema)
        return rows.where(F.col("part").isin(parts) & (F.col("batch") <= batch)).join(keys, ["repo", by], "left_semi")

    def take(self, rows: DataFrame, batch: int) -> DataFrame:
        """Take in the ledger rows of a batch; returns the totals after it: as ``ledger.totals``."""
        work = self.work
        number = F.concat_ws(" ", F.lit(f"{batch:012d}"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
        rows = work.save(rows.withColumn("seq", number), f"rows-{batch}")
        outcomes = ledger_io.outcomes_of(rows).where("repo is not null and commit is not null and journey is not null")
        chosen = ledger_io.selections_of(rows).where("repo is not null and commit is not null")
        self._append(outcomes, "outcomes", batch, "commit")
        self._append(chosen, "selections", batch, "commit")
        self._append(chosen.where("status = 'OK' and base is not null").select("repo", "base", "commit").distinct(), "bases", batch, "base")
        told = outcomes.select("repo", "commit").distinct()
        later = self._read("bases", _BASES, batch, told.withColumnRenamed("commit", "base"), "base").select("repo", "commit")
        touched = work.save(told.unionByName(chosen.select("repo", "commit")).unionByName(later).distinct(), f"touched-{batch}")
        selections = self._read("selections", _SELECTIONS, batch, touched, "commit").drop("batch", "part")
        bases = selections.where("base is not null").select("repo", F.col("base").alias("commit"))
        needed = work.save(touched.unionByName(bases).distinct(), f"needed-{batch}")
        verdicts = self._read("outcomes", _OUTCOMES, batch, needed, "commit").drop("batch", "part")
        judged = ledger.buckets(verdicts, selections).join(touched, ["repo", "commit"], "left_semi")
        n = lambda name: F.count_if(F.col("bucket") == name)
        now = judged.groupBy("repo", "commit").agg(n("caught").alias("caught"), n("missed").alias("missed"), F.max(F.col("judged").cast("long")).alias("judged"))
        now = work.save(now, f"now-{batch}")
        last = F.max(F.struct("batch", "caught", "missed", "judged")).alias("r")
        before = self._read("commits", _COMMITS, batch - 1, touched, "commit").groupBy("repo", "commit").agg(last).select("repo", *(F.col(f"r.{c}").alias(c) for c in ("caught", "missed", "judged")))
        self._append(now, "commits", batch, "commit")
        sums = ("caught", "missed", "judged")
        change = now.select("repo", *sums).unionByName(before.select("repo", *((-F.col(c)).alias(c) for c in sums)))
        held = [int(name.split("-")[1]) for name in work.names("") if name.startswith("totals-")]
        if held := [b for b in held if b < batch]:
            change = change.unionByName(self.spark.read.schema(_TOTALS).parquet(work.at(f"totals-{max(held)}")).select("repo", "caught", "missed", F.col("judged_commits").alias("judged")))
        total = change.groupBy("repo").agg(*(F.sum(c).alias(c) for c in sums))
        scored = F.col("caught") + F.col("missed")
        after = total.select(
            "repo", F.col("judged").alias("judged_commits"), "caught", "missed", F.try_divide(F.col("caught").cast("double"), scored.cast("double")).alias("observed_recall"),
            ((F.col("judged") >= ledger.MIN_JUDGED_COMMITS) & (scored > 0)).alias("ready"),
        )
        saved = work.save(after, f"totals-{batch}")
        for name in ("rows", "touched", "needed", "now"):
            work.drop(f"{name}-{batch}")
        return saved


def keep_totals(spark: SparkSession, path: str, checkpoint: str, sink):
    """Start a query that, per micro-batch, gives ``sink`` the totals over all rows so far.

    The state lies beside the stream's own checkpoint; a batch reads the commits it concerns.
    """
    running = RunningTotals(spark, f"{checkpoint.rstrip('/')}/totals")
    return read_stream(spark, path).writeStream.foreachBatch(lambda rows, batch: sink(running.take(rows, batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
