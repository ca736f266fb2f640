"""Scoring answers against seeded changes and traced truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seeded_scores(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Per seeded ``site`` the recall and the worst rank of what should have been named.

    ``answers`` has ``site, journey, position`` (from 1), ``expected`` has ``site, journey``. A
    site whose expected flows were not all named has a null worst rank; sites that expect
    nothing are left out.
    """
    met = expected.select("site", "journey").distinct().join(answers.groupBy("site", "journey").agg(F.min("position").alias("position")), ["site", "journey"], "left")
    n = F.count(F.lit(1))
    return met.groupBy("site").agg((F.count("position") / n).alias("recall"), F.when(F.count("position") == n, F.max("position")).alias("worst_rank"), n.alias("expected"))


def seeded_summary(scores: DataFrame) -> DataFrame:
    """One row: sites, least and mean recall, mean worst rank. No sites give nulls, never a 0."""
    return scores.agg(F.count(F.lit(1)).alias("sites"), F.min("recall").alias("min_recall"), F.avg("recall").alias("mean_recall"), F.avg("worst_rank").alias("mean_worst_rank"))


def adjudicate(disagreements: DataFrame, rulings: DataFrame) -> DataFrame:
    """Disagreements (``site, journey, base``) that a ruling excuses, and whether it is stale.

    A ruling (``site, journey, base_sha``) holds only for the revision it was made on: its id
    must begin with the one given. ``state`` is 'open', 'excused' or 'stale'.
    """
    by = rulings.select("site", "journey", "base_sha").distinct()
    met = disagreements.join(by, ["site", "journey"], "left")
    holds = F.bool_or(F.coalesce(F.col("base").startswith(F.col("base_sha")), F.lit(False)))
    return met.groupBy("site", "journey", "base").agg(holds.alias("holds"), F.count("base_sha").alias("n")).select("site", "journey", "base", F.when(F.col("holds"), "excused").when(F.col("n") > 0, "stale").otherwise("open").alias("state"))


def ground_truth(journeys: DataFrame, traced: DataFrame, footprints: DataFrame) -> DataFrame:
    """Per journey: symbols that ran, that the footprint has, both and either side alone.

    ``traced`` and ``footprints`` are long (``journey, id``). A journey without any trace is
    'no trace' and scores nothing.
    """
    t = traced.select("journey", "id", F.lit(1).alias("t")).distinct()
    f = footprints.select("journey", "id", F.lit(1).alias("f")).distinct()
    counts = t.join(f, ["journey", "id"], "full").groupBy("journey").agg(F.count("t").alias("traced"), F.count("f").alias("footprint"), F.count(F.col("t") + F.col("f")).alias("both"))
    rows = journeys.select("journey").distinct().join(counts, "journey", "left")
    scored = F.coalesce(F.col("traced"), F.lit(0)) > 0
    side = lambda a: F.when(scored, F.col(a) - F.col("both"))
    return rows.select("journey", F.when(scored, "scored").otherwise("no trace").alias("state"), F.coalesce("traced", F.lit(0)).cast("long").alias("traced"), F.coalesce("footprint", F.lit(0)).cast("long").alias("footprint"), side("traced").alias("traced_only"), side("footprint").alias("static_only"))


def unit_against_real(unit: DataFrame, real: DataFrame) -> DataFrame:
    """Per journey the symbols that unit tests and a real run (``journey, id``) reach: both, either alone."""
    u = unit.select("journey", "id", F.lit(1).alias("u")).distinct()
    r = real.select("journey", "id", F.lit(1).alias("r")).distinct()
    shared = F.count(F.col("u") + F.col("r"))
    return u.join(r, ["journey", "id"], "full").groupBy("journey").agg(F.count("u").alias("unit"), F.count("r").alias("real"), shared.alias("shared"), (F.count("u") - shared).alias("unit_only"), (F.count("r") - shared).alias("real_only"))


def renumbered(chosen: DataFrame, order: list[str]) -> DataFrame:
    """Chosen journeys as J1..Jn in the given order. The chosen set is an arm of a few flows."""
    from pyspark.sql import Window as W

    return chosen.withColumn("new_id", F.concat(F.lit("J"), F.row_number().over(W.orderBy(*order)).cast("string")))
