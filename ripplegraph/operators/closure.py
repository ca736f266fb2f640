"""Widest-path closures over a cyclic relation: a semi-naive loop of DataFrame rounds.

All sources are walked in one loop, keyed by ``source_key``. The state holds the best
``(conf, cap)`` per key and id, and lies in buckets by both, so that it is never shuffled: a round
joins only what improved in the last one with the relation, which lies in buckets too, takes the
best candidate per key and id, and merges it with the state bucket by bucket. A dominated row is dropped at once: should it tie further on, the tying edge
is no wider than it, and both rows would take that edge's token. Ties of confidence go to
the lexicographically larger cap.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.bitclosure import bit_closure, levels_of, slot_of
from ripplegraph.operators.skew import hot_keys, salt_of, salts_of
from ripplegraph.session import Workspace, default_parallelism, save_observed

KEY = ["source_key", "id"]


def widest_closure(seeds: DataFrame, relation: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Everything reachable from ``seeds`` (``source_key, id``): ``source_key, id, conf, cap``.

    Defined cases: no seeds give no rows; seeds that the relation does not know reach
    themselves; null ids are ignored; repeated seeds and edges count once; cycles end as only
    strict improvements go on. Rounds go on until nothing is fresh; a closure that needs more
    than ``max_rounds``, where given, is an error.
    """
    spark = seeds.sparkSession
    work, buckets = Workspace(spark, "closure"), default_parallelism(spark)
    start = seeds.where("id is not null").select(*KEY).distinct()
    best = F.struct(F.lit(1.0).alias("conf"), F.lit("").alias("cap"))
    state = work.save_bucketed(start.select(*KEY, best.alias("best"), F.lit(True).alias("fresh")), "state_0", KEY, buckets)
    if state.isEmpty():
        work.forget()
        return _result(work.plain("state_0", state))
    hot = hot_keys(relation.select("frm"))
    salt = salt_of(F.col("frm"), F.col("nxt"), hot, buckets)
    spread = relation.where("frm is not null and nxt is not null").select(slot_of(F.col("frm"), salt).alias("slot"), "nxt", "ec", "ecap")
    spread = work.save_bucketed(spread, "relation", "slot", buckets)
    conf, cap, ec = F.col("best.conf"), F.col("best.cap"), F.col("ec")
    step = F.struct(F.least(conf, ec).alias("conf"), F.when(ec.isNull() | (ec > conf), cap).otherwise(F.col("ecap")).alias("cap"))
    fresh = F.col("found").isNotNull() & (F.col("best").isNull() | (F.col("found") > F.col("best")))
    try:
        for k in count(1):
            if max_rounds is not None and k > max_rounds:
                raise RuntimeError(f"rows are still fresh after {max_rounds} rounds")
            ahead = state.where("fresh").select("source_key", "best", "id", F.explode(salts_of(F.col("id"), hot, buckets)).alias("salt"))
            ahead = ahead.select("source_key", "best", slot_of(F.col("id"), F.col("salt")).alias("slot"))
            found = ahead.join(spread, "slot").select("source_key", F.col("nxt").alias("id"), step.alias("step")).groupBy(*KEY).agg(F.max("step").alias("found"))
            after = state.select(*KEY, "best").join(found, KEY, "full").select(*KEY, F.greatest("best", "found").alias("best"), fresh.alias("fresh"))
            state, n_fresh = save_observed(work, after, f"state_{k}", "fresh", (KEY, buckets))
            if k > 1:
                work.drop(f"state_{k - 2}")
            if not n_fresh:
                return _result(work.plain(f"state_{k}", state))
    finally:
        work.forget()


def _result(state: DataFrame) -> DataFrame:
    return state.select("source_key", "id", F.col("best.conf").alias("conf"), F.col("best.cap").alias("cap"))


def confidences(seeds: DataFrame, relation: DataFrame) -> DataFrame:
    """Widest confidence without its cap: ``source_key, id, conf``. Sources go as bits, in groups of
    confidence levels; a relation of very many distinct confidences goes through the general loop."""
    levels = levels_of(relation)
    return bit_closure(seeds, relation, levels) if levels else widest_closure(seeds, relation).select("source_key", "id", "conf")


def reachable(seeds: DataFrame, relation: DataFrame) -> DataFrame:
    """Plain reachability: ``source_key, id``."""
    plain = relation.select("frm", "nxt", F.lit(None).cast("double").alias("ec"))
    return bit_closure(seeds, plain, [1.0]).select("source_key", "id")
