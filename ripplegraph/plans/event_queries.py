"""Queries over the event ledger, derived from the ``events`` table.

Events of type 'signup' stand for selections, all others for outcomes; the hour of an event
names the commit, the hour before it the base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import ledger
from ripplegraph.session import table

JOURNEYS_TOTAL = 4


def _commit(hours_back: int = 0):
    hour = F.dayofmonth("ts") * 24 + F.hour("ts") - hours_back
    return F.concat(F.md5(F.concat(F.lit("h"), hour.cast("string"))), F.lit("00000000"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    journey = F.when(F.col("event_type") == "view", "J1").when(F.col("event_type") == "click", "J2").when(F.col("event_type") == "purchase", "J3").otherwise("J4")
    verdict = F.when(F.col("value") < 25, "pass").when(F.col("value") < 80, "fail").otherwise("skip")
    return e.select(F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("repo"), _commit().alias("commit"), journey.alias("journey"), verdict.alias("verdict"), F.col("event_id").alias("ts"), F.col("event_id").alias("seq"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    status = F.when(F.col("event_id") % 10 == 0, "BLOCKED").otherwise("OK")
    named = F.concat(F.lit("J"), (F.col("event_id") % 4 + 1).cast("string"))
    return e.select(F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("repo"), _commit().alias("commit"), _commit(1).alias("base"), status.alias("status"), named.alias("journey_id"), F.col("event_id").alias("ts"))


def _buckets(spark, sf_dir):
    return ledger.buckets(outcomes(spark, sf_dir), selections(spark, sf_dir))


def _latest(spark, sf_dir):
    return ledger.latest_outcomes(outcomes(spark, sf_dir)).select("repo", "commit", "journey", "verdict")


def _union(spark, sf_dir):
    a = ledger.answered(selections(spark, sf_dir))
    return a.select("repo", "commit", F.array_join("named", ",").alias("named"), F.array_join("bases", ",").alias("bases"))


def _precision(spark, sf_dir):
    """Selected flows per commit against those that failed there."""
    keys = ["repo", "commit"]
    selected = selections(spark, sf_dir).where("status = 'OK'").select(*keys, F.col("journey_id").alias("journey"))
    failed = ledger.latest_outcomes(outcomes(spark, sf_dir)).where("verdict = 'fail'").select(*keys, "journey")
    return ledger.precision_recall(selected, failed, keys)


def _sizes(spark, sf_dir):
    ok = selections(spark, sf_dir).where("status = 'OK'")
    all_of = table(spark, sf_dir, "events").where("event_type = 'signup' and event_id % 10 > 0").select(F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("repo"), _commit().alias("commit"), (F.col("user_id") % 13 == 0).alias("degraded"))
    return ok.groupBy("repo", "commit").agg(F.count_distinct("journey_id").alias("n")).join(all_of.groupBy("repo", "commit").agg(F.bool_or("degraded").alias("degraded")), ["repo", "commit"])


def _totals(spark, sf_dir):
    return ledger.totals(_buckets(spark, sf_dir)).join(ledger.ledger_counts(outcomes(spark, sf_dir), selections(spark, sf_dir)), "repo")


QUERIES = {
    "ledger_latest_outcome": _latest,
    "ledger_selection_union": _union,
    "ledger_buckets": lambda s, d: _buckets(s, d).groupBy("repo", "bucket").agg(F.count(F.lit(1)).alias("n")),
    "ledger_bucket_rows": lambda s, d: _buckets(s, d).select("repo", "commit", "journey", "bucket", "judged"),
    "ledger_history": lambda s, d: ledger.history(_buckets(s, d)),
    "ledger_totals": _totals,
    "precision_recall": _precision,
    "selectivity_summary": lambda s, d: ledger.selectivity(_sizes(s, d), JOURNEYS_TOTAL),
    "selectivity_histogram": lambda s, d: _sizes(s, d).groupBy("n").agg(F.count(F.lit(1)).alias("selections")),
}

_HOUR = "CAST(EXTRACT(DAY FROM ts) * 24 + EXTRACT(HOUR FROM ts){back} AS BIGINT)"
_SHA = "md5('h' || CAST(" + _HOUR + " AS VARCHAR)) || '00000000'"
_BASE = f"""o AS (SELECT 'r' || CAST(user_id % 3 AS VARCHAR) AS repo, {_SHA.format(back='')} AS "commit", CASE event_type WHEN 'view' THEN 'J1' WHEN 'click' THEN 'J2' WHEN 'purchase' THEN 'J3' ELSE 'J4' END AS journey,
  CASE WHEN value < 25 THEN 'pass' WHEN value < 80 THEN 'fail' ELSE 'skip' END AS verdict, event_id AS ts FROM events WHERE event_type <> 'signup'),
s AS (SELECT 'r' || CAST(user_id % 3 AS VARCHAR) AS repo, {_SHA.format(back='')} AS "commit", {_SHA.format(back=' - 1')} AS base, CASE WHEN event_id % 10 = 0 THEN 'BLOCKED' ELSE 'OK' END AS status, user_id % 13 = 0 AS degraded, event_id AS ts, 'J' || CAST(event_id % 4 + 1 AS VARCHAR) AS journey_id FROM events WHERE event_type = 'signup'),
latest AS (SELECT repo, "commit", journey, arg_max(verdict, ts) AS verdict, max(ts) AS ts FROM o GROUP BY ALL),
ok AS (SELECT * FROM s WHERE status = 'OK'),
b AS (SELECT l.*, EXISTS (SELECT 1 FROM ok WHERE ok.repo = l.repo AND ok."commit" = l."commit") AS asked,
  EXISTS (SELECT 1 FROM ok JOIN latest p ON p.repo = ok.repo AND p."commit" = ok.base WHERE ok.repo = l.repo AND ok."commit" = l."commit" AND p.journey = l.journey AND p.verdict = 'pass') AS baselined,
  EXISTS (SELECT 1 FROM ok WHERE ok.repo = l.repo AND ok."commit" = l."commit" AND ok.journey_id = l.journey) AS named FROM latest l),
bk AS (SELECT *, CASE WHEN verdict = 'pass' THEN 'pass' WHEN verdict <> 'fail' THEN 'skip' WHEN NOT asked THEN 'unasked' WHEN NOT baselined THEN 'unbaselined' WHEN named THEN 'caught' ELSE 'missed' END AS bucket FROM b),
jd AS (SELECT *, bucket IN ('caught', 'missed') OR (bucket = 'pass' AND asked) AS judged FROM bk),
sizes AS (SELECT repo, "commit", count(DISTINCT journey_id) AS n, bool_or(degraded) AS degraded FROM ok GROUP BY ALL)"""

ORACLES = {
    "ledger_latest_outcome": f'WITH {_BASE} SELECT repo, "commit", journey, verdict FROM latest',
    "ledger_selection_union": f"""WITH {_BASE} SELECT repo, "commit", array_to_string(list_sort(list_distinct(list(journey_id))), ',') AS named, array_to_string(list_sort(list_distinct(list(base))), ',') AS bases FROM ok GROUP BY ALL""",
    "ledger_buckets": f"WITH {_BASE} SELECT repo, bucket, count(*) AS n FROM jd GROUP BY ALL",
    "ledger_bucket_rows": f'WITH {_BASE} SELECT repo, "commit", journey, bucket, judged FROM jd',
    "ledger_history": f"""WITH {_BASE} SELECT repo, journey, count(*) AS runs, count_if(bucket = 'pass')::BIGINT AS passes, count_if(verdict = 'fail')::BIGINT AS failures, count_if(bucket = 'caught')::BIGINT AS caught, count_if(bucket = 'missed')::BIGINT AS missed,
  count_if(bucket = 'unasked')::BIGINT AS unasked, count_if(bucket = 'unbaselined')::BIGINT AS unbaselined, max(ts) AS last_ts FROM jd GROUP BY ALL""",
    "ledger_totals": f"""WITH {_BASE}, t AS (SELECT repo, count(DISTINCT CASE WHEN judged THEN "commit" END) AS judged_commits, count_if(bucket = 'caught')::BIGINT AS caught, count_if(bucket = 'missed')::BIGINT AS missed FROM jd GROUP BY repo)
  SELECT *, CASE WHEN caught + missed > 0 THEN CAST(caught AS DOUBLE) / (caught + missed) END AS observed_recall, judged_commits >= 20 AND caught + missed > 0 AS ready, coalesce((SELECT count(*) FROM (SELECT DISTINCT repo, "commit", base, status, ts FROM s) x WHERE x.repo = t.repo), 0) AS selections, coalesce((SELECT count(*) FROM o WHERE o.repo = t.repo), 0) AS outcomes FROM t""",
    "precision_recall": f"""WITH {_BASE}, x AS (SELECT DISTINCT repo, "commit", journey_id AS journey FROM ok), y AS (SELECT repo, "commit", journey FROM latest WHERE verdict = 'fail'),
z AS (SELECT coalesce(x.repo, y.repo) AS repo, coalesce(x."commit", y."commit") AS "commit", count(x.journey) AS n_selected, count(y.journey) AS n_oracle, count(CASE WHEN x.journey IS NOT NULL AND y.journey IS NOT NULL THEN 1 END) AS n_both FROM x FULL JOIN y ON x.repo = y.repo AND x."commit" = y."commit" AND x.journey = y.journey GROUP BY ALL)
SELECT repo, "commit", n_selected, n_oracle, n_selected - n_both AS false_positives, CASE WHEN n_oracle = 0 THEN 1.0 ELSE CAST(n_both AS DOUBLE) / n_oracle END AS recall,
  CASE WHEN n_oracle = 0 THEN CASE WHEN n_selected = 0 THEN 1.0 ELSE 0.0 END WHEN n_selected = 0 THEN 0.0 ELSE CAST(n_both AS DOUBLE) / n_selected END AS precision FROM z""",
    "selectivity_summary": f"WITH {_BASE} SELECT count(*) AS selections, avg(n) AS mean_selected, 1.0 - avg(n) / 4.0 AS avoided, count_if(n <= 2)::BIGINT AS at_most_two, count_if(n = 4)::BIGINT AS all_flows, count_if(n = 3)::BIGINT AS all_but_one, count_if(degraded)::BIGINT AS degraded FROM sizes",
    "selectivity_histogram": f"WITH {_BASE} SELECT n, count(*) AS selections FROM sizes GROUP BY n",
}
