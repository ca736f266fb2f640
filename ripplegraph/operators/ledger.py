"""The event ledger: what was selected, what came out, and whether the selection was right.

All operators work per repository on two long tables:

* outcomes ``repo, commit, journey, verdict, ts, seq``
* selections ``repo, commit, base, status, journey_id, ts`` (one row per named flow; a
  selection that named none has a null ``journey_id``)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: judged commits a history needs before its recall may rank anything.
MIN_JUDGED_COMMITS = 20


def is_sha(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{40}\z")


def selection_keys(selections: DataFrame) -> DataFrame:
    """Adds ``join_commit`` and ``join_base``: the resolved id if it is one, else the given text if that is one."""
    pick = lambda resolved, given: F.coalesce(F.when(is_sha(F.col(resolved)), F.col(resolved)), F.when(is_sha(F.col(given)), F.col(given)))
    return selections.withColumns({"join_commit": pick("commit", "head"), "join_base": pick("base_commit", "base")})


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """The last verdict per repo, commit and journey; of equal times the later row wins."""
    rows = outcomes.where("commit is not null and journey is not null")
    last = F.max(F.struct(F.coalesce("ts", F.lit(0)), "seq", "verdict"))
    return rows.groupBy("repo", "commit", "journey").agg(last.alias("last"), F.max("ts").alias("ts")).select("repo", "commit", "journey", F.col("last.verdict").alias("verdict"), "ts")


def answered(selections: DataFrame) -> DataFrame:
    """Selections that answered, as one row per repo and commit: ``named``, ``bases``."""
    ok = selections.where("status = 'OK' and commit is not null")
    return ok.groupBy("repo", "commit").agg(F.array_sort(F.collect_set("journey_id")).alias("named"), F.array_sort(F.collect_set("base")).alias("bases"))


def buckets(outcomes: DataFrame, selections: DataFrame) -> DataFrame:
    """Every latest outcome with its bucket and whether its commit counts as judged.

    A failure is first unasked (no selection answered for its commit), then unbaselined (the
    flow passed at none of the bases), and only then caught or missed. All joins are on
    (repo, commit) or (repo, base, journey); no list is built.
    """
    latest = latest_outcomes(outcomes)
    ok = selections.where("status = 'OK' and commit is not null")
    asked = ok.select("repo", "commit", F.lit(True).alias("asked")).distinct()
    named = ok.where("journey_id is not null").select("repo", "commit", F.col("journey_id").alias("journey"), F.lit(True).alias("named")).distinct()
    passed = latest.where("verdict = 'pass'").select("repo", F.col("commit").alias("base"), "journey")
    bases = ok.where("base is not null").select("repo", "commit", "base").distinct()
    baselined = bases.join(passed, ["repo", "base"]).select("repo", "commit", "journey", F.lit(True).alias("baselined")).distinct()
    rows = latest.join(asked, ["repo", "commit"], "left").join(named, ["repo", "commit", "journey"], "left").join(baselined, ["repo", "commit", "journey"], "left")
    bucket = (
        F.when(F.col("verdict") == "pass", "pass")
        .when(F.coalesce(F.col("verdict") != "fail", F.lit(True)), "skip")
        .when(F.col("asked").isNull(), "unasked")
        .when(F.col("baselined").isNull(), "unbaselined")
        .when(F.col("named"), "caught")
        .otherwise("missed")
    )
    out = rows.select("repo", "commit", "journey", "ts", bucket.alias("bucket"), F.col("asked").isNotNull().alias("asked"))
    judged = F.col("bucket").isin("caught", "missed") | ((F.col("bucket") == "pass") & F.col("asked"))
    return out.withColumn("judged", judged)


def history(rows: DataFrame) -> DataFrame:
    """Per repo and journey: runs, passes, failures and their buckets, and the last time."""
    n = lambda *names: F.count_if(F.col("bucket").isin(*names))
    return rows.groupBy("repo", "journey").agg(
        F.count(F.lit(1)).alias("runs"), n("pass").alias("passes"), n("unasked", "unbaselined", "caught", "missed").alias("failures"),
        n("caught").alias("caught"), n("missed").alias("missed"), n("unasked").alias("unasked"), n("unbaselined").alias("unbaselined"), F.max("ts").alias("last_ts"),
    )


def ledger_counts(outcomes: DataFrame, selections: DataFrame) -> DataFrame:
    """Per repo the rows of either kind as recorded: ``repo, selections, outcomes``.

    A selection has a row per flow it named; those of one time and commit are one selection.
    """
    s = selections.select("repo", "commit", "base", "status", "ts").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("selections"))
    o = outcomes.groupBy("repo").agg(F.count(F.lit(1)).alias("outcomes"))
    zero = F.lit(0).cast("long")
    return s.join(o, "repo", "full").select("repo", F.coalesce("selections", zero).alias("selections"), F.coalesce("outcomes", zero).alias("outcomes"))


def export_payload(summary: DataFrame, detail: DataFrame) -> DataFrame:
    """What a summary says in words and as evidence: ``repo, content, evidence`` (JSON).

    ``summary`` is ``totals`` with ``ledger_counts``, ``detail`` the history per flow.
    """
    judged = F.col("caught") + F.col("missed")
    told = F.when(judged > 0, F.format_string("Observed recall %.2f over %d judged failures (%d missed in silence).", "observed_recall", judged, "missed")).otherwise(F.lit("No failure was judged yet, so recall is not known."))
    content = F.concat(F.format_string("Ledger of %s: %d selections, %d outcomes, %d commits with both. ", "repo", "selections", "outcomes", "judged_commits"), told)
    flows = detail.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("journey", "runs", "passes", "failures", "caught", "missed", "unasked", "unbaselined"))).alias("per_journey"))
    met = summary.join(flows, "repo", "left")
    evidence = F.to_json(F.struct("repo", "selections", "outcomes", "judged_commits", "caught", "missed", "observed_recall", "per_journey"))
    return met.select("repo", content.alias("content"), evidence.alias("evidence"))


def totals(rows: DataFrame) -> DataFrame:
    """Per repo: judged commits, caught, missed, observed recall and whether it may rank."""
    n = lambda name: F.count_if(F.col("bucket") == name)
    out = rows.groupBy("repo").agg(F.count_distinct(F.when(F.col("judged"), F.col("commit"))).alias("judged_commits"), n("caught").alias("caught"), n("missed").alias("missed"))
    judged = F.col("caught") + F.col("missed")
    return out.select("*", F.try_divide(F.col("caught").cast("double"), judged.cast("double")).alias("observed_recall"), ((F.col("judged_commits") >= MIN_JUDGED_COMMITS) & (judged > 0)).alias("ready"))


def precision_recall(selected: DataFrame, oracle: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the precision and recall of a selected set against an oracle set.

    Both inputs are long (``keys``, ``journey``). With an empty oracle recall is 1 and
    precision is 1 only if nothing was selected; a selection of nothing has precision 1 only
    where the oracle is empty too, else 0.
    """
    s = selected.select(*keys, "journey", F.lit(1).alias("s")).distinct()
    o = oracle.select(*keys, "journey", F.lit(1).alias("o")).distinct()
    both = s.join(o, [*keys, "journey"], "full").groupBy(*keys).agg(F.count("s").alias("n_selected"), F.count("o").alias("n_oracle"), F.count(F.col("s") + F.col("o")).alias("n_both"))
    recall = F.when(F.col("n_oracle") == 0, 1.0).otherwise(F.col("n_both") / F.nullif("n_oracle", F.lit(0)))
    precision = F.when(F.col("n_oracle") == 0, F.when(F.col("n_selected") == 0, 1.0).otherwise(0.0)).when(F.col("n_selected") == 0, 0.0).otherwise(F.col("n_both") / F.nullif("n_selected", F.lit(0)))
    return both.select(*keys, "n_selected", "n_oracle", (F.col("n_selected") - F.col("n_both")).alias("false_positives"), recall.alias("recall"), precision.alias("precision"))


def selectivity(sizes: DataFrame, total: int) -> DataFrame:
    """Summary of selection sizes (``n``) out of ``total`` flows, and of how many were ``degraded``."""
    return sizes.agg(
        F.count_if("degraded").alias("degraded"),
        F.count(F.lit(1)).alias("selections"), F.avg("n").alias("mean_selected"), (F.lit(1.0) - F.avg("n") / F.lit(float(total))).alias("avoided"),
        F.count_if(F.col("n") <= 2).alias("at_most_two"), F.count_if(F.col("n") == total).alias("all_flows"), F.count_if(F.col("n") == total - 1).alias("all_but_one"),
    )
