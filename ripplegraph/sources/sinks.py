"""Writers and renderers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators import guards
from ripplegraph.sources.ledger_io import append_rows


def outcome_rows(verdicts: DataFrame, repo: str, commit: str, ts: float, note: str | None = None) -> DataFrame:
    """Ledger rows of verdicts (``journey, verdict``)."""
    return verdicts.select(F.lit("outcome").alias("kind"), F.lit(ts).alias("ts"), F.lit(repo).alias("repo"), F.lit(commit).alias("commit"), "journey", "verdict", F.lit(note).cast("string").alias("note"))


def append_verdicts(verdicts: DataFrame, journeys: DataFrame, path: str, repo: str, commit: str, ts: float, note: str) -> tuple[bool, DataFrame]:
    """Record verdicts of traced or declared runs (``journey, verdict``); what may not be written comes
    back with its reason and is left out."""
    rows = verdicts.select("journey", "verdict", F.lit(commit).alias("commit"))
    done = append_rows(outcome_rows(guards.accepted_outcomes(rows, journeys), repo, commit, ts, note), path)
    return done, guards.refused_outcomes(rows, journeys)


def append_e2e_outcomes(judged: DataFrame, path: str, repo: str, commit: str, ts: float) -> bool:
    """Of end-to-end answers only pass and fail are evidence and are written."""
    return append_rows(outcome_rows(judged.where("verdict in ('pass', 'fail')"), repo, commit, ts, "end-to-end run"), path)


def impact_map(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """Map rows per symbol: ``file_path, start_line, name, journeys, confidence, verify``.

    ``index`` is a reverse index (``journey, id, conf``). ``verify`` names the flows whose
    confidence is at or under the low mark.
    """
    from ripplegraph.operators.graph import LOW_CONFIDENCE

    names = lambda rows: F.array_join(F.array_sort(F.transform(rows, lambda r: r["journey"])), ", ")
    grouped = index.groupBy("id").agg(F.collect_list(F.struct("journey", "conf")).alias("rows"), F.max("conf").alias("confidence"))
    shown = grouped.join(nodes.select("id", "name", "file_path", "start_line"), "id")
    low = F.filter("rows", lambda r: r["conf"] <= LOW_CONFIDENCE)
    return shown.select("file_path", "start_line", "name", names(F.col("rows")).alias("journeys"), "confidence", names(low).alias("verify"))


def markdown_lines(rows: DataFrame) -> DataFrame:
    """The map as Markdown, one text per file: ``file_path, text``. Written file by file, so no
    map has to fit on the driver."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.format_string("| %s | %d | %s | %.2f | %s |", cell(F.col("name")), F.coalesce("start_line", F.lit(0)), cell(F.col("journeys")), F.col("confidence"), cell(F.col("verify")))
    listed = rows.select("file_path", F.struct(F.coalesce("start_line", F.lit(0)).alias("at"), "name", line.alias("line")).alias("r"))
    head = "| symbol | line | flows | confidence | verify by hand |\n|---|---|---|---|---|\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
    return listed.groupBy("file_path").agg(F.concat(F.lit("## "), F.first("file_path"), F.lit("\n\n" + head), body, F.lit("\n")).alias("text"))


def stamp(sha: Column, dirty: Column) -> Column:
    """``<sha>`` or ``<sha>-dirty``; null, which refuses the export, where either is unknown."""
    return F.when(sha.isNotNull() & dirty.isNotNull(), F.concat(sha, F.when(dirty, "-dirty").otherwise("")))


def first_of(items: Column, most: int) -> Column:
    """``a, b, c … 4 more``."""
    shown = F.array_join(F.slice(items, 1, most), ", ")
    rest = F.size(items) - most
    return F.when(rest > 0, F.concat(shown, F.lit(" … "), rest.cast("string"), F.lit(" more"))).otherwise(shown)


def exit_code(refused: Column, failed: Column, unverified: Column, crashed: Column) -> Column:
    """2 refused, else 1 if any flow failed, else 3 if any is unverified or the runner itself went
    wrong, else 0: a partial answer never passes for a whole one."""
    return F.when(refused, 2).when(failed > 0, 1).when((unverified > 0) | crashed, 3).otherwise(0)
