"""Run reports of three test runners, read as tables. What cannot be told apart is refused."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators.attribution import node_key

# Statuses of the second runner.
SPEC_STATUS = {"passed": "pass", "failed": "fail", "skipped": "skip", "todo": "skip"}


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """``key, status, duration_s, message`` of every testcase; failure goes before error, error
    before skipped. The elements are looked for in the raw text of each case, so that an
    empty element counts as well."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "").alias("value"))
    case = r"(?s)(<testcase\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?</testcase>))"
    cases = text.select(F.explode(F.regexp_extract_all("value", F.lit(case), 1)).alias("x"))
    head = F.regexp_extract("x", r"(?s)\A(<testcase\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)", 1)
    rows = cases.select("x", head.alias("head"))
    has = lambda tag: F.col("x").rlike(rf"<{tag}[\s/>]")
    status = F.when(has("failure"), "fail").when(has("error"), "error").when(has("skipped"), "skip").otherwise("pass")
    classname, name = _attribute(F.col("head"), "classname"), _attribute(F.col("head"), "name")
    key = F.when(F.coalesce(classname, F.lit("")) != "", F.concat_ws(".", classname, name)).otherwise(name)
    tag = F.when(has("failure"), "failure").when(has("error"), "error").when(has("skipped"), "skipped")
    child = F.regexp_extract("x", r"(?s)(<(?:failure|error|skipped)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)", 1)
    message = F.when(tag.isNotNull(), _attribute(child, "message"))
    return rows.select(key.alias("key"), status.alias("status"), _attribute(F.col("head"), "time").try_cast("double").alias("duration_s"), message.alias("message"))


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"\b{name}=(\"[^\"]*\"|'[^']*')", 1)
    text = F.when(raw != "", F.substring(raw, 2, F.length(raw) - 2))
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


SPEC_SCHEMA = "testResults array<struct<name: string, status: string, message: string, assertionResults: array<struct<ancestorTitles: array<string>, title: string, status: string>>>>"


def read_specs(spark: SparkSession, path: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Results ``key, status, test_id, full_name`` of nested spec reports, and the refusals.

    Refused: a report of another shape, a test that never finished, a file that failed
    outside any test, two tests that share an id unless both were skipped.
    """
    report = spark.read.schema(SPEC_SCHEMA).json(path, multiLine=True)
    rel = F.regexp_replace("f.name", r"\A" + root.rstrip("/").replace(".", r"\.") + "/", "")
    files = report.select(F.explode("testResults").alias("f")).select(rel.alias("rel"), F.col("f.status").alias("status"), F.col("f.assertionResults").alias("cases"))
    broken = files.where((F.col("status") == "failed") & ~F.coalesce(F.exists("cases", lambda c: c["status"] == "failed"), F.lit(False)))
    cases = files.select("rel", F.explode("cases").alias("c"))
    titles = F.concat(F.coalesce("c.ancestorTitles", F.array().cast("array<string>")), F.array("c.title"))
    test_id = F.concat_ws("::", "rel", F.array_join(titles, " > "))
    status = F.coalesce(*(F.when(F.col("c.status") == k, v) for k, v in SPEC_STATUS.items()), F.lit("skip"))
    rows = cases.select(test_id.alias("test_id"), F.col("c.status").alias("raw"), status.alias("status"), F.array_join(titles, " ").alias("full_name"))
    rows = rows.withColumn("key", node_key(F.col("test_id")))
    twice = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "skip").alias("told"), F.min("test_id").alias("test_id")).where("n > 1 and told > 0")
    refusal = lambda df, why, what: df.select(F.lit(why).alias("reason"), F.col(what).alias("subject"))
    shape = report.where("testResults is null").select(F.lit("shape").alias("reason"), F.lit(None).cast("string").alias("subject"))
    refused = refusal(broken, "failed outside any test", "rel").unionByName(refusal(rows.where("raw = 'pending'"), "never finished", "test_id")).unionByName(refusal(twice, "shared id", "test_id")).unionByName(shape)
    return rows.groupBy("key").agg(F.min("status").alias("status"), F.min("test_id").alias("test_id"), F.min("full_name").alias("full_name")), refused.distinct()


def flatten_suites(report: dict) -> Iterator[tuple[str, list[str], str]]:
    """(title, tags, status) of every test of suites nested to any depth, without recursion."""
    waiting = list(reversed(report.get("suites") or []))
    while waiting:
        suite = waiting.pop()
        for spec in suite.get("specs") or []:
            for test in spec.get("tests") or []:
                results, status = test.get("results") or [], test.get("status")
                if status == "expected" and (not results or results[-1].get("status") != "passed"):
                    status = "expected-not-passed"
                yield spec.get("title") or "?", list(spec.get("tags") or []), status
        waiting.extend(reversed(suite.get("suites") or []))


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """``title, tags, status`` of end-to-end reports; unreadable files give one row with status null."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                try:
                    rows.extend(flatten_suites(json.loads(text)))
                except (ValueError, AttributeError):
                    rows.append((None, [], None))
            if rows:
                titles, tags, statuses = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(titles, pa.string()), pa.array(tags, pa.list_(pa.string())), pa.array(statuses, pa.string())], names=["title", "tags", "status"])

    return spark.read.text(path, wholetext=True).mapInArrow(walk, "title string, tags array<string>, status string")


def suite_statuses(tests: DataFrame, journeys: DataFrame, prefix: str = "tg:") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statuses per wanted journey, failures that concern none of them, and unknown tags."""
    wanted = journeys.select("journey").distinct()
    ids = F.transform(F.filter("tags", lambda t: t.startswith(prefix)), lambda t: F.substring(t, len(prefix) + 1, F.length(t)))
    rows = tests.where("title is not null").withColumn("n", F.monotonically_increasing_id()).withColumn("ids", ids)
    by_id = rows.select("n", "title", "status", F.explode("ids").alias("journey"))
    hit = by_id.join(wanted, "journey", "left_semi")
    stray = rows.join(hit.select("n").distinct(), "n", "left_anti").where("status in ('unexpected', 'flaky')").select("title", "status")
    unknown = by_id.join(wanted, "journey", "left_anti").select("journey").distinct()
    return hit.select("journey", "title", "status"), stray, unknown


def read_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Trace files with their nested schema, and the files that are refused (``file, reason``): what is
    no JSON object of that shape, or holds no tests, is not taken in part."""
    shape = "root string, backend string, file string, tests map<string, array<array<string>>>, declared map<string, array<string>>, duplicates array<string>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("at"), "value")
    read = raw.select("at", F.from_json("value", f"{shape}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("t"))
    whole = F.col("t").isNotNull() & F.col("t._broken").isNull() & F.col("t.tests").isNotNull()
    return read.where(whole).select("t.*").drop("_broken"), read.where(~whole).select(F.col("at").alias("file"), F.lit("not a trace").alias("reason"))


def merge_parts(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Part files of one run as ``test, pairs``, and the test ids that more than one part or a
    part's own list of duplicates names (a run with any is refused)."""
    tests = parts.select(F.explode("tests").alias("test", "pairs"))
    own = parts.select(F.explode("duplicates").alias("test"))
    shared = tests.groupBy("test").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("test")
    return tests, own.unionByName(shared).distinct()
