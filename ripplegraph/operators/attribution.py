"""Test traces against flows and verdicts: resolution, coverage, credit, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.bitclosure import positions
from ripplegraph.operators.journeys import suffix_match
from ripplegraph.operators.reach import Reach
from ripplegraph.session import Workspace

# Statuses of a run, the verdict each stands for, and the rank of verdicts.
STATUS_VERDICT = {"pass": "pass", "fail": "fail", "skip": "skip", "error": "fail"}
VERDICT_RANK = {"fail": 3, "pass": 2, "skip": 1}


def verdict_of(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in STATUS_VERDICT.items():
        out = F.when(status == name, verdict).otherwise(out)
    return out


def verdict_rank(verdict: Column) -> Column:
    out = F.lit(0)
    for name, rank in VERDICT_RANK.items():
        out = F.when(verdict == name, rank).otherwise(out)
    return out


def node_key(nodeid: Column) -> Column:
    """Dotted key of a test id: the ``[params]`` tail is cut off first, then ``.py`` goes and
    slashes and ``::`` become dots."""
    head = F.substring_index(nodeid, "[", 1)
    tail = F.substring(nodeid, F.length(head) + 1, F.length(nodeid))
    path = F.substring_index(head, "::", 1)
    rest = F.substring(head, F.length(path) + 3, F.length(head))
    parts = F.filter(F.split(rest, "::"), lambda p: p != "")
    return F.concat(F.array_join(F.concat(F.array(F.translate(F.regexp_replace(path, r"\.py\z", ""), "/", ".")), parts), "."), tail)


def qualified(qualname: Column) -> Column:
    """``a.<locals>.b`` as the index writes it: ``a::b``."""
    return F.array_join(F.filter(F.split(qualname, r"\."), lambda p: p != "<locals>"), "::")


def last_segment(qualname: Column) -> Column:
    return F.element_at(F.split(qualname, r"\."), -1)


def named_frames(pairs: DataFrame) -> DataFrame:
    """Distinct traced forms that have a name; ``<lambda>`` and the like drop out."""
    forms = pairs.where("relpath <> '' and qualname <> ''").select("relpath", "qualname").distinct()
    return forms.withColumn("name", last_segment(F.col("qualname"))).where(~F.col("name").contains("<"))


def _hits(forms: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the same name whose path ends with the traced one. Meets on name and file name."""
    base = lambda c: F.substring_index(c, "/", -1)
    known = nodes.where("name is not null and file_path is not null and kind is distinct from 'file'").select("id", "name", "qualified_name", "file_path", base(F.col("file_path")).alias("base"))
    asked = forms.withColumn("base", base(F.col("relpath")))
    return asked.join(known, ["name", "base"]).where(suffix_match(F.col("file_path"), F.col("relpath"))).drop("base")


def resolve_strict(forms: DataFrame, nodes: DataFrame) -> DataFrame:
    """``relpath, qualname, id, state`` with state 'resolved', 'ambiguous' or 'unresolved'.

    An exact qualified name wins; else a single hit counts if its qualified name cannot
    contradict the trace (null, empty or the bare name); all other hits are ambiguous.
    """
    form = ["relpath", "qualname"]
    hit = _hits(forms, nodes).withColumn("exact", F.coalesce(F.col("qualified_name") == qualified(F.col("qualname")), F.lit(False)))
    count = hit.groupBy(*form).agg(F.count(F.lit(1)).alias("hits"), F.count_if("exact").alias("exacts"))
    met = hit.join(count, form)
    bare = F.coalesce(F.col("qualified_name").isin("") | (F.col("qualified_name") == F.col("name")), F.lit(True))
    state = F.when(F.col("exacts") > 0, F.when(F.col("exact"), "resolved")).when((F.col("hits") == 1) & bare, "resolved").otherwise("ambiguous")
    known = met.select(*form, "id", state.alias("state")).where("state is not null")
    missing = forms.select(*form).join(count.select(*form), form, "left_anti").select(*form, F.lit(None).cast("string").alias("id"), F.lit("unresolved").alias("state"))
    return known.unionByName(missing)


def resolve_loose(forms: DataFrame, nodes: DataFrame) -> DataFrame:
    """All hits by name and path, qualified names aside: ``relpath, qualname, id, ambiguous``."""
    hit = _hits(forms, nodes)
    count = hit.groupBy("relpath", "qualname").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return hit.select("relpath", "qualname", "id").join(count, ["relpath", "qualname"])


def resolve_harness(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Traced pairs as the harness reads them: ``relpath, qualname, id``, null where nothing answers.

    Frames inside functions (``<locals>``) drop out, as no change is ever seeded on them; every node of
    the name in that file counts.
    """
    forms = named_frames(pairs).where(~F.col("qualname").contains("<locals>"))
    hit = _hits(forms, nodes).select("relpath", "qualname", "id")
    return forms.select("relpath", "qualname").join(hit, ["relpath", "qualname"], "left")


def journeys_of_tests(tests: DataFrame, mapping: DataFrame) -> DataFrame:
    """Flows of each test id by a hand-written map (``key, journey``): ``test, key, journey``.

    The id itself goes first, with ever more leading folders taken off, then its file the same way: a
    run's ids begin at the folder it was started in. A test without a key has null in both.
    """
    asked = tests.select("test").where("test is not null").distinct()
    whole, file = F.split("test", "/"), F.split(F.substring_index("test", "::", 1), "/")
    cuts = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tried = asked.select("test", F.posexplode(F.concat(cuts(whole), cuts(file))).alias("at", "key"))
    known = mapping.select("key").distinct()
    best = tried.join(known, "key").groupBy("test").agg(F.min(F.struct("at", "key"))["key"].alias("key"))
    return asked.join(best, "test", "left").join(mapping.select("key", "journey").distinct(), "key", "left").select("test", "key", "journey")


def inverted(traced: DataFrame) -> DataFrame:
    """Node to all its tests: ``id, test, n_tests``, a row per distinct pair, as a hot node's
    tests need not fit into one array."""
    pairs = Workspace(traced.sparkSession, "inverted").save(traced.select("id", "test").distinct(), "pairs")
    return pairs.join(pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_tests")), "id").select("id", "test", "n_tests")


def tests_per_node(traced: DataFrame) -> DataFrame:
    """The inverted index in short: ``id, n_tests, first_test``; the tests are in ``inverted``."""
    return traced.select("id", "test").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_tests"), F.min("test").alias("first_test"))


def orphans(traced: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Both sides that found no partner: traces without a verdict, verdicts without a trace."""
    t = traced.select("key").distinct().withColumn("t", F.lit(True))
    v = verdicts.select("key").distinct().withColumn("v", F.lit(True))
    side = F.when(F.col("v").isNull(), "no-verdict").when(F.col("t").isNull(), "no-trace")
    return t.join(v, "key", "full").select("key", side.alias("side")).where("side is not null")


def worst_verdict(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The verdict of highest rank (fail, pass, skip) and the number of tests behind it."""
    best = F.max(F.struct(verdict_rank(F.col("verdict")).alias("rank"), "verdict"))
    return rows.where("verdict is not null").groupBy(*keys).agg(best.alias("best"), F.count(F.lit(1)).alias("tests")).select(*keys, F.col("best.verdict").alias("verdict"), "tests")


def credited(declared: DataFrame, reaching: DataFrame) -> DataFrame:
    """Declared runs that count: a fail always, a pass or skip only if its trace reaches an entry.

    ``declared`` has ``test, journey, verdict``, ``reaching`` the (test, journey) pairs whose
    trace touches an entry.
    """
    met = declared.join(reaching.select("test", "journey", F.lit(True).alias("reaches")).distinct(), ["test", "journey"], "left")
    return met.where("verdict = 'fail' or reaches").drop("reaches")


def e2e_judge(statuses: DataFrame, journeys: DataFrame) -> DataFrame:
    """Per journey one answer from the statuses of its end-to-end runs (``journey, status``).

    None: uncovered; any unexpected: fail; any flaky: incomplete; any expected: pass; only
    runs that were expected not to pass, without a skip: incomplete; else skipped.
    """
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    seen = journeys.select("journey").distinct().join(statuses.where("status is not null"), "journey", "left").groupBy("journey").agg(
        F.count("status").alias("runs"), has("unexpected").alias("u"), has("flaky").alias("f"), has("expected").alias("e"), has("expected-not-passed").alias("n"), has("skipped").alias("s")
    )
    verdict = F.when(F.col("runs") == 0, "uncovered").when(F.col("u"), "fail").when(F.col("f"), "incomplete").when(F.col("e"), "pass").when(F.col("n") & ~F.col("s"), "incomplete").otherwise("skip")
    reason = F.when(F.col("runs") == 0, None).when(F.col("u"), None).when(F.col("f"), "flaky").when(F.col("e"), None).when(F.col("n") & ~F.col("s"), "expected-fail").otherwise("skipped")
    return seen.select("journey", verdict.alias("verdict"), reason.alias("reason"), "runs")


def static_misses(traced: DataFrame, footprints: DataFrame | Reach) -> DataFrame:
    """What a covering test ran and the static graph does not reach: ``journey, id``."""
    ran = traced.select("journey", "id").distinct()
    if isinstance(footprints, Reach):
        return footprints.without(ran.withColumnRenamed("journey", "source_key")).select(F.col("source_key").alias("journey"), "id")
    return ran.join(footprints.select(F.col("source_key").alias("journey"), "id"), ["journey", "id"], "left_anti")


def test_words(present: DataFrame) -> DataFrame:
    """The tests of each node as bits: ``id, word, bits``, one row per 64 tests that hold one of its own."""
    ran = Workspace(present.sparkSession, "ran").save(present.where("test is not null").select("id", "test").distinct(), "ran")
    placed = ran.join(positions(ran.select("test").distinct(), "test"), "test")
    bit = F.expr("shiftleft(1L, cast(position % 64 as int))")
    return placed.groupBy("id", F.floor(F.col("position") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def runtime_support(edges: DataFrame, present: DataFrame) -> DataFrame:
    """``id, support``: 'observed' if one test ran both ends, 'not-observed' if only the source
    was ever run, else 'untested'.

    Tests go as bits, 64 to a row, so that a source that many tests ran and that has many edges
    meets each of them with few rows; edges between the same two ends are asked once.
    """
    words = Workspace(edges.sparkSession, "words").save(test_words(present), "words")
    ends = edges.select("source", "target").distinct()
    both = ends.join(words.select(F.col("id").alias("source"), "word", "bits"), "source").join(words.select(F.col("id").alias("target"), "word", F.col("bits").alias("other")), ["target", "word"])
    seen = both.where(F.col("bits").bitwiseAND(F.col("other")) != 0).select("source", "target", F.lit(True).alias("observed")).distinct()
    tested = words.select(F.col("id").alias("source"), F.lit(True).alias("tested")).distinct()
    marked = edges.join(seen, ["source", "target"], "left").join(tested, "source", "left")
    return marked.select("id", F.when(F.col("observed"), "observed").when(F.col("tested"), "not-observed").otherwise("untested").alias("support"))


def edge_verdict(source_supported: Column, support: Column) -> Column:
    """What becomes of an edge: null where the source supports it or nothing is known."""
    judged = F.when(support == "observed", "oracle-gap").when(support == "not-observed", "phantom-confirmed").otherwise("phantom-source-only")
    return F.when(source_supported.isNull() | source_supported, None).otherwise(judged)
