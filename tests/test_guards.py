"""Refusals, guards, labels and checks of settings."""

import json

import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import labels, paths
from ripplegraph.operators import attribution, guards, journeys, rules, scoring
from ripplegraph.sources import validation


def test_globs(spark):
    import re

    fits = lambda g, p: re.match(paths.glob_to_regex(g).replace(r"\z", r"\Z"), p) is not None
    assert fits("**/*.sql", "x.sql") and fits("**/*.sql", "a/b/x.sql") and not fits("*.sql", "a/x.sql")
    assert fits("docs/**", "docs/a/b\nc") and fits("docs/**", "docs/") and not fits("docs/**", "docs")
    assert fits("a/**/b?.py", "a/b1.py") and fits("a/**/b?.py", "a/x/y/b2.py") and not fits("a/**/b?.py", "a/b.py") and fits("a+b/*", "a+b/c")
    globs = ["a/*.py", "a//b", "", "a/", "./a", "../a", "a[1]", "x{y}", "!a", "a\\b", "tests/**.json", "**/a/**", "**/a/**/b/**"]
    df = spark.createDataFrame([(g,) for g in globs], "g string").select("g", paths.glob_is_valid(F.col("g")).alias("ok"))
    assert {r["g"]: r["ok"] for r in df.collect()} == {g: paths.glob_problem(g) is None for g in globs}


def test_trigger_problems_block(spark):
    texts = {1: {"a/*.sql": ["J1"], "b//c": ["J1"], "c.md": [], "d.md": "J1", "e.md": ["J1", "J9"], "f.md": [1]}, 2: ["x"], 3: None, 4: {}}
    rows = [(k, None if v is None else json.dumps(v)) for k, v in texts.items()] + [(5, "{broken"), (1, json.dumps(texts[1]))]
    known = spark.createDataFrame([(1, "J1"), (2, "J9")], "registry_id long, journey_id string")
    got = {(r["subject"], r["message"]) for r in guards.trigger_problems(spark.createDataFrame(rows, "registry_id long, file_triggers string"), known).collect()}
    assert got == {("1:b//c", "glob"), ("1:c.md", "ids"), ("1:d.md", "ids"), ("1:f.md", "ids"), ("1:e.md:J9", "unknown journey"), ("2", "shape"), ("5", "shape")}


def test_an_index_fails_in_three_ways(spark, tmp_path):
    def state(folder):
        with pytest.raises(guards.IndexRefused) as refused:
            guards.open_index(spark, str(folder))
        return refused.value.state

    assert state(tmp_path / "none") == "missing"
    (tmp_path / "other").mkdir()
    assert state(tmp_path / "other") == "missing"
    (tmp_path / "other" / "x.txt").write_text("x")
    assert state(tmp_path / "other") == "not an index"
    good = tmp_path / "good"
    for name, columns in guards.REQUIRED.items():
        spark.range(1).selectExpr(*(f"'x' as {c}" for c in columns)).write.parquet(str(good / f"{name}.parquet"))
    assert set(guards.open_index(spark, str(good))) == set(guards.REQUIRED)
    for name in guards.REQUIRED:
        (tmp_path / "broken").mkdir(exist_ok=True)
        (tmp_path / "broken" / f"{name}.parquet").write_bytes(b"PAR1 and no more")
    assert state(tmp_path / "broken") == "unreadable"
    spark.range(1).selectExpr("'x' as id").write.mode("overwrite").parquet(str(good / "nodes.parquet"))
    assert state(good) == "not an index"
    assert guards.index_findings(spark, [str(tmp_path / "none")]).first()["message"] == "missing"


def test_versions_and_pending(spark):
    kv = spark.createDataFrame([("a", "26"), ("b", "x"), ("c", None)], "key string, value string")
    assert [guards.extraction_version(kv, k).first()[0] for k in "abcd"] == [26, None, None, None]
    assert guards.schema_version(spark.createDataFrame([(8,), (9,), (None,)], "version int")).first()[0] == 9
    refs = spark.createDataFrame([("pending",)] * 3 + [("done",)], "status string")
    told = lambda *a: [(r["severity"], r["message"]) for r in guards.pending_guard(*a).collect()]
    assert told(refs, 2, 9, 9) == [("blocking", "3")] and told(refs, 3, 9, 9) == []
    assert told(None, 2, 9, 9) == [("blocking", "no table")] and told(None, 2, 9, 8) == told(None, 2, None, None) == [("warning", "no table")]
    assert told(refs.toDF("state"), 2, 9, 9) == [("blocking", "no status")]


def test_live_drift(spark):
    entry = [("J1", "f", "app/a.py"), ("J2", "g", "a.py"), ("J3", "f", "zapp/a.py"), ("J4", "f", "bad.py"), ("J5", "f", "page.tsx"), ("J6", "f", None), ("J7", "h", "a.py")]
    entries = spark.createDataFrame(entry, "journey string, name string, file string")
    files = spark.createDataFrame([("src/app/a.py",), ("lib/a.py",), ("x/bad.py",), (None,)], "path string")
    defined = spark.createDataFrame([("src/app/a.py", "f"), ("lib/a.py", "g")], "path string, name string")
    got = guards.live_drift(entries, files, defined, spark.createDataFrame([("x/bad.py",)], "path string"))
    assert {(r["journey"], r["reason"]) for r in got.collect()} == {("J3", "no such file"), ("J4", "cannot parse"), ("J7", "not defined")}
    assert {r["journey"] for r in guards.unchecked_entries(entries).collect()} == {"J5"}
    assert got.where(guards.remedy(F.col("reason")).isNull()).count() == 0


def test_writes_are_refused(spark):
    sha = "a" * 40
    rows = spark.createDataFrame([("J1", "pass", sha), ("J1", "maybe", sha), ("J9", "pass", sha), ("J1", "pass", "--output=x"), ("J1", "pass", "main"), ("J1", None, None)], "journey string, verdict string, commit string")
    known = spark.createDataFrame([("J1",)], "journey string")
    assert sorted(r["reason"] for r in guards.refused_outcomes(rows, known).collect()) == ["no commit", "option for a revision", "unknown journey", "unknown verdict", "unknown verdict"]
    assert [tuple(r) for r in guards.accepted_outcomes(rows, known).collect()] == [("J1", "pass", sha)]


def test_answers_that_are_none(spark):
    one, none = spark.createDataFrame([("x",)], "journey string"), spark.createDataFrame([], "journey string")
    why = lambda *a: {r["reason"]: r["n"] for r in guards.unknown_because(*a).collect()}
    assert why(none, one, none, one) == {"warnings": 1, "unchecked entries": 1} and why(one, one, one, one) == {} and why(none, none, none, none) == {}


def test_what_was_proved(spark):
    chosen = spark.createDataFrame([(f"J{k}",) for k in range(1, 6)], "journey string")
    credit = spark.createDataFrame([("J1", "pass"), ("J2", "fail")], "journey string, verdict string")
    told = spark.createDataFrame([("J1", "pass"), ("J2", "fail"), ("J3", "pass"), ("J4", "skip")], "journey string, verdict string")
    assert {r["journey"]: r["state"] for r in guards.verify_states(chosen, credit, told).collect()} == {"J1": "verified", "J2": "failed", "J3": "incomplete", "J4": "skipped", "J5": "uncovered"}


def test_discovery(spark):
    rows = [(2, "a.json", "t"), (1, "b.draft.json", "t"), (1, "z.json", "t"), (1, "c.json", "u"), (0, "d.txt", "u"), (0, "e.json", None), (0, "f.draft.json", "v"), (1, "g.json", "v")]
    got = journeys.discover(spark.createDataFrame(rows, "folder_rank int, file_name string, target string"))
    assert {r["target"]: r["file_name"] for r in got.collect()} == {"t": "z.json", "u": "c.json", "v": "f.draft.json"}


def test_filters_keep_flows_apart(spark):
    import re

    df = spark.createDataFrame([(["J1", "J.2"],)], "ids array<string>").select(labels.marker_expression(F.col("ids")).alias("m"), labels.grep_expression(F.col("ids")).alias("g"), labels.name_pattern(F.col("ids")).alias("n"))
    row = df.first()
    assert row["m"] == "tg_J1 or tg_J.2"
    assert re.search(row["g"], "x @tg:J1") and not re.search(row["g"], "x @tg:J10") and not re.search(row["g"], "@tg:Jx2 ")
    assert re.search(row["n"], "a @tg:J1 b") and not re.search(row["n"], "x@tg:J1")
    names = spark.createDataFrame([("a @tg:J1",), ("a @tg:J10",), ("a\u00a0@tg:J1 b",), ("a\x1c@tg:J1",)], "n string")
    assert [r[0] for r in names.select(labels.declares(F.col("n"), F.lit("J1"))).collect()] == [True, False, True, False]
    assert [r[0] for r in spark.createDataFrame([(0,), (86400,), (None,)], "t long").select(labels.date_text(F.col("t"))).collect()] == ["never", "1970-01-02", "never"]


def test_tests_meet_flows_by_the_longest_key(spark):
    tests = spark.createDataFrame([("backend/tests/a.py::x",), ("backend/tests/a.py::y",), ("q.py::z",)], "test string")
    mapping = spark.createDataFrame([("tests/a.py", "J1"), ("a.py", "J9"), ("tests/a.py::y", "J2"), ("tests/a.py::y", "J3")], "key string, journey string")
    got = {(r["test"][-1], r["journey"]) for r in attribution.journeys_of_tests(tests, mapping).collect()}
    assert got == {("x", "J1"), ("y", "J2"), ("y", "J3"), ("z", None)}


def test_harness_resolution(spark):
    nodes = spark.createDataFrame([("1", "function", "f", "f", "v/app/dyn.py"), ("2", "function", "f", "f", "myapp/dyn.py")], "id string, kind string, name string, qualified_name string, file_path string")
    pairs = spark.createDataFrame([("app/dyn.py", "K.f"), ("app/dyn.py", "g.<locals>.f"), ("app/dyn.py", "<lambda>"), ("app/dyn.py", "none")], "relpath string, qualname string")
    assert {(r["qualname"], r["id"]) for r in attribution.resolve_harness(pairs, nodes).collect()} == {("K.f", "1"), ("none", None)}


def test_picks(spark):
    scores = spark.createDataFrame([(k, 1, n, f, 2, s) for k, (n, f, s) in enumerate([("a", 9, 2.0), ("b", 9, 3.0), ("entry", 99, 9.0), ("c", 8, 2.0)])], "candidate_id long, index_run long, name string, fan_in long, floor long, score double")
    got = scoring.spot_check_picks(scores, spark.createDataFrame([("entry",)], "name string"), 2, 3)
    assert [(r["position"], r["name"], r["picked"]) for r in got.orderBy("position").collect()] == [(1, "b", True), (2, "a", True), (3, "c", False)]


def test_approval_counts_blind_spots(spark):
    rows = spark.createDataFrame([(1, None, ["x", "y"]), (2, False, None), (3, True, ["z"])], "registry_id long, approved boolean, blind_spots array<string>")
    assert {r["subject"]: r["message"] for r in rules.approval(rows).collect()} == {"1": "approval missing; 2 blind spots", "2": "not approved"}


def test_settings_are_checked(tmp_path):
    assert validation.owned_flag(["-x", "--grep=a"]) == "--grep=a" and validation.owned_flag(["-xg", "s"]) == "-xg" and validation.owned_flag(["--headed"]) is None
    assert validation.name_flag(["-ut", "x"]) == "-ut" and validation.name_flag(["-u", "--run"]) is None and validation.name_flag(["--testNamePattern=x"])
    assert validation.revision_problem("-x") and validation.revision_problem("main") is None
    (tmp_path / "web").mkdir()
    check = lambda **k: validation.end_to_end_problem(str(tmp_path), {"runner": "playwright"} | k)
    assert check(cwd="web") is None and check(cwd="web", config="c.ts") is None
    assert all((check(cwd="/web"), check(cwd=".."), check(cwd="no"), check(), check(cwd="web", config="../../x"), check(cwd="web", config="-x"), validation.end_to_end_problem(str(tmp_path), [])))
    target = lambda p: validation.target_problem(str(p))
    assert target(tmp_path / "t.json") is None and target("/dev/stdout") and target(tmp_path) and target(tmp_path / "no" / "t.json") and target(f"{tmp_path}/x/")
    good, wrong = validation.runner_specs({"a": {"select": "s", "tag": "@{}", "results": "r"}, "b": [], "c": {"select": "s"}, "d": {"select": "s", "tag": "x", "results": "r"}, "e": {"select": 1, "tag": "{}", "results": "r"}})
    assert list(good) == ["a"] and [w[0] for w in wrong] == ["b", "c", "d", "e"] and validation.runner_specs([])[1]
    (tmp_path / "proj" / ".bare").mkdir(parents=True)
    assert validation.project_name(str(tmp_path / "proj" / "main")) == "proj" and validation.project_name(str(tmp_path / "web")) == "web"
    folders = validation.registry_folders(None, str(tmp_path / "web"), ".registry", "/pkg")
    assert len(folders) == 2 and "web" in validation.not_found(str(tmp_path / "web"), folders)
