from pyspark.sql import functions as F

from ripplegraph.functions import labels, paths
from ripplegraph.operators import attribution as at
from ripplegraph.operators import rules, scoring


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


def test_test_ids_become_keys(spark):
    assert one(spark, "tests/test_x.py::Cls::test_y", at.node_key) == "tests.test_x.Cls.test_y"
    assert one(spark, "tests/test_x.py::test_p[a::b]", at.node_key) == "tests.test_x.test_p[a::b]"
    assert one(spark, "tests/test_x.py", at.node_key) == "tests.test_x"


def test_resolution_states(spark):
    nodes = spark.createDataFrame(
        [("1", "method", "run", "A::run", "src/app/m.py"), ("2", "method", "run", "B::run", "src/app/m.py"), ("3", "function", "solo", "", "src/app/m.py"), ("4", "function", "other", "C::other", "src/app/m.py"), ("5", "function", "solo", "solo", "src/oldapp/m.py")],
        "id string, kind string, name string, qualified_name string, file_path string",
    )
    pairs = spark.createDataFrame([("app/m.py", q) for q in ["A.run", "Z.run", "solo", "D.other", "f.<locals>.<lambda>", "gone", None]] + [("", "x")], "relpath string, qualname string")
    got = {(r["qualname"], r["id"], r["state"]) for r in at.resolve_strict(at.named_frames(pairs), nodes).collect()}
    assert got == {("A.run", "1", "resolved"), ("Z.run", "1", "ambiguous"), ("Z.run", "2", "ambiguous"), ("solo", "3", "resolved"), ("D.other", "4", "ambiguous"), ("gone", None, "unresolved")}


def test_verdict_ladders(spark):
    rows = spark.createDataFrame([("J1", "pass"), ("J1", "fail"), ("J2", "skip"), ("J2", "pass"), ("J3", "skip")], "journey string, verdict string")
    assert {r["journey"]: (r["verdict"], r["tests"]) for r in at.worst_verdict(rows, ["journey"]).collect()} == {"J1": ("fail", 2), "J2": ("pass", 2), "J3": ("skip", 1)}
    declared = spark.createDataFrame([("t1", "J1", "fail"), ("t2", "J1", "pass"), ("t3", "J2", "pass")], "test string, journey string, verdict string")
    reaching = spark.createDataFrame([("t3", "J2")], "test string, journey string")
    assert {r["test"] for r in at.credited(declared, reaching).collect()} == {"t1", "t3"}
    status = [("a", "unexpected"), ("a", "flaky"), ("b", "flaky"), ("b", "expected"), ("c", "expected"), ("c", "skipped"), ("d", "expected-not-passed"), ("e", "expected-not-passed"), ("e", "skipped")]
    judged = at.e2e_judge(spark.createDataFrame(status, "journey string, status string"), spark.createDataFrame([(j,) for j in "abcdef"], "journey string"))
    assert {r["journey"]: r["verdict"] for r in judged.collect()} == {"a": "fail", "b": "incomplete", "c": "pass", "d": "incomplete", "e": "skip", "f": "uncovered"}


def test_edge_support_and_verdicts(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "x", "a")], "id long, source string, target string")
    present = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("c", "t2")], "id string, test string")
    got = {r["id"]: r["support"] for r in at.runtime_support(edges, present).collect()}
    assert got == {1: "observed", 2: "not-observed", 3: "untested"}
    v = spark.createDataFrame([(False, "observed"), (False, "untested"), (True, "observed"), (None, "observed")], "s boolean, u string").select(at.edge_verdict(F.col("s"), F.col("u")).alias("v"))
    assert [r["v"] for r in v.collect()] == ["oracle-gap", "phantom-source-only", None, None]


def test_paths_and_globs(spark):
    assert one(spark, "src/a.py", paths.is_product_path) and not one(spark, "src/a.d.ts", paths.is_product_path) and not one(spark, "tests/a.py", paths.is_product_path)
    assert one(spark, "tests/x.yml", paths.exemption) == "test" and one(spark, "db/authors.sql", paths.exemption) is None and one(spark, "LICENSE", paths.exemption) == "docs"
    assert one(spark, "openapi.spec.yaml", paths.exemption) is None and one(spark, "types/a.d.ts", paths.exemption) == "type declaration"
    assert one(spark, "ci/.env", paths.unmodeled_kind) == ".env" and one(spark, "a/b.sql", paths.unmodeled_kind) == ".sql file"
    match = lambda glob, path: one(spark, path, lambda c: c.rlike(paths.glob_to_regex(glob)))
    assert match("**/*.sql", "a.sql") and match("**/*.sql", "x/y/a.sql") and not match("*.sql", "x/a.sql") and match("db/?.sql", "db/a.sql") and match("db/**", "db/x/y")
    assert paths.glob_problem("a/**b") and paths.glob_problem("a//b") and paths.glob_problem("[x]") and paths.glob_problem("**/a/**/b/**") and not paths.glob_problem("**/*.sql")


def test_labels(spark):
    assert one(spark, "a-b c", labels.slug) == "a_b_c" and one(spark, "--", labels.slug) == "x"
    rows = spark.createDataFrame([("api/v1/users.py", "list"), ("api/v2/users.py", "list"), ("app/x/route.ts", "GET"), ("solo.py", "run")], "file string, name string")
    assert {r["journey_id"] for r in labels.flow_ids(rows).collect()} == {"J_api_v1_users_list", "J_api_v2_users_list", "J_x_GET", "J_solo_run"}
    assert one(spark, "x @tg:J10 y @tg:J1.", lambda c: labels.tagged(c)) == ["J10", "J1"]
    assert one(spark, "f" * 40, labels.short_rev) == "f" * 9 and one(spark, "main", labels.short_rev) == "main"


def test_rules_block_and_warn(spark):
    r = spark.createDataFrame([(1, True, 9, 28), (2, False, 8, None), (3, None, None, 30)], "registry_id long, approved boolean, codegraph_schema_version int, codegraph_extraction_version int")
    found = rules.all_findings(rules.schema_pin(r, 9), rules.extraction_pin(r, 28), rules.approval(r))
    got = {(x["rule"], x["severity"], x["subject"], x["message"]) for x in found.collect()}
    assert got == {("schema", "blocking", "2", "differs"), ("schema", "warning", "3", "unpinned"), ("extraction", "warning", "2", "unpinned"), ("extraction", "warning", "3", "older"), ("approval", "warning", "2", "not approved"), ("approval", "warning", "3", "approval missing")}
    assert rules.blocked(found).first()["status"] == "BLOCKED" and rules.blocked(found.limit(0)).first()["status"] == "OK"
    assert rules.schema_pin(r, None).where("severity = 'blocking'").count() == 2
    refs = spark.createDataFrame([("pending",), ("failed",)], "status string")
    assert rules.pending(refs, 0).count() == 1 and rules.pending(refs, 1).count() == 0


def test_spot_check_floors(spark):
    nodes = spark.createDataFrame([("1", "function", "a", "x/one.py"), ("2", "function", "b", "x/two.py"), ("3", "function", "a", "y/one.py")], "id string, kind string, name string, file_path string")
    callers = spark.createDataFrame([("1", 5)], "target string, callers long")
    rows = [(1, "a", None, 4, None), (1, "a", "two.py", 1, None), (2, "a", "y/one.py", 1, " "), (1, "b", None, 1, None), (1, "gone", None, 1, None), (1, "a", None, 9, "made up edges")]
    checks = spark.createDataFrame(rows, "registry_id long, name string, file string, min_caller_edges long, suspended string")
    got = sorted((r["subject"], r["severity"], r["message"]) for r in rules.spot_checks(checks, nodes, callers).collect())
    assert got == [("1:a", "blocking", "missing"), ("1:a", "warning", "suspended: made up edges"), ("1:b", "blocking", "below floor"), ("1:gone", "blocking", "missing"), ("2:a", "blocking", "below floor")]
    cand = spark.createDataFrame([(1, 1, "tiny", "a.py", 3, 0.0), (2, 1, "calm", "a.py", 20, 1.0), (3, 1, "hot", "a.py", 30, 40.0), (4, 1, "t", "tests/a.py", 50, 0.0)], "candidate_id long, index_run long, name string, file string, fan_in long, caller_churn double")
    rows = {r["name"]: r["score"] for r in scoring.spot_check_scores(cand).collect()}
    assert set(rows) == {"calm", "hot"} and rows["calm"] > rows["hot"]


def test_stride_and_suffix(spark):
    rows = spark.createDataFrame([(k,) for k in range(10)], "k long")
    assert [r[0] for r in scoring.stride_sample(rows, "k", 4).orderBy("k").collect()] == [0, 2, 5, 7]
    assert scoring.stride_sample(rows, "k", 40).count() == 10
    nodes = spark.createDataFrame([("a/b.py",), ("b.py",)], "file_path string")
    got = scoring.suffix_lookup(spark.createDataFrame([("x/a/b.py",), ("y/b.py",), ("z.py",)], "relpath string"), nodes)
    assert {tuple(r) for r in got.collect()} == {("x/a/b.py", "a/b.py"), ("y/b.py", "b.py")}


def test_drift_and_epochs(spark):
    from hashlib import sha256

    files = spark.createDataFrame([("a", sha256(b"x").hexdigest()), ("b", sha256(b"y").hexdigest()), ("c", None)], "path string, content_hash string")
    now = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"z")), ("c", bytearray(b"z"))], "path string, content binary")
    assert [r[0] for r in rules.drift(files, now).collect()] == ["b"]
    e = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000,)], "e long").select(rules.epoch_timestamp(F.col("e")).alias("t")).distinct()
    assert e.count() == 1


def test_inverted_index_holds_every_test(spark):
    traced = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t3", "a"), ("t2", "a"), ("t2", "b")], "test string, id string")
    got = sorted(tuple(r) for r in at.inverted(traced).select("id", "test", "n_tests").collect())
    assert got == [("a", "t1", 3), ("a", "t2", 3), ("a", "t3", 3), ("b", "t2", 1)]
    short = sorted(tuple(r) for r in at.tests_per_node(traced).select("id", "n_tests", "first_test").collect())
    assert short == [("a", 3, "t1"), ("b", 1, "t2")]


def test_support_by_bits_against_sets(spark):
    """A hub that all tests ran, and more tests than a word holds."""
    import random

    rnd = random.Random(6)
    ran = {(f"n{k}", f"t{t}") for k in range(12) for t in range(200) if rnd.random() < 0.02} | {("hub", f"t{t}") for t in range(200)}
    edges = [(k, rnd.choice(["hub", f"n{rnd.randrange(16)}"]), f"n{rnd.randrange(16)}") for k in range(80)]
    of = lambda n: {t for i, t in ran if i == n}
    want = {k: "observed" if of(a) & of(b) else "not-observed" if of(a) else "untested" for k, a, b in edges}
    got = at.runtime_support(spark.createDataFrame(edges, "id long, source string, target string"), spark.createDataFrame(sorted(ran), "id string, test string"))
    assert {r["id"]: r["support"] for r in got.collect()} == want
