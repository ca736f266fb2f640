"""The entry points end to end on the small graph."""

import json

import pytest

from ripplegraph import api
from test_graph import EDGES, NODES, make_links, make_nodes

FLOWS = [("t", "J1", "t:J1", "quote", "quote.py"), ("t", "J2", "t:J2", "checkout", None), ("t", "J3", "t:J3", "stock", "shop/stock.py")]
ENTRY = "target string, journey_id string, journey string, name string, file string"
FINDING = "rule string, severity string, subject string, message string"


@pytest.fixture(scope="module")
def world(spark):
    entries = spark.createDataFrame(FLOWS, ENTRY)
    return make_nodes(spark, NODES), make_links(spark, EDGES), entries.select("journey"), entries


def diff_of(*files):
    return "".join(f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n@@ -1 +{line} @@\n" for p, line in files)


def run(spark, world, text, triggers=(), findings=()):
    return api.select(*world, spark.createDataFrame([(1, text)], "diff_id long, text string"), spark.createDataFrame(list(triggers), "registry_id long, glob string, journey_id string"), spark.createDataFrame(list(findings), FINDING))


def test_select_ranks_what_a_change_reaches(spark, world):
    s = run(spark, world, diff_of(("shop/money.py", 4), ("README.md", 1)))
    assert sorted((r["journey"], r["confidence"]) for r in s.flows.collect()) == [("t:J1", 0.8), ("t:J2", 0.8)] and s.status.first()["status"] == "OK"


def test_select_falls_back_and_triggers(spark, world):
    s = run(spark, world, diff_of(("shop/new.py", 1)))
    assert {r["reason"] for r in s.flows.collect()} == {"unmapped-files"} and s.flows.count() == 3
    s = run(spark, world, diff_of(("db/x.sql", 1)), [(1, "**/*.sql", "J3")])
    assert [(r["journey"], r["reason"], r["triggered_by"]) for r in s.flows.collect()] == [("t:J3", "file-trigger", "**/*.sql")]
    assert run(spark, world, diff_of(("db/x.sql", 1))).flows.where("reason = 'unmodeled-paths'").count() == 3


def test_select_refuses_and_admits_not_knowing(spark, world):
    s = run(spark, world, diff_of(("shop/price.py", 2)), findings=[("schema", "blocking", "1", "differs")])
    assert s.status.first()["status"] == "BLOCKED" and s.flows.count() == 0
    s = run(spark, world, diff_of(("shop/jobs.py", 2)), findings=[("approval", "warning", "1", "not approved")])
    assert s.status.first()["status"] == "UNKNOWN" and s.flows.count() == 0
    assert run(spark, world, "").status.first()["status"] == "OK"


def test_map_agrees_with_select(spark, world):
    nodes, edges, _, entries = world
    rows = {r["name"]: r for r in api.export_map(nodes, edges, entries).collect()}
    assert rows["tax"]["journeys"] == "t:J1, t:J2" and rows["stock"]["journeys"] == "t:J3" and "nightly" not in rows


def test_summary(spark, tmp_path):
    lines = [{"kind": "outcome", "ts": n, "repo": "r", "commit": c * 40, "journey": "J1", "verdict": v} for n, (c, v) in enumerate([("a", "pass"), ("b", "fail")])]
    lines.append({"kind": "selection", "ts": 3, "repo": "r", "commit": "b" * 40, "base_commit": "a" * 40, "status": "OK", "journey_ids": []})
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, lines)))
    totals, history = api.summarize(spark, str(tmp_path))
    assert totals.first()["missed"] == 1 and history.first()["runs"] == 2


def test_propose(spark, world):
    sources = spark.createDataFrame([("shop/cart.py", "@r.get('/a')\n@r.post('/b')\ndef checkout(): ...\n@r.get('/c')\ndef ghost(): ..."), ("src/app/x/page.tsx", "export default function Home() {}")], "path string, content string")
    got = {r["journey_id"]: (r["title"], r["id"]) for r in api.propose(sources, world[0]).collect()}
    assert got == {"J_cart_checkout": ("GET /a + POST /b", "checkout"), "J_cart_ghost": ("GET /c", None), "J_x_Home": ("PAGE /x", None)}


def test_verify_and_reconcile(spark, world):
    nodes, edges, flows, entries = world
    declared = spark.createDataFrame([("t1", "t:J1", "pass"), ("t2", "t:J2", "pass"), ("t3", "t:J3", "fail")], "test string, journey string, verdict string")
    traced = spark.createDataFrame([("t1", "shop/quote.py", "quote"), ("t1", "shop/stock.py", "stock"), ("t1", "shop/price.py", "net")], "test string, relpath string, qualname string")
    assert {r["journey"]: r["verdict"] for r in api.verify(flows, declared, traced, entries, nodes).collect()} == {"t:J1": "pass", "t:J2": "uncovered", "t:J3": "fail"}
    ids = {(r["source"], r["target"]): r["id"] for r in edges.collect()}
    support = spark.createDataFrame([(ids["net", "tax"], "unsupported"), (ids["quote", "net"], "unsupported"), (ids["gross", "tax"], "supported")], "id long, support string")
    misses, verdicts, lost = api.reconcile(nodes, edges, entries, declared, traced, support)
    assert {tuple(r) for r in misses.collect()} == {("t:J1", "stock")}
    assert {r["id"]: r["verdict"] for r in verdicts.collect()} == {ids["net", "tax"]: "phantom-confirmed", ids["quote", "net"]: "oracle-gap"}
    assert lost.count() == 0


def test_draft(spark, world):
    nodes, edges, _, _ = world
    sources = spark.createDataFrame([("shop/cart.py", "@r.get('/a')\ndef checkout(): ...\n@r.get('/c')\ndef ghost(): ..."), ("shop/quote.py", "@r.post('/q')\ndef quote(): ..."), ("bad.py", "def ("), ("web/list.vue", "x"), ("web/list.test.ts", "x")], "path string, content string")
    d = api.draft(sources, nodes, edges)
    assert [(r["name"], r["fan_in"]) for r in d.flows.collect()] == [("checkout", 0), ("quote", 1)]
    assert [(r["name"], r["reason"]) for r in d.unresolved.collect()] == [("ghost", "no node in the index")]
    assert {(r["path"], r["what"][:3]) for r in d.blind_spots.collect()} == {("bad.py", "doe"), ("web/list.vue", "no ")}


def test_experiments(spark, world):
    nodes, edges, _, entries = world
    assert {r["arm"] for r in api.couple(nodes, edges, entries, 1).collect()} == {"coupled", "apart"}
    scores, summary = api.accuracy(spark.createDataFrame([("s", "J1", 2)], "site string, journey string, position int"), spark.createDataFrame([("s", "J1")], "site string, journey string"))
    assert summary.first()["mean_worst_rank"] == 2 and scores.first()["recall"] == 1
    traced = "journey string, relpath string, qualname string"
    unit = spark.createDataFrame([("J1", "shop/price.py", "net"), ("J1", "shop/quote.py", "quote")], traced)
    (row,) = api.unit_vs_journey(unit, spark.createDataFrame([("J1", "shop/quote.py", "quote"), ("J1", "shop/money.py", "f.<locals>.tax")], traced), nodes).collect()
    assert (row["unit"], row["real"], row["shared"]) == (2, 1, 1)


def test_exit_codes_of_a_push(spark, world):
    ok = run(spark, world, diff_of(("shop/price.py", 2)))
    told = lambda *v: spark.createDataFrame([(f"J{k}", x) for k, x in enumerate(v)], "journey string, verdict string")
    assert [api.check_push(ok), api.check_push(ok, told("pass")), api.check_push(ok, told("pass", "fail", "uncovered")), api.check_push(ok, told("pass", "skip"))] == [0, 0, 1, 3]
    assert api.check_push(run(spark, world, "", findings=[("schema", "blocking", "1", "differs")])) == 2
