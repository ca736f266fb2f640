"""The general data problems: defined results for nulls, ties, repeats, empty tables, odd columns."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import dense_counts, nested, orphans, skew

T = lambda m, d=1: dt.datetime(2025, m, d)
NODE = "id string, indexed_at timestamp, removed_at timestamp, seen_at string, edge_id string, key string"
EDGE = "id long, source string, target string, seen_at timestamp, index_run long, kind string, salt string, live string"


def nodes_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], NODE)


def edges_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "calls", "x", "x") for r in rows], EDGE)


def brute(nodes, edges):
    out = set()
    for e, source, target, at in edges:
        for side, key in (("source", source), ("target", target)):
            if key and not any(i == key and a is not None and at is not None and a <= at and (r is None or r > at) for i, a, r in nodes):
                out.add((e, side))
    return out


def test_orphans_edge_cases(spark):
    nodes = [("a", T(1), None), ("a", T(1), None), ("b", T(3), T(5)), ("b", T(7), None), ("c", None, None), ("d", T(6), T(6)), ("A", T(1), None)]
    edges = [(1, "a", "b", T(3)), (1, "a", "b", T(3)), (2, "a", "b", T(5)), (3, "b", "b", T(7)), (4, None, "", T(2)), (5, "c", "d", T(8)), (6, "a", "ghost", None), (7, "A", "a ", T(2))]
    got = {tuple(r) for r in orphans.find_orphans(spark, nodes_of(spark, nodes), edges_of(spark, edges), months=1).collect()}
    assert got == brute(nodes, edges)


@pytest.mark.parametrize("months", [1, 3, 24])
def test_orphans_any_period(spark, months):
    rnd = random.Random(months)
    nodes = [(f"n{rnd.randrange(12)}", T(a := rnd.randrange(1, 12), rnd.randrange(1, 28)), rnd.choice([None, T(a + 1)])) for _ in range(40)]
    edges = [(k, f"n{rnd.randrange(16)}", rnd.choice(["hot", f"n{rnd.randrange(16)}"]), T(rnd.randrange(1, 13), rnd.randrange(1, 28))) for k in range(400)]
    got = orphans.find_orphans(spark, nodes_of(spark, nodes), edges_of(spark, edges), months=months)
    assert {tuple(r) for r in got.collect()} == brute(nodes, edges)
    assert got.count() == len(brute(nodes, edges))


def test_orphans_hot_key_is_salted(spark):
    edges = [(k, "hot", f"n{k}", T(1 + k % 12)) for k in range(3000)]
    nodes = [("hot", T(4), T(8)), *((f"n{k}", T(1), None) for k in range(0, 3000, 2))]
    arrived = orphans.arrivals(edges_of(spark, edges), None)
    assert "hot" in skew.hot_keys(orphans.references(arrived).select("key"), fraction=1.0)
    tracker = orphans.OrphanTracker(spark, salts=5, hot=["hot"])
    tracker.step(arrived, orphans.parent_events(nodes_of(spark, nodes)))
    assert {(r["edge_id"], r["side"]) for r in tracker.current().collect()} == brute(nodes, edges)


def test_orphans_wait_resolve_and_reopen(spark):
    nodes, edges = nodes_of(spark, [("p", T(3), T(5)), ("p", T(9), None)]), edges_of(spark, [(1, "p", None, T(1))])
    rows: list = []
    orphans.track(spark, nodes, edges_of(spark, [(1, "p", None, T(1)), (2, "p", None, T(12))]), months=1, snapshots=rows)
    flat = [x for part in rows for x in part]
    assert [(r[3], r[4], r[5]) for r in flat if r[0] in (T(2), T(4), T(6), T(10))] == [(1, 0, 0), (0, 1, 0), (1, 0, 1), (0, 1, 0)]
    assert orphans.find_orphans(spark, nodes, edges).count() == 1


def test_late_references_of_closed_periods_come_out(spark):
    edges = [(1, "ghost", "ghost", T(1)), (2, "p", None, T(2)), (3, "p", None, T(5))]
    nodes = nodes_of(spark, [("p", T(4), None)])
    late = edges_of(spark, edges).withColumn("loaded_at", F.expr("case id when 1 then timestamp'2025-09-03' when 2 then timestamp'2025-03-09' end"))
    rows: list = []
    tracker = orphans.track(spark, nodes, late, months=1, snapshots=rows)
    assert {(r["edge_id"], r["side"]) for r in tracker.current().collect()} == {(1, "source"), (1, "target"), (2, "source")}
    # when the second one came in, no period had been closed yet
    assert {(r["edge_id"], r["side"]) for r in tracker.late().collect()} == {(1, "source"), (1, "target")}
    assert [r[:4] for part in rows for r in part][0] == (T(4), "source", 1, 1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_order_of_arrival_equals_the_replay(spark, seed):
    """References and parents' events in shuffled batches, some twice; the tracker is reopened in between."""
    rnd = random.Random(seed)
    nodes = [(f"n{rnd.randrange(8)}", T(a := rnd.randrange(1, 11), rnd.randrange(1, 28)), rnd.choice([None, T(a + 1, rnd.randrange(1, 28))])) for _ in range(25)]
    edges = [(k, f"n{rnd.randrange(10)}", rnd.choice(["hot", f"n{rnd.randrange(10)}", None]), rnd.choice([None, *(T(m) for m in range(1, 13))])) for k in range(120)]
    rnd.shuffle(edges)
    arrived = orphans.arrivals(edges_of(spark, edges), None)
    events = [tuple(r) for r in orphans.parent_events(nodes_of(spark, nodes)).collect()]
    rnd.shuffle(events)
    path = orphans.OrphanTracker(spark, hot=["hot"]).work.path
    for at in range(4):
        some = spark.createDataFrame(events[at * len(events) // 4 : (at + 1) * len(events) // 4] + events[:2], "key string, ts timestamp_ntz, delta int, other timestamp_ntz")
        mine = arrived.where(F.col("edge_id") % 4 == at).unionByName(arrived.where("edge_id < 3"))
        tracker = orphans.OrphanTracker(spark, path, salts=3, hot=["hot"])
        assert tracker.version == at
        counts = tracker.step(mine, some)
    want = brute(nodes, edges)
    got = orphans.OrphanTracker(spark, path)
    assert {(r["edge_id"], r["side"]) for r in got.current().collect()} == want
    assert got.current().count() == len(want)
    live = {n for n, a, r in nodes if r is None}
    by_side = lambda s, keep: sum(1 for e in edges for side, key in (("source", e[1]), ("target", e[2])) if side == s and (e[0], side) in want and keep(key))
    assert [c[:3] for c in counts] == [(s, by_side(s, lambda k: True), by_side(s, lambda k: k not in live)) for s in orphans.SIDES]


def test_a_batch_that_was_cut_short_is_written_over(spark):
    tracker = orphans.OrphanTracker(spark)
    arrived = orphans.arrivals(edges_of(spark, [(1, "a", "b", T(1))]), None)
    none = orphans.parent_events(nodes_of(spark, []))
    tracker.step(arrived, none)
    for left in ("refs/slot=1", "index/slot=1", "orphans/version=2", "waiting-2"):  # what a lost run may leave
        arrived.drop("slot").write.parquet(tracker.work.at(left))
    again = orphans.OrphanTracker(spark, tracker.work.path)
    assert again.version == 1 and again.current().count() == 2
    again.step(arrived.where("false"), orphans.parent_events(nodes_of(spark, [("a", T(2), None)])))
    assert [tuple(r) for r in again.waiting().collect()] == [("b", 0, 1)] and again.current().count() == 2


def test_orphans_empty(spark):
    some = edges_of(spark, [(1, "a", "b", T(1))])
    assert orphans.find_orphans(spark, nodes_of(spark, []), some).count() == 2
    assert orphans.find_orphans(spark, nodes_of(spark, [("a", T(1), None)]), edges_of(spark, [])).count() == 0


def test_dense_counts_match_a_plain_count(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(50), rnd.choice(["hot"] * 6 + ["a", "b", None, "é"]), rnd.randrange(3)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, run long").repartition(5)
    want: dict = {}
    for i, k, run in set(rows):
        want[(run, k)] = want.get((run, k), 0) + 1
    got = dense_counts.dense_counts(df, ["run", "k"], ["id"], "n", blocks=3)
    assert {(r["run"], r["k"]): r["n"] for r in got.collect()} == want
    assert dense_counts.dense_counts(df.limit(0), ["k"], ["id"]).count() == 0


def test_dense_counts_flush(spark, monkeypatch):
    monkeypatch.setattr(dense_counts, "FLUSH_KEYS", 10)
    monkeypatch.setattr(dense_counts, "CHUNK", 4)
    df = spark.createDataFrame([(k, f"k{k % 30}") for k in range(300)], "id long, k string")
    assert {r["n"] for r in dense_counts.dense_counts(df, ["k"], ["id"]).collect()} == {10}


def test_wrong_fan_in(spark):
    edges = spark.createDataFrame([(1, "t", 1, "calls"), (1, "t", 1, "calls"), (2, "t", 1, "extends"), (3, "t", 1, "imports"), (4, None, 1, "calls"), (5, "t", None, "calls")], "id long, target string, index_run long, kind string")
    rows = [(1, 1, "t", 2), (2, 1, "t", 3), (3, 1, "gone", 0), (4, 1, "gone", 1), (5, 1, "t", None), (6, None, "t", 0), (6, None, "t", 0), (7, 1, None, 4), (2, 1, "t", 3)]
    candidates = spark.createDataFrame(rows, "candidate_id long, index_run long, node_id string, fan_in long").selectExpr("*", "'x' as target", "'y' as kind")
    assert sorted(r[0] for r in dense_counts.wrong_fan_in(edges, candidates).collect()) == [2, 4, 7]
    assert dense_counts.wrong_fan_in(edges.limit(0), candidates.limit(0)).count() == 0


TRACE = "trace_id long, tests map<string, array<array<string>>>, declared map<string, array<string>>, field string, payload string"
REG = "registry_id long, journeys string, target string"


def test_nested_children(spark):
    tests = {"t1": [["a.py", "f"], None, ["b.py"], [], ["c.py", None], ["a.py", "f"]], "t2": [], "t3": None}
    traces = spark.createDataFrame([(1, tests, {"t1": ["J1", None]}, "x", "y"), (1, tests, {"t1": ["J1", None]}, "x", "z"), (2, None, {}, "", ""), (None, tests, None, "", "")], TRACE)
    texts = {
        10: json.dumps({"J1": {"name": "n", "entries": [{"name": "f", "file": "a"}, "g", None, {"file": "x"}, {"name": 3}, 7]}, "J.2": {"entries": {"name": "h"}}, "J3": {}, "J4": None, "J5": {"entries": "solo"}, "J6": {"entries": None}}),
        11: json.dumps([{"id": "A", "entries": []}, {"entries": ["q"]}, None]),
        12: "", 13: '{"J1": ', 14: "null", 15: "3", 16: '{"J1": NaN}', 17: None, 18: '{"J\\ud800": {"entries": ["\\ud83d\\ude00"]}}',
    }
    registries = spark.createDataFrame([(k, v, "t") for k, v in texts.items()], REG)
    got = sorted(tuple(r) for r in nested.nested_children(spark, traces, registries).collect())
    t, d, j = "tgtrace.tests", "tgtrace.declared", "signedintake.journeys"
    want = [(t, 1, "t1", 0, "f"), (t, 1, "t1", 1, ""), (t, 1, "t1", 2, ""), (t, 1, "t1", 3, ""), (t, 1, "t1", 4, ""), (t, 1, "t1", 5, "f"), (t, 1, "t2", -1, ""), (t, 1, "t3", -1, "")]
    want += [(d, 1, "t1", 0, "J1"), (d, 1, "t1", 1, "")]
    want += [(j, 10, "J1", 0, "f"), (j, 10, "J1", 1, "g"), (j, 10, "J1", 2, ""), (j, 10, "J1", 3, ""), (j, 10, "J1", 4, ""), (j, 10, "J1", 5, ""), (j, 10, "J.2", 0, "h"), (j, 10, "J3", -1, ""), (j, 10, "J4", -1, ""), (j, 10, "J5", 0, "solo"), (j, 10, "J6", -1, "")]
    want += [(j, 11, "A", -1, ""), (j, 11, "", 0, "q"), (j, 11, "", -1, ""), (j, 18, "J?", 0, "😀")]
    assert got == sorted(want)


def test_repeated_and_deep_json_is_read(spark):
    deep = "[" * 50_000 + "]" * 50_000
    twice = '{"a": {"entries": ["x"], "entries": ["w"]}, "a": {"entries": ["y"]}, "b": null}'
    texts = [(1, twice), (2, f'{{"a": {{"entries": ["x", {{"name": "y", "more": {deep}}}]}}, "a": 1}}'), (3, deep[:-1]), (4, f'[{{"id": "a", "entries": {deep}}}]')]
    traces = spark.createDataFrame([], "trace_id long, tests map<string, array<array<string>>>, declared map<string, array<string>>")
    got = nested.nested_children(spark, traces, spark.createDataFrame(texts, "registry_id long, journeys string"))
    rows = sorted(tuple(r) for r in got.select("record_id", "parent_key", "child_no", "child_key").collect())
    assert rows == [(1, "a", 0, "x"), (1, "a", 0, "y"), (1, "b", -1, ""), (2, "a", -1, ""), (2, "a", 0, "x"), (2, "a", 1, "y"), (4, "a", 0, "")]


def test_deep_parser_agrees_with_the_other():
    good = ['{"a": [1, {"b": "c\\u00e4,]"}, []], "d": {}, "e": -1.5e3}', " [ ] ", '"x"', "null", '[[{"a": {"b": [true, false, null]}}]]']
    assert all(nested.parse_deep(t) == json.loads(t) for t in good)
    for bad in ["[1,]", "[1 2]", '{"a" 1}', "{1: 2}", '{"a": 1,}', "[NaN]", "[", "[1}", "[] []", "", "[,]", '{"a":}']:
        with pytest.raises(ValueError):
            nested.parse_deep(bad)


def test_flat_tables_keep_links(spark):
    traces = spark.createDataFrame([(1, {"t": [["a.py", "f"], ["b.py", "g"]]}, {"t": ["J1"]}, "", "")], TRACE)
    registries = spark.createDataFrame([(9, json.dumps({"J1": {"name": "n", "route": "GET /", "entries": [{"name": "f", "file": "a.py"}]}}), "t")], REG)
    flat = nested.FlatTables(spark, traces, registries)
    assert flat.table("test").first()["n_symbols"] == 2
    assert [(r["parent_key"], r["child_no"], r["relpath"], r["qualname"]) for r in flat.table("traced_symbol").orderBy("child_no").collect()] == [("t", 0, "a.py", "f"), ("t", 1, "b.py", "g")]
    (journey,) = flat.table("journey").collect()
    assert (journey["name"], journey["route"], journey["n_entries"]) == ("n", ["GET /"], 1)
    (entry,) = flat.table("entry").collect()
    assert entry["parent"] == journey["key"] and entry["key"] == journey["key"] + "/0"
    assert {r["parent"] for r in flat.table("traced_symbol").collect()} == {r["key"] for r in flat.table("test").collect()}
    assert (entry["parent_key"], entry["name"], entry["file"]) == ("J1", "f", "a.py")
    assert nested.nested_children(spark, traces.limit(0), registries.limit(0)).count() == 0
