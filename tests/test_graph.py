"""Closures, confidence, seeds and ranking on small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import bitclosure, closure, graph, impact, journeys
from ripplegraph.session import SharedTables

# A shop: a tax rule, two prices built on it, a quote, a cart that imports the quote as a whole file,
# a hook that only a heuristic found, and a cycle beside it all.
NODES = [
    ("tax", "function", "tax", "shop/money.py", 3, 9),
    ("net", "function", "net", "shop/price.py", 2, 8),
    ("gross", "function", "gross", "shop/price.py", 11, 17),
    ("quote", "function", "quote", "shop/quote.py", 4, 30),
    ("hook", "function", "hook", "shop/hooks.py", 1, 6),
    ("file:shop/cart.py", "file", "cart.py", "shop/cart.py", 1, 80),
    ("checkout", "method", "checkout", "shop/cart.py", 20, 40),
    ("empty_cart", "method", "empty_cart", "shop/cart.py", 42, 50),
    ("stock", "function", "stock", "shop/stock.py", 1, 7),
    ("restock", "function", "restock", "shop/stock.py", 10, 18),
    ("nightly", "function", "nightly", "shop/jobs.py", 1, 20),
]
EDGES = [
    ("net", "tax", "calls", '{"confidence": 0.55}', None),
    ("gross", "tax", "calls", '{"confidence": 0.8}', None),
    ("gross", "net", "calls", '{"confidence": 0.95}', None),
    ("quote", "gross", "calls", '{"confidence": 0.85}', None),
    ("quote", "net", "calls", None, None),
    ("hook", "tax", "calls", '{"confidence": 0.8}', "heuristic"),
    ("file:shop/cart.py", "quote", "imports", None, None),
    ("file:shop/cart.py", "checkout", "contains", None, None),
    ("nightly", "restock", "calls", None, None),
    ("restock", "nightly", "references", '{"confidence": 0.7}', None),
]


def make_nodes(spark, rows):
    return spark.createDataFrame([(i, k, n, n, p, a, b) for i, k, n, p, a, b in rows], "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int")


def make_links(spark, rows):
    raw = spark.createDataFrame([(k, s, t, kind, m, p, 1) for k, (s, t, kind, m, p) in enumerate(rows)], "id long, source string, target string, kind string, metadata string, provenance string, line int")
    return graph.links(raw)


@pytest.fixture(scope="module")
def core(spark):
    return make_nodes(spark, NODES), make_links(spark, EDGES)


def walk(spark, core, *ids):
    nodes, edges = core
    seeds = spark.createDataFrame([("s", i) for i in ids], "source_key string, id string")
    return {r["id"]: (r["conf"], r["cap"]) for r in closure.widest_closure(seeds, graph.impact_relation(edges, nodes)).collect()}


def test_closure_expands_through_files(spark, core):
    assert walk(spark, core, "quote") == {"quote": (1.0, ""), "file:shop/cart.py": (0.9, ""), "checkout": (0.9, "")}
    assert walk(spark, core, "stock") == {"stock": (1.0, "")}


def test_weakest_link_and_its_reason(spark, core):
    """The quote is reached by three ways; the widest counts, and what narrows it is told."""
    reached = walk(spark, core, "tax")
    assert {k: v[0] for k, v in reached.items()} == {"tax": 1.0, "net": 0.55, "gross": 0.8, "quote": 0.8, "hook": 0.3, "file:shop/cart.py": 0.8, "checkout": 0.8}
    assert reached["net"][1] == "metadata" and reached["hook"][1] == "heuristic" and reached["quote"][1] == ""


def test_cycles_end(spark, core):
    assert {k: v[0] for k, v in walk(spark, core, "nightly").items()} == {"nightly": 1.0, "restock": 0.7}


def test_the_last_version_of_a_row_counts_whole(spark):
    raw = spark.createDataFrame(
        [("a", "Function ", "old", None, "z.py", 9, 20, "2025-01-01"), ("a", "method", "new", "K::new", "a.py", 1, 3, "2025-03-01"), ("a", "method", "new", "K::new", "a.py", 1, 3, "2025-03-01")],
        "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, indexed_at string",
    ).selectExpr("*", "cast(null as timestamp) as removed_at")
    assert [tuple(r) for r in graph.symbols(raw).collect()] == [("a", "method", "new", "K::new", "a.py", 1, 3)]
    rows = [(1, "x", "y", "calls", None, None, 4, "2025-01-01"), (1, "x", "z", "calls", None, None, 2, "2025-02-01"), (2, "", "z", "calls", None, None, 2, "2025-02-01")]
    edges = spark.createDataFrame(rows, "id long, source string, target string, kind string, metadata string, provenance string, line int, loaded_at string")
    assert [(r["source"], r["target"], r["line"]) for r in graph.links(edges).collect()] == [("x", "z", 2)]


def test_no_seeds(spark, core):
    empty = spark.createDataFrame([], "source_key string, id string")
    assert closure.widest_closure(empty, graph.impact_relation(core[1], core[0])).count() == 0
    assert closure.reachable(empty, graph.dependency_relation(core[1])).count() == 0


def test_name_collisions_bound_confidence(spark):
    nodes = make_nodes(spark, [(i, "function", n, f"{i}.py", 1, 2) for i, n in [("a", "run"), ("b", "run"), ("c", "solo"), ("x", "fx"), ("y", "fy"), ("z", "fz")]])
    exact = '{"confidence":0.9,"resolvedBy":"exact-match"}'
    edges = make_links(spark, [("x", "a", "calls", exact, None), ("y", "a", "calls", '{"confidence":0.9,"resolvedBy":"import"}', None), ("z", "c", "calls", exact, None), ("x", "c", "calls", '{"confidence":1.0}', None), ("y", "c", "calls", '{"confidence":', None)])
    rows = {(r["source"], r["target"]): (r["conf"], r["cap"]) for r in graph.weighted(edges, nodes).collect()}
    assert rows == {("x", "a"): (0.5, "name-collision"), ("y", "a"): (0.9, ""), ("z", "c"): (0.9, ""), ("x", "c"): (1.0, "name-collision"), ("y", "c"): (0.9, "")}


def test_footprint_is_dual_to_closure(spark):
    names = ["h1", "h2", "svc", "m", "cfg", "util", "orphan"]
    files = {"h1": "api.py", "h2": "api.py", "svc": "svc.py", "m": "svc.py", "cfg": "cfg.py", "util": "util.py", "orphan": "o.py"}
    rows = [(n, "function", n, files[n], 1, 2) for n in names] + [(f"file:{p}", "file", p, p, 1, 9) for p in set(files.values())]
    nodes = make_nodes(spark, rows)
    pairs = [("h1", "svc"), ("svc", "m"), ("h2", "util"), ("m", "svc")]
    edges = make_links(spark, [(a, b, "calls", None, None) for a, b in pairs] + [("file:svc.py", "cfg", "imports", None, None)] + [(f"file:{files[n]}", n, "contains", None, None) for n in names])
    every = nodes.select(F.col("id").alias("source_key"), "id")
    foot = {(r["source_key"], r["id"]) for r in closure.reachable(every, graph.dependency_relation(edges)).collect()}
    back = {(r["id"], r["source_key"]) for r in closure.widest_closure(every, graph.impact_relation(edges, nodes)).collect()}
    assert foot == back
    assert ("h1", "cfg") in foot and {x for e, x in foot if e == "orphan"} == {"orphan", "file:o.py"}


@pytest.mark.parametrize("seed", [1, 2])
def test_bits_agree_with_the_general_loop(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}", rnd.choice([None, 0.3, 0.5, 0.9]), "") for _ in range(90)]
    relation = spark.createDataFrame(edges, "frm string, nxt string, ec double, ecap string")
    seeds = spark.createDataFrame([(f"k{k}", f"n{rnd.randrange(45)}") for k in range(150) for _ in range(2)], "source_key string, id string")
    wide = {(r["source_key"], r["id"]): r["conf"] for r in closure.widest_closure(seeds, relation).collect()}
    bits = {(r["source_key"], r["id"]): r["conf"] for r in bitclosure.bit_closure(seeds, relation, bitclosure.levels_of(relation)).collect()}
    assert wide == bits


@pytest.mark.parametrize("levels", [3, 12])
def test_hot_nodes_and_many_levels(spark, monkeypatch, levels):
    """A hub whose edges are spread by salt, and more confidences than a row holds."""
    rnd = random.Random(levels)
    some = [round(0.05 * (k + 1), 2) for k in range(levels)]
    edges = [("hub", f"n{k}", rnd.choice(some), "") for k in range(60)] + [(f"n{rnd.randrange(60)}", rnd.choice(["hub", f"n{rnd.randrange(60)}"]), rnd.choice(some), "") for _ in range(60)]
    relation = spark.createDataFrame(edges, "frm string, nxt string, ec double, ecap string")
    seeds = spark.createDataFrame([(f"k{k}", f"n{rnd.randrange(60)}") for k in range(20)], "source_key string, id string")
    rows = lambda df: {(r["source_key"], r["id"]): r["conf"] for r in df.collect()}
    want = rows(closure.widest_closure(seeds, relation))
    for module in (closure, bitclosure):
        monkeypatch.setattr(module, "hot_keys", lambda keys: ["hub"])
    assert rows(closure.widest_closure(seeds, relation)) == want
    assert rows(bitclosure.bit_closure(seeds, relation, bitclosure.levels_of(relation))) == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("closure_", "bits_"))]


def test_a_closure_is_whole_or_an_error(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 1.0, "") for k in range(5)], "frm string, nxt string, ec double, ecap string")
    seeds = spark.createDataFrame([("s", "n0")], "source_key string, id string")
    for close in (lambda *most: closure.widest_closure(seeds, chain, *most), lambda *most: bitclosure.bit_closure(seeds, chain, [1.0], *most)):
        assert close().count() == 6
        with pytest.raises(RuntimeError, match="after 3 rounds"):
            close(3)


def test_seeds_of_hunks_and_unmapped(spark, core):
    nodes, _ = core
    hunks = spark.createDataFrame([("shop/cart.py", 22, 23), ("shop/cart.py", 22, 23), ("gone.py", 1, 5), ("shop/jobs.py", None, 3)], "file_path string, lo int, hi int")
    seeds = impact.seeds_of_hunks(hunks, nodes)
    assert [tuple(r) for r in seeds.collect()] == [("shop/cart.py", "checkout")]
    assert {r[0] for r in impact.unmapped(hunks, seeds).collect()} == {"gone.py", "shop/jobs.py"}
    drifted = spark.createDataFrame([("shop/cart.py",), ("else.py",)], "path string")
    assert {r[0] for r in impact.lost_files(hunks, seeds, drifted).collect()} == {"gone.py", "shop/jobs.py", "shop/cart.py"}
    assert [tuple(r) for r in impact.file_nodes(hunks, nodes).collect()] == [("shop/cart.py", "file:shop/cart.py")]


def test_files_of_closure_refuses_unknown_ids(spark, core):
    reached = spark.createDataFrame([("a", "stock"), ("b", "stock"), ("b", "ghost")], "source_key string, id string")
    got = {r["source_key"]: r["files"] for r in impact.files_of_closure(reached, core[0]).collect()}
    assert got == {"a": "shop/stock.py", "b": None}


def test_ranking_reports_the_best_entry(spark, core):
    nodes, edges = core
    seeds = spark.createDataFrame([("s", "tax")], "source_key string, id string")
    reached = closure.widest_closure(seeds, graph.impact_relation(edges, nodes))
    entries = spark.createDataFrame([("JW", "net"), ("JT", "quote"), ("JN", None)], "journey string, id string")
    rows = {r["journey"]: r for r in impact.rank_journeys(reached, entries, graph.caller_counts(edges)).collect()}
    assert set(rows) == {"JW", "JT"}
    assert rows["JW"]["verify"] and rows["JW"]["weak_reason"] == "metadata" and rows["JW"]["rank"] == 2
    assert not rows["JT"]["verify"] and rows["JT"]["confidence"] == 0.8
    ordered = impact.in_order(spark.createDataFrame([("J10", 1), ("J2", 1), ("J1", 5)], "journey string, rank long"))
    assert [(r["position"], r["journey"]) for r in ordered.orderBy("position").collect()] == [(1, "J1"), (2, "J2"), (3, "J10")]


def test_fallback_names_all_other_flows(spark):
    rows = spark.createDataFrame([("J1", 3, 1, 0.9, False, None, None)], "journey string, rank long, entries_hit long, confidence double, verify boolean, reason string, triggered_by string")
    flows = spark.createDataFrame([("J1",), ("J2",)], "journey string")
    none, one = spark.createDataFrame([], "file_path string"), spark.createDataFrame([("x.py",)], "file_path string")
    assert impact.with_fallback(rows, flows, none, none).count() == 1
    got = {r["journey"]: r["reason"] for r in impact.with_fallback(rows, flows, one, none).collect()}
    assert got == {"J1": None, "J2": "unmapped-files"}


def test_natural_order(spark):
    df = spark.createDataFrame([(j,) for j in ["J10", "J2", "J1", "J13", "J9", "B1", "A10", "A2"]], "journey_id string")
    assert [r[0] for r in df.orderBy(*journeys.natural_key(F.col("journey_id"))).collect()] == ["A2", "A10", "B1", "J1", "J2", "J9", "J10", "J13"]


def test_unresolved_only_where_nothing_resolves(spark, core):
    entries = spark.createDataFrame([("t", "J9", "t:J9", "long_gone", None), ("t", "J1", "t:J1", "stock", "stock.py"), ("t", "J1", "t:J1", "nope", None), ("t", "J2", "t:J2", "stock", "tock.py")], "target string, journey_id string, journey string, name string, file string")
    got = {(r["journey"], r["names"]) for r in journeys.unresolved_journeys(journeys.resolve_entries(entries, core[0])).collect()}
    assert got == {("t:J9", "long_gone"), ("t:J2", "stock")}


def test_shared_tables_follow_their_sources(spark, tmp_path):
    source, made = str(tmp_path / "t"), []

    def get():
        def make():
            made.append(1)
            return spark.read.parquet(source)

        return SharedTables(spark, [source]).get("x", make).count()

    spark.range(3).write.parquet(source)
    assert (get(), get(), len(made)) == (3, 3, 1)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert (get(), len(made)) == (5, 2)
    work, _ = SharedTables._made[(*SharedTables(spark, [source]).key, "x")]
    work.drop("x")
    assert (get(), len(made)) == (5, 3)
