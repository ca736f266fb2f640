import random

import pytest

from ripplegraph.llm import entity_match as em


def test_paths_are_read():
    assert em.read_path("C:\\x\\Src\\A_b.py")[2] == "ab" and em.read_path("./a/__pycache__/x.cpython-312.pyc")[0] == ["a"]
    assert em.read_path("a/x.tsx.js")[2:] == ("x", "x", "js") and em.read_path(None)[2] == ""


def test_path_cost():
    cost = lambda a, b: em.path_cost(*em.read_path(a)[:2], *em.read_path(b)[:2])
    assert cost("build/lib/src/p/a/x.py", "src/p/a/x.py") == 0 and cost("p/a/x.py", "src/p/a/x.py") == 0
    assert cost("p/a_v2/x.py", "src/p/a/x.py") == 0.5 and cost("p/aip/x.py", "p/api/x.py") == 0.5
    assert cost("p/x.py", "src/p/a/x.py") == 1 and cost("p/q/a/x.py", "src/p/a/x.py") == 1
    assert cost("src/p/a/x.py", "src/q/a/x.py") > em.MAX_PATH_COST


def test_names_are_read():
    assert em.read_qualname("f.<locals>.<lambda>", "m") is None
    assert em.read_qualname("m.K.run()", "m")[:4] == ("run", "run", "run", "k")
    assert em.read_qualname("K._K__hide", "m")[:2] == ("__hide", "hide") and em.read_qualname("async go$1", "m")[1:3] == ("go1", "go")


NODES = "id string, kind string, name string, qualified_name string, file_path string, weight double"
TRACES = "trace_id long, tests map<string, array<array<string>>>, relpath string, node_id string"


def build(spark, n=60):
    rnd = random.Random(4)
    nodes, pairs, want = [], [], {}
    for k in range(n):
        directory, stem, name = rnd.choice(["api", "core", "jobs"]), f"part_{k % 7}", f"load_thing_{chr(97 + k % 26)}{k}"
        path, owner = f"src/proj/{directory}/{stem}.py", rnd.choice(["", f"Thing{k % 5}"])
        qualified = f"{owner}::{name}" if owner else name
        nodes.append((f"n{k}", rnd.choice(["function", "Method ", None]), name, rnd.choice([qualified, None]), path, 1.0))
        relpath = rnd.choice([path, f"build/lib/{path}", path.removeprefix("src/"), path.replace("/", "\\"), path.replace("_", "-"), path + "c", path.replace(directory, directory + "_v2")])
        dotted = f"{owner}.{name}" if owner else name
        pairs.append([relpath, rnd.choice([dotted, dotted.replace("load", "laod"), dotted + "()", f"{stem}.{dotted}"])])
        want[tuple(pairs[-1])] = f"n{k}"
    nodes += [*nodes[:5], ("file:x", "file", "x", "x", "src/proj/x.py", 1.0), ("nul", None, None, None, None, None), (None, "function", "q", "q", "a.py", 1.0)]
    return nodes, pairs, want


def test_matching_finds_the_planted_nodes(spark):
    nodes, pairs, want = build(spark)
    junk = [["tests/test_a.py", "test_x"], ["vendor/k/part_1.py", "zzz"], ["src/proj/api/part_1.py", "<lambda>"], None, ["only"], [None, "x"], ["a", None], [], ["", ""]]
    traces = [(1, {"t1": pairs, "t2": junk, "t3": None, "t4": []}, "x", "y"), (1, {"t1": pairs}, "x", "y"), (2, {"t9": pairs[:3]}, "x", "y"), (3, None, "x", "y"), (None, {"t": pairs}, "x", "y")]
    got = em.match_symbols(spark, spark.createDataFrame(traces, TRACES), spark.createDataFrame(nodes, NODES)).collect()
    found = {(r["trace_id"], r["relpath"], r["qualname"]): r["node_id"] for r in got}
    assert len(found) == len(got) and all(0.5 <= r["confidence"] <= 1 for r in got)
    right = sum(found.get((1, *p)) == n for p, n in want.items())
    assert right >= 0.97 * len(want)
    assert all(tuple(k[1:]) in want for k in found) and {k for k in found if k[0] == 2} == {(2, *p) for p in pairs[:3] if (1, *p) in found}


def test_siblings_of_one_file_stay_apart(spark):
    """Names that differ by a closing number or by the order of letters denote different nodes."""
    names = ["step", "step1", "step2", "get_form", "get_from"]
    nodes = [(f"n_{name}", "function", name, name, "src/proj/api/flow.py", 1.0) for name in names]
    pairs = [["src/proj/api/flow.py", name] for name in [*names, "step$1", "setp1", "flow.step2"]]
    got = em.match_symbols(spark, spark.createDataFrame([(1, {"t": pairs}, "x", "y")], TRACES), spark.createDataFrame(nodes, NODES)).collect()
    want = {name: f"n_{name}" for name in names} | {"step$1": "n_step", "setp1": "n_step1", "flow.step2": "n_step2"}
    assert {r["qualname"]: r["node_id"] for r in got} == want


def test_words_of_the_same_letters_in_one_file(spark):
    names = ["listen", "silent", "form", "from_", "enlist"]
    nodes = [(f"n_{name}", "function", name, name, "src/proj/api/flow.py", 1.0) for name in names]
    got = em.match_symbols(spark, spark.createDataFrame([(1, {"t": [["src/proj/api/flow.py", name] for name in names]}, "x", "y")], TRACES), spark.createDataFrame(nodes, NODES)).collect()
    assert {r["qualname"]: r["node_id"] for r in got} == {name: f"n_{name}" for name in names}


def test_every_spelling_of_a_node_can_be_matched(spark):
    """A node that moved: both places match, and no place takes the name of the other."""
    rows = [("n1", "function", "load_all", "load_all", "src/old/jobs.py", "2025-01-01"), ("n1", None, "fetch_all", None, "src/new/jobs.py", "2025-02-01"), ("n2", "method", None, "K::load_all", "src/new/jobs.py", "2025-01-01")]
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, file_path string, indexed_at string")
    pairs = [["src/old/jobs.py", "load_all"], ["src/new/jobs.py", "fetch_all"], ["src/new/jobs.py", "K.load_all"], ["src/old/jobs.py", "fetch_all"]]
    got = em.match_symbols(spark, spark.createDataFrame([(1, {"t": pairs}, "x", "y")], TRACES), nodes).collect()
    assert {(r["relpath"], r["qualname"]): r["node_id"] for r in got} == {("src/old/jobs.py", "load_all"): "n1", ("src/new/jobs.py", "fetch_all"): "n1", ("src/new/jobs.py", "K.load_all"): "n2"}
    mended = {(r["file_path"], r["kind"], r["name"], r["qualified_name"]) for r in em._spellings(nodes).where("id = 'n1'").collect()}
    assert mended == {("src/old/jobs.py", "function", "load_all", "load_all"), ("src/new/jobs.py", "function", "fetch_all", "load_all")}


def test_blocks_lose_no_pair():
    """Whatever two paths align within the cost limit, they share a block."""
    rnd, met = random.Random(9), 0
    words = ["api", "aip", "core", "jobs", "web", "api_v2"]
    for _ in range(20_000):
        some = [rnd.choice(words) for _ in range(rnd.randrange(1, 6))]
        other = [w for w in some if rnd.random() > 0.1]
        if rnd.random() < 0.4:
            other.insert(rnd.randrange(len(other) + 1), rnd.choice(words))
        if rnd.random() < 0.4 and other:
            other = other[rnd.randrange(len(other)) :]
        a, b = em.read_path("/".join([*some, "x.py"])), em.read_path("/".join([*other, "x.py"]))
        if not a[1] or not b[1]:
            continue
        cost = em.path_cost(*a[:2], *b[:2])
        marked = em._alignment("/".join(a[0]), "/".join(a[1]), "/".join(b[0]), "/".join(b[1]))
        assert min(marked, abs(marked - em.LEFT_OUT)) == cost
        if cost <= em.MAX_PATH_COST:
            met += 1
            assert set(em.mention_blocks({"f"}, [], a[3], a[1])) & set(em.node_blocks("f", [], b[3], b[1])), (some, other)
    assert met > 5_000


def test_a_node_that_everybody_wants(spark):
    """A hub of the pair graph: sums come from aggregates, and every spelling still finds it."""
    nodes = [("hub", "function", "main_loop", "main_loop", "src/app/core/run.py", 1.0), ("rim", "function", "main_loop", "K::main_loop", "src/app/core/run.py", 1.0)]
    pairs = [[f"{'x/' * (k % 9)}m{k}/src/app/core/run.py", "main_loop"] for k in range(300)]
    got = em.match_symbols(spark, spark.createDataFrame([(1, {"t": pairs}, "x", "y")], TRACES), spark.createDataFrame(nodes, NODES)).collect()
    assert len(got) == 300 and {r["node_id"] for r in got} == {"hub"}


def test_beliefs_prefer_one_to_one(spark):
    """Two mentions and two nodes: the undecided mention is pushed to the node nobody else wants."""
    from ripplegraph.session import Workspace

    odds = spark.createDataFrame([("sure", "a", 50.0), ("open", "a", 10.0), ("open", "b", 9.0), ("alone", "c", 3.0)], "entity string, node_id string, odds double")
    got = {(r["entity"], r["node_id"]): r["belief"] for r in em._propagate(Workspace(spark, "t"), odds, 12, 0.001).collect()}
    assert got["open", "b"] > 0.7 > got["open", "a"] and got["sure", "a"] > 0.8 and abs(got["alone", "c"] - 0.75) < 1e-9


def test_beliefs_that_still_move_are_no_answer(spark):
    from ripplegraph.session import Workspace

    odds = spark.createDataFrame([("sure", "a", 50.0), ("open", "a", 10.0), ("open", "b", 9.0)], "entity string, node_id string, odds double")
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        em._propagate(Workspace(spark, "t"), odds, 2, 0.001)


def test_matching_empty(spark):
    none = em.match_symbols(spark, spark.createDataFrame([], TRACES), spark.createDataFrame([], NODES))
    assert none.count() == 0
