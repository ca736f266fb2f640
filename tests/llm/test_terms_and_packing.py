import random
import re
from collections import Counter

import pyarrow as pa
import numpy as np

from ripplegraph.llm import packing, term_stats


def test_terms_against_brute_force(spark):
    rnd = random.Random(1)
    words = ["load", "Save", "getNode", "a_b", "É", "x9", "", "K", "run-RUN"]
    rows = [(rnd.choice([None, *(f"id{k}" for k in range(60))]), rnd.choice([None, *words]) and rnd.choice(words) + "_" + rnd.choice(words), rnd.choice([None, "Function ", " function", "", "\tClass"]), "t", 1) for _ in range(500)]
    df = spark.createDataFrame(rows, "id string, name string, kind string, term string, records int").repartition(7)
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in term_stats.symbol_terms(df).collect()}
    ids = {i for i, *_ in rows if i is not None}
    occurrences, records = Counter(), Counter()
    for field, at, split in (("name", 1, lambda v: re.findall("[a-z0-9]+", v.lower())), ("kind", 2, lambda v: [v.lower().strip()] if v.strip() else [])):
        held = {(r[0], tuple(split(r[at]))) for r in rows if r[0] is not None and r[at] is not None}
        seen = set()
        for record, terms in held:
            for t in terms:
                occurrences[field, t] += 1
                seen.add((t, record))
        for t, _ in seen:
            records[field, t] += 1
    mark = lambda n: "rare" if n <= 2 else "common" if n > 0.05 * len(ids) else None
    assert got == {k: (occurrences[k], n, mark(n)) for k, n in records.items()}


def test_terms_empty(spark):
    df = spark.createDataFrame([], "id string, name string, kind string")
    assert term_stats.symbol_terms(df).count() == 0
    df = spark.createDataFrame([(None, "x", "y"), ("a", None, None)], "id string, name string, kind string")
    assert term_stats.symbol_terms(df).count() == 0


def test_last_seen_keeps_count_over_flushes():
    seen = term_stats.LastSeen()
    add = lambda terms, records: seen.add(pa.array(terms), pa.array(records), np.ones(len(terms), np.int64))
    add(["a", "b", "a"], ["r1", "r1", "r2"])
    first = [b.to_pylist() for b in seen.take()]
    add(["a", "a", "c"], ["r2", "r3", "r3"])
    total = Counter()
    for part in first + [b.to_pylist() for b in seen.take()]:
        for r in part:
            total[r["token"], "o"] += r["occurrences"]
            total[r["token"], "r"] += r["records"]
    assert total == {("a", "o"): 4, ("a", "r"): 3, ("b", "o"): 1, ("b", "r"): 1, ("c", "o"): 1, ("c", "r"): 1}


def test_packing_places_everything_once(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.choice([0, 1, 30, 200, 900, 1500, 2500]))) for _ in range(400)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(1000, None, "x"), (1001, "", "x"), (1001, "two", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, window string").repartition(3)
    packed = packing.pack(df).collect()
    pieces: dict = {}
    windows: dict = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"], r["window"]))
        windows.setdefault(r["window"], []).append((r["offset"], r["n_tokens"]))
    for k, t in enumerate(texts):
        size = packing.token_count(t)
        assert sum(n for _, n, _ in pieces[k]) == size
        if size <= packing.CAPACITY:
            assert len(pieces[k]) == 1
        else:
            assert [n for _, n, _ in sorted(pieces[k])][:-1] == [packing.CAPACITY] * (len(pieces[k]) - 1)
    assert pieces[1000] == [(0, 0, pieces[1000][0][2])] and len(pieces[1001]) == 2
    for spans in windows.values():
        at = 0
        for offset, n in sorted(s for s in spans if s[1]):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    used = sum(n for s in windows.values() for _, n in s)
    assert used / (len(windows) * packing.CAPACITY) > 0.97


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_window_takes_an_exact_fit():
    packer = packing.SumOfSquares(10)
    assert packer.place("a", 6) is None and packer.place("b", 4) == [10, ("a", 6), ("b", 4)] and packer.place("c", 10) == [10, ("c", 10)]
    assert packer.place("d", 3) is None and packer.close() == [[3, ("d", 3)]] and packer.close() == []
    assert packing.pieces(25, 10) == [10, 10, 5] and packing.pieces(20, 10) == [10, 10] and packing.pieces(10, 10) == [10]


def test_faults_of_a_packing_are_counted(spark):
    schema = "doc_id long, piece int, window string, offset int, n_tokens int"
    good = [(1, 0, "a", 0, 6), (2, 0, "a", 6, 4), (3, 0, "b", 0, 10), (3, 1, "c", 0, 7), (4, 0, "a", 0, 0)]
    row = packing.packing_faults(spark.createDataFrame(good, schema), 10, 0.9).first()
    assert tuple(row[c] for c in ("placed", "split_needlessly", "not_full", "over_capacity", "gaps", "well_filled")) == (4, 0, 0, 0, 0, True)
    bad = [(1, 0, "a", 0, 6), (2, 0, "a", 5, 6), (3, 0, "b", 0, 3), (3, 1, "c", 1, 4), (3, 2, "d", 0, 2)]
    row = packing.packing_faults(spark.createDataFrame(bad, schema), 10, 0.9).first()
    assert (row["split_needlessly"], row["not_full"], row["over_capacity"], row["gaps"], row["well_filled"]) == (1, 2, 1, 2, False)
    assert packing.packing_faults(spark.createDataFrame([], schema), 10).first()["placed"] == 0
