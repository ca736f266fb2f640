"""The truth table of the ledger join, and its file and stream forms."""

import json

import pytest

from ripplegraph.operators import ledger
from ripplegraph.sources import ledger_io
from ripplegraph.streaming import ledger_stream

OUT = "repo string, commit string, journey string, verdict string, ts long, seq long"
SEL = "repo string, commit string, base string, status string, journey_id string, ts long"


def total(spark, outcomes, selections):
    o = spark.createDataFrame([("r", c, j, v, n, n) for n, (c, j, v) in enumerate(outcomes)], OUT)
    s = spark.createDataFrame([("r", c, b, st, j, n) for n, (b, c, st, j) in enumerate(selections)], SEL)
    rows = ledger.buckets(o, s)
    (t,) = ledger.totals(rows).collect()
    h = {r["journey"]: r for r in ledger.history(rows).collect()}
    return t, h


@pytest.mark.parametrize(
    ("outcomes", "selections", "caught", "missed", "recall", "more"),
    [
        ([("1", "J1", "pass"), ("2", "J1", "fail")], [("1", "2", "OK", "J1"), ("1", "2", "OK", "J2")], 1, 0, 1.0, {}),
        ([("1", "J2", "pass"), ("2", "J2", "fail")], [("1", "2", "OK", "J1")], 0, 1, 0.0, {}),
        ([("1", "J2", "fail")], [], 0, 0, None, {"unasked": 1}),
        ([("2", "J1", "fail"), ("3", "J1", "fail")], [("1", "2", "OK", "J1"), ("2", "3", "OK", "J1")], 0, 0, None, {"unbaselined": 2}),
        ([("3", "J3", "fail")], [("1", "2", "OK", "J3"), ("2", "3", "OK", None)], 0, 0, None, {"unbaselined": 1}),
        ([("1", "J1", "pass"), ("2", "J1", "fail")], [("1", "2", "BLOCKED", "J1")], 0, 0, None, {"unasked": 1}),
        ([("2", "J2", "pass")], [("1", "2", "OK", "J1")], 0, 0, None, {"passes": 1}),
        ([("1", "J2", "pass"), ("2", "J2", "fail")], [("1", "2", "OK", "J1"), ("1", "2", "OK", "J2")], 1, 0, 1.0, {}),
        ([("1", "J2", "pass"), ("2", "J2", "fail"), ("2", "J2", "fail")], [("1", "2", "OK", "J1")], 0, 1, 0.0, {"failures": 1, "runs": 2}),
    ],
)
def test_truth_table(spark, outcomes, selections, caught, missed, recall, more):
    t, h = total(spark, outcomes, selections)
    assert (t["caught"], t["missed"], t["observed_recall"]) == (caught, missed, recall)
    last = h[outcomes[-1][1]]
    assert all(last[k] == v for k, v in more.items())


def test_empty_ledger(spark):
    rows = ledger.buckets(spark.createDataFrame([], OUT), spark.createDataFrame([], SEL))
    assert rows.count() == 0 and ledger.totals(rows).count() == 0


def test_vacuous_precision_and_recall(spark):
    s = spark.createDataFrame([("a", "J1"), ("b", "J1")], "k string, journey string")
    o = spark.createDataFrame([("b", "J2"), ("c", "J2")], "k string, journey string")
    got = {r["k"]: (r["precision"], r["recall"]) for r in ledger.precision_recall(s, o, ["k"]).collect()}
    assert got == {"a": (0.0, 1.0), "b": (0.0, 0.0), "c": (0.0, 0.0)}


def rows_of(tmp_path):
    a, b = "a" * 40, "b" * 40
    lines = [
        json.dumps({"kind": "outcome", "ts": 1, "repo": "r", "commit": a, "journey": "J1", "verdict": "pass"}),
        json.dumps({"kind": "outcome", "ts": 2, "repo": "r", "commit": b, "journey": "J1", "verdict": "fail"}),
        json.dumps({"kind": "selection", "ts": 2, "repo": "r", "head": b, "base": a, "status": "OK", "journey_ids": ["J1"]}),
        '{"kind": "outcome", "ts": 3, "re',
        "[1, 2]",
        json.dumps({"kind": "outcome", "ts": "x", "repo": "r", "commit": a, "journey": "J9", "verdict": "skip"}),
    ]
    (tmp_path / "ledger.jsonl").write_text("\n".join(lines))
    return str(tmp_path)


def test_files_are_read_tolerantly(spark, tmp_path):
    rows = ledger_io.read_ledger(spark, rows_of(tmp_path), repo="r")
    assert rows.count() == 4 and rows.where("journey = 'J9'").first()["ts"] == 0
    (t,) = ledger.totals(ledger.buckets(ledger_io.outcomes_of(rows), ledger_io.selections_of(rows))).collect()
    assert t["caught"] == 1


def test_append_never_raises(spark, tmp_path):
    df = spark.createDataFrame([("outcome", None)], "kind string, note string")
    assert ledger_io.append_rows(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert "note" not in text
    (tmp_path / "file").write_text("x")
    assert not ledger_io.append_rows(df, str(tmp_path / "file" / "below"))


def test_stream_keeps_the_last_verdict(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = rows_of(tmp_path / "in")
    q = ledger_stream.latest_verdicts(ledger_stream.read_stream(spark, path)).writeStream.outputMode("complete").format("memory").queryName("latest_v").start()
    q.processAllAvailable()
    late = {"kind": "outcome", "ts": 0.5, "repo": "r", "commit": "a" * 40, "journey": "J1", "verdict": "fail"}
    (tmp_path / "in" / "more.jsonl").write_text(json.dumps(late))
    q.processAllAvailable()
    got = {(r["commit"][0], r["journey"]): r["verdict"] for r in spark.table("latest_v").collect()}
    q.stop()
    assert got == {("a", "J1"): "pass", ("b", "J1"): "fail", ("a", "J9"): "skip"}
    seen = []
    ledger_stream.keep_totals(spark, path, str(tmp_path / "cp"), lambda df: seen.extend(df.collect())).awaitTermination()
    assert seen[-1]["caught"] == 1


def test_equal_times_go_by_line(spark, tmp_path):
    row = lambda v: json.dumps({"kind": "outcome", "ts": 5, "repo": "r", "commit": "a" * 40, "journey": "J1", "verdict": v})
    (tmp_path / "l.jsonl").write_text("\n".join(map(row, ["fail", "skip", "pass"])))
    rows = ledger_io.outcomes_of(ledger_io.read_ledger(spark, str(tmp_path)))
    assert ledger.latest_outcomes(rows.repartition(3)).first()["verdict"] == "pass"


def test_a_table_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2):
        ledger_io.write_atomically(spark.createDataFrame([(n,)], "n long"), path)
        assert [r["n"] for r in ledger_io.read_current(spark, path, "n long").collect()] == [n]
    assert sorted(p.name[:2] for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["cu", "v-"]


def test_a_faulty_plan_is_no_failed_write(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)divi|zero"):
        spark.conf.set("spark.sql.ansi.enabled", "true")
        ledger_io.append_rows(spark.range(3).selectExpr("1 / (id - 1) as x"), str(tmp_path / "o"))


def test_ledger_in_words(spark):
    o = spark.createDataFrame([("r", "1", "J1", "pass", 1, 1), ("r", "2", "J1", "fail", 2, 2), ("q", "2", "J1", "skip", 2, 2)], OUT)
    s = spark.createDataFrame([("r", "2", "1", "OK", "J1", 3), ("r", "2", "1", "OK", "J2", 3)], SEL)
    rows = ledger.buckets(o, s)
    out = {r["repo"]: r for r in ledger.export_payload(ledger.totals(rows).join(ledger.ledger_counts(o, s), "repo"), ledger.history(rows)).collect()}
    assert out["r"]["content"] == "Ledger of r: 1 selections, 2 outcomes, 1 commits with both. Observed recall 1.00 over 1 judged failures (0 missed in silence)."
    assert out["q"]["content"].endswith("recall is not known.") and json.loads(out["r"]["evidence"])["per_journey"][0]["caught"] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_running_totals_equal_the_whole(spark, tmp_path, seed):
    """Batches in any order, late baselines among them, one of them taken in twice."""
    import random

    rnd = random.Random(seed)
    sha = [f"{k:040x}" for k in range(8)]
    lines = [{"kind": "outcome", "ts": k, "repo": rnd.choice("rq"), "commit": rnd.choice(sha), "journey": f"J{rnd.randrange(3)}", "verdict": rnd.choice(["pass", "fail", "fail", "skip"])} for k in range(60)]
    lines += [{"kind": "selection", "ts": k, "repo": rnd.choice("rq"), "head": rnd.choice(sha), "base": rnd.choice(sha), "status": rnd.choice(["OK", "OK", "BLOCKED"]), "journey_ids": rnd.sample(["J0", "J1", "J2"], rnd.randrange(3))} for k in range(30)]
    rnd.shuffle(lines)
    running = ledger_stream.RunningTotals(spark, str(tmp_path / "state"))
    for batch in range(3):
        folder = tmp_path / f"in{batch}"
        folder.mkdir()
        (folder / "l.jsonl").write_text("\n".join(map(json.dumps, lines[batch * 30 : batch * 30 + 30])))
        for _ in range(2 if batch == 1 else 1):
            got = running.take(ledger_io.read_ledger(spark, str(folder)).drop("seq"), batch)
    rows = ledger_io.read_ledger(spark, [str(tmp_path / f"in{k}") for k in range(3)])
    want = ledger.totals(ledger.buckets(ledger_io.outcomes_of(rows), ledger_io.selections_of(rows)))
    key = lambda df: sorted(tuple(r[c] for c in ("repo", "judged_commits", "caught", "missed", "observed_recall", "ready")) for r in df.collect())
    assert key(got) == key(want)
