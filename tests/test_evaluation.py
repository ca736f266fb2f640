from pyspark.sql import functions as F

from ripplegraph.operators import evaluation as ev
from ripplegraph.sources import sinks


def test_seeded_scores(spark):
    answers = spark.createDataFrame([("s1", "J1", 1), ("s1", "J2", 3), ("s2", "J1", 1)], "site string, journey string, position int")
    expected = spark.createDataFrame([("s1", "J2"), ("s1", "J1"), ("s2", "J9"), ("s2", "J1")], "site string, journey string")
    rows = {r["site"]: (r["recall"], r["worst_rank"]) for r in ev.seeded_scores(answers, expected).collect()}
    assert rows == {"s1": (1.0, 3), "s2": (0.5, None)}
    s = ev.seeded_summary(ev.seeded_scores(answers, expected)).first()
    assert (s["sites"], s["min_recall"], s["mean_worst_rank"]) == (2, 0.5, 3.0)
    assert ev.seeded_summary(ev.seeded_scores(answers, expected.limit(0))).first()["min_recall"] is None


def test_adjudication(spark):
    d = spark.createDataFrame([("s", "J1", "abcdef"), ("s", "J2", "abcdef"), ("s", "J3", "abcdef")], "site string, journey string, base string")
    r = spark.createDataFrame([("s", "J1", "abc"), ("s", "J2", "fff")], "site string, journey string, base_sha string")
    assert {x["journey"]: x["state"] for x in ev.adjudicate(d, r).collect()} == {"J1": "excused", "J2": "stale", "J3": "open"}


def test_ground_truth(spark):
    long = lambda rows: spark.createDataFrame(rows, "journey string, id string")
    rows = {r["journey"]: r for r in ev.ground_truth(spark.createDataFrame([("J1",), ("J2",)], "journey string"), long([("J1", "a"), ("J1", "b")]), long([("J1", "b"), ("J1", "c"), ("J1", "d"), ("J2", "z")])).collect()}
    assert (rows["J1"]["traced_only"], rows["J1"]["static_only"]) == (1, 2)
    assert rows["J2"]["state"] == "no trace" and rows["J2"]["static_only"] is None
    (u,) = ev.unit_against_real(long([("J1", "a"), ("J1", "b")]), long([("J1", "b")])).collect()
    assert (u["unit"], u["real"], u["shared"], u["unit_only"], u["real_only"]) == (2, 1, 1, 1, 0)
    chosen = spark.createDataFrame([("x", 2), ("y", 1)], "journey string, n int")
    assert {r["journey"]: r["new_id"] for r in ev.renumbered(chosen, ["n"]).collect()} == {"y": "J1", "x": "J2"}


def test_map_and_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "f|g", "m.py", 3), ("b", "h", "m.py", 1)], "id string, name string, file_path string, start_line int")
    index = spark.createDataFrame([("J2", "a", 0.9), ("J1", "a", 0.5), ("J1", "b", 1.0)], "journey string, id string, conf double")
    rows = sinks.impact_map(index, nodes)
    a = rows.where("start_line = 3").first()
    assert (a["journeys"], a["confidence"], a["verify"]) == ("J1, J2", 0.9, "J1")
    text = sinks.markdown_lines(rows).first()["text"]
    assert text.startswith("## m.py\n") and text.index("| h |") < text.index("f\\|g")
    judged = spark.createDataFrame([("J1", "pass"), ("J2", "skip")], "journey string, verdict string")
    assert sinks.append_e2e_outcomes(judged, str(tmp_path / "l"), "r", "a" * 40, 1.0)
    assert spark.read.json(str(tmp_path / "l")).count() == 1
    df = spark.createDataFrame([(["a", "b", "c", "d"], "s", True)], "x array<string>, sha string, dirty boolean")
    r = df.select(sinks.first_of(F.col("x"), 3).alias("f"), sinks.stamp(F.col("sha"), F.col("dirty")).alias("s"), sinks.stamp(F.lit(None), F.col("dirty")).alias("n")).first()
    assert tuple(r) == ("a, b, c … 1 more", "s-dirty", None)


def test_exit_codes(spark):
    rows = [(True, 1, 0, False), (False, 1, 1, True), (False, 0, 1, False), (False, 0, 0, True), (False, 0, 0, False)]
    df = spark.createDataFrame(rows, "r boolean, f int, u int, c boolean")
    got = df.select(sinks.exit_code(F.col("r"), F.col("f"), F.col("u"), F.col("c")).alias("e")).collect()
    assert [r["e"] for r in got] == [2, 1, 3, 3, 0]
