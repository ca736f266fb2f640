"""References to records that do not exist: incremental keyed pending-orphan state.

The tracker is fed batches as they arrive. A batch brings references, and events of parents
(one arrives, one is removed), each with the time it speaks of, which may lie long before. Its
state is a folder:

* ``index``   -- the parent index: all events of parents so far, appended;
* ``refs``    -- the log of the references as they arrived, appended;
* ``orphans`` -- a signed log: references found to be orphans (+1), findings taken back (-1);
* ``waiting`` -- per key with orphans: its live parents now, and its orphans per side;
* ``manifest``-- one small file per committed version.

A batch costs one pass over its own references: they meet the index by key in one window
ordered by time, so a late reference is judged by the index as it stood when it was made. Of
the orphans only their counts per key are carried on: an arriving parent resolves all that
wait for its key, a removal reopens them, and both change one row. Where a parent's event comes
late itself, what was judged without it is read from the log and judged again, for the keys
in question only.

A version counts once its manifest is there; whatever a lost run left behind is written over
by the next one, which goes on from the last version of the folder.

Keys that hold a large share of a batch's references are salted: their references are spread
over as many tasks as there are shuffle partitions, and only their parents' events repeat.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.operators.skew import hot_keys, salt_of, salts_of
from ripplegraph.session import Workspace, default_parallelism

_REFS = "edge_id long, source string, target string, seen_at timestamp_ntz, slot int"
_INDEX = "key string, ts timestamp_ntz, delta int, other timestamp_ntz, slot int"
_FOUND = "edge_id long, side string, key string, seen_at timestamp_ntz, sign int, late boolean, version int"
_JUDGED = "key string, edge_id long, side string, seen_at timestamp_ntz, orphan boolean, live long, kind string"
_WAITING = "key string, live long, source long, target long, was_live long, was_source long, was_target long"
_REF = ["edge_id", "side", "key", "seen_at"]
#: Slot of what has no time at all: it comes last.
NO_TIME = 999_999
SIDES = ("source", "target")


def instant(at: dt.datetime) -> Column:
    """A time without zone: all times are compared as they were recorded, whatever the session's zone."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def _time(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


def month_of(ts: Column) -> Column:
    return F.coalesce(F.year(ts) * 12 + F.month(ts) - 1, F.lit(NO_TIME)).cast("int")


def month_start(month: int) -> dt.datetime:
    return dt.datetime(month // 12, month % 12 + 1, 1)


def arrivals(edges: DataFrame, arrival: str | None = "loaded_at") -> DataFrame:
    """Edge rows with a reference that is neither null nor empty, by the month they arrived in.

    A reference arrives no sooner than it was made: at the later of ``arrival`` and ``seen_at``.
    """
    seen = _time("seen_at")
    arrived = F.greatest(seen, _time(arrival)) if arrival else seen
    named = "coalesce(source, '') <> '' or coalesce(target, '') <> ''"
    return edges.where(named).select(F.col("id").alias("edge_id"), "source", "target", seen.alias("seen_at"), month_of(arrived).alias("slot"))


def references(rows: DataFrame) -> DataFrame:
    """One row per row and side with a reference that is neither null nor empty."""
    ends = F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("key")) for side in SIDES))
    return rows.select("edge_id", "seen_at", F.explode(ends).alias("r")).select("edge_id", "r.side", "r.key", "seen_at").where("key is not null and key <> ''")


def parent_events(nodes: DataFrame) -> DataFrame:
    """What happens to parents, each event once: ``key, ts, delta, other``.

    ``other`` is the other end of the index row that the event belongs to. Rows that cover no
    time at all and rows delivered again give nothing.
    """
    rows = nodes.select(F.col("id").alias("key"), _time("indexed_at").alias("indexed_at"), _time("removed_at").alias("removed_at"))
    rows = rows.where("key is not null and indexed_at is not null and (removed_at is null or removed_at > indexed_at)").distinct()
    both = F.array(F.struct(F.col("indexed_at").alias("ts"), F.lit(1).alias("delta"), F.col("removed_at").alias("other")), F.struct(F.col("removed_at").alias("ts"), F.lit(-1).alias("delta"), F.col("indexed_at").alias("other")))
    return rows.select("key", F.explode(both).alias("e")).select("key", "e.*").where("ts is not null")


def judge(refs: DataFrame, index: DataFrame, hot: list[str], salts: int) -> DataFrame:
    """``refs`` (with ``again``: judged before) against ``index`` (with ``new``): one window by key.

    Gives the references without a parent when they were made, those judged again whatever
    comes out, and one row for every key whose parents changed, all with the key's live parents.
    """
    key, none = F.col("key"), lambda kind: F.lit(None).cast(kind)
    said = refs.select("key", F.col("seen_at").alias("ts"), F.lit(1).alias("ord"), F.lit(0).alias("delta"), "edge_id", "side", "again", salt_of(key, F.col("edge_id"), hot, salts).alias("salt"))
    known = index.select("key", "ts", F.lit(0).alias("ord"), "delta", none("long").alias("edge_id"), none("string").alias("side"), F.col("new").alias("again"), F.explode(salts_of(key, hot, salts)).alias("salt"))
    group = W.partitionBy("key", "salt")
    so_far = group.orderBy(F.asc_nulls_first("ts"), "ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    is_event = F.col("ord") == 0
    met = said.unionByName(known).select(
        "*",
        F.coalesce(F.sum("delta").over(so_far), F.lit(0)).alias("now"),
        F.coalesce(F.sum("delta").over(group), F.lit(0)).cast("long").alias("live"),
        F.when(is_event, F.count(F.when(is_event, 1)).over(so_far)).alias("nth"),
        F.max(F.when(is_event, F.col("again"))).over(group).alias("touched"),
    )
    kept = met.where((is_event & (F.col("nth") == 1) & (F.col("salt") == 0) & F.col("touched")) | (~is_event & (F.col("again") | (F.col("now") == 0))))
    return kept.select("key", "edge_id", "side", F.when(~is_event, F.col("ts")).alias("seen_at"), (F.col("now") == 0).alias("orphan"), "live", F.when(is_event, "parent").otherwise("ref").alias("kind"))


class OrphanTracker:
    """The pending-orphan state in a folder; opened on one that has versions, it goes on from the last."""

    def __init__(self, spark: SparkSession, path: str | None = None, salts: int | None = None, hot: list[str] | None = None):
        self.spark, self.hot, self.salts = spark, hot, salts or default_parallelism(spark)
        self.work = Workspace(spark, "orphans", path)
        committed = [name for name in self.work.names("manifest") if name.endswith(".json")]
        state = json.loads(self.work.read_text(f"manifest/{max(committed)}")) if committed else {}
        self.version, self.through = state.get("version", 0), state.get("through", -1)
        self.horizon = dt.datetime.fromisoformat(state["horizon"]) if state.get("horizon") else None
        self.taken_back, self.counts = state.get("taken_back", False), [tuple(c) for c in state.get("counts", [])]

    def _log(self, name: str, schema: str, at_most: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.work.at(name)).where(at_most)

    def step(self, refs: DataFrame, events: DataFrame, until: dt.datetime | None = None) -> list[tuple]:
        """Take in one batch: rows as ``arrivals`` gives them and events as ``parent_events`` does.

        Either may be late, repeated, or come in any order; ``until`` is the end of the period
        in which the batch arrived. Returns the counts at its end.
        """
        slot = self.through + 1
        refs.drop("slot").write.mode("overwrite").parquet(self.work.at(f"refs/slot={slot}"))
        fresh = events.select("key", "ts", "delta", "other").distinct()
        if self.version:  # an event delivered again in a later batch is none
            held = self._log("index", _INDEX, f"slot < {slot}")
            same = [fresh[c].eqNullSafe(held[c]) for c in ("key", "ts", "delta", "other")]
            fresh = fresh.join(held, same, "left_anti")
        fresh.write.mode("overwrite").parquet(self.work.at(f"index/slot={slot}"))
        return self.advance(slot, until)

    def advance(self, through: int, until: dt.datetime | None = None, since: dt.datetime | None = None) -> list[tuple]:
        """Judge what the logs hold up to slot ``through``; references made before ``since`` are late."""
        version, mine = self.version + 1, f"slot > {self.through} and slot <= {through}"
        batch = self._log("refs", _REFS, mine)
        events = self._log("index", _INDEX, f"slot <= {through}").withColumn("new", F.col("slot") > self.through)
        refs = references(batch).withColumn("again", F.lit(False))
        late = events.where("new").where(F.col("ts") < instant(self.horizon)) if self.horizon else None
        late = late if late is not None and not late.isEmpty() else None
        if late is not None:  # what was judged without these events is judged again
            since_event = late.groupBy("key").agg(F.min("ts").alias("from"))
            before = references(self._log("refs", _REFS, f"slot <= {self.through}")).join(since_event, "key").where(F.col("seen_at") >= F.col("from"))
            refs = refs.unionByName(before.select(*_REF, F.lit(True).alias("again")))
        hot = hot_keys(refs.select("key")) if self.hot is None else self.hot
        judged = self.work.save(judge(refs, events, hot, self.salts), f"judged-{version}")
        self._log_findings(judged, version, since, late is not None)
        self._count(judged, version)
        self.horizon = max(filter(None, (self.horizon, until, self._latest(batch) if until is None else None)), default=None)
        self.version, self.through, self.taken_back = version, through, self.taken_back or late is not None
        state = {"version": version, "through": through, "horizon": self.horizon.isoformat() if self.horizon else None, "taken_back": self.taken_back, "counts": self.counts}
        self.work.write_text(f"manifest/{version:06d}.json", json.dumps(state))
        self.work.drop(f"judged-{version}")
        self.work.drop(f"waiting-{version - 1}")
        return self.counts

    def _latest(self, batch: DataFrame) -> dt.datetime | None:
        """A time after all that was judged."""
        last = batch.agg(F.max("seen_at")).first()[0]
        return last + dt.timedelta(microseconds=1) if last else None

    def _log_findings(self, judged: DataFrame, version: int, since: dt.datetime | None, again: bool) -> None:
        """Append what is an orphan and was not, and, where something was judged again, what is none any more."""
        is_late = F.coalesce(F.col("seen_at") < instant(since), F.lit(False)) if since else F.lit(False)
        found = judged.where("kind = 'ref' and orphan").select(*_REF).distinct()
        if self.version:
            held = self.current()
            same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in _REF]
            rows = found.join(held, same(found, held), "left_anti").select(*_REF, F.lit(1).alias("sign"))
            if again:
                covered = judged.where("kind = 'ref' and not orphan").select(*_REF).distinct()
                rows = rows.unionByName(held.join(covered, same(held, covered), "left_semi").select(*_REF, F.lit(-1).alias("sign")))
        else:
            rows = found.withColumn("sign", F.lit(1))
        rows.withColumn("late", is_late).write.mode("overwrite").parquet(self.work.at(f"orphans/version={version}"))

    def _count(self, judged: DataFrame, version: int) -> None:
        """Carry the counts per key on: all that wait for a key are resolved or reopened in one row."""
        zero = F.lit(0).cast("long")
        found = self._log("orphans", _FOUND, f"version = {version}")
        now = judged.groupBy("key").agg(F.max("live").alias("live"))
        more = found.groupBy("key").agg(*(F.sum(F.when(F.col("side") == s, F.col("sign"))).cast("long").alias(s) for s in SIDES))
        empty = [zero.alias(f"was_{s}") for s in SIDES]
        rows = now.select("key", "live", *(zero.alias(s) for s in SIDES), F.lit(None).cast("long").alias("was_live"), *empty)
        rows = rows.unionByName(more.select("key", F.lit(None).cast("long").alias("live"), *(F.coalesce(s, zero).alias(s) for s in SIDES), F.lit(None).cast("long").alias("was_live"), *empty))
        if self.version:
            held = self.spark.read.schema(_WAITING).parquet(self.work.at(f"waiting-{self.version}"))
            rows = rows.unionByName(held.select("key", F.lit(None).cast("long").alias("live"), *SIDES, F.col("live").alias("was_live"), *(F.col(s).alias(f"was_{s}") for s in SIDES)))
        g = rows.groupBy("key").agg(F.max("live").alias("now"), F.max("was_live").alias("was_live"), *(F.sum(c).alias(c) for c in (*SIDES, *(f"was_{s}" for s in SIDES))))
        after = g.where("source + target + was_source + was_target > 0").select("key", F.coalesce("now", "was_live").alias("live"), *SIDES, "was_live", *(f"was_{s}" for s in SIDES))
        saved = self.work.save(after, f"waiting-{version}")
        sums = []
        for s in SIDES:
            n, was = F.col(s), F.col(f"was_{s}")
            open_, was_open = F.col("live") == 0, F.col("was_live") == 0
            sums += [F.sum(n), F.sum(F.when(open_, n)), F.sum(F.when(was_open & ~open_, was)), F.sum(F.when(~was_open & open_, was))]
        row = [int(v or 0) for v in saved.agg(*(x.alias(f"c{k}") for k, x in enumerate(sums))).first()]
        self.counts = [(s, *row[4 * k : 4 * k + 4]) for k, s in enumerate(SIDES)]

    def current(self) -> DataFrame:
        """The orphans as they stand: ``edge_id, side, key, seen_at``."""
        log = self._log("orphans", _FOUND, f"version <= {self.version}")
        if not self.taken_back:
            return log.select(*_REF)
        return log.groupBy(*_REF).agg(F.sum("sign").alias("n")).where("n > 0").select(*_REF)

    def late(self) -> DataFrame:
        """Orphans whose reference was made in a period that had been closed when it arrived."""
        return self._log("orphans", _FOUND, f"version <= {self.version}").where("late and sign > 0").select(*_REF)

    def waiting(self) -> DataFrame:
        """Keys with orphans and no live parent: ``key, source, target`` (numbers of orphans)."""
        return self.spark.read.schema(_WAITING).parquet(self.work.at(f"waiting-{self.version}")).where("live = 0 and source + target > 0").select("key", *SIDES)


def track(spark: SparkSession, nodes: DataFrame, edges: DataFrame, months: int = 3, salts: int | None = None, snapshots: list | None = None, arrival: str | None = "loaded_at", path: str | None = None) -> OrphanTracker:
    """Feed whole tables in the order of arrival, ``months`` months a batch.

    Each table is read once, into the logs by month; a batch then reads its own months only.
    ``snapshots`` collects the counts at the end of each period.
    """
    if arrival is not None and arrival not in edges.columns:
        arrival = None
    tracker = OrphanTracker(spark, path, salts)
    work = tracker.work
    arrivals(edges, arrival).write.mode("overwrite").partitionBy("slot").parquet(work.at("refs"))
    events = parent_events(nodes)
    events.withColumn("slot", month_of(F.col("ts"))).write.mode("overwrite").partitionBy("slot").parquet(work.at("index"))
    slots = sorted(int(name.split("=")[1]) for name in work.names("refs") if name.startswith("slot="))
    timed = [s for s in slots if s != NO_TIME]
    start = timed[0] if timed else 0
    ends = list(range(start + months, timed[-1] + 1, months)) if timed else []
    since = None
    for end in [*ends, None]:  # the last batch has all that is left
        until = month_start(end) if end else None
        counts = tracker.advance(end - 1 if end else NO_TIME, until, since)
        since = until
        if snapshots is not None:
            snapshots.append([(until, *c) for c in counts if c[1]])
    return tracker


def find_orphans(spark: SparkSession, nodes: DataFrame, edges: DataFrame, months: int = 3, salts: int | None = None) -> DataFrame:
    """References that no index row covered when they were made: ``edge_id``, ``side``.

    Defined cases: null and empty references never come out; a reference without a time is
    covered by nothing and comes out; an index row without ``indexed_at``, or removed no
    later than it arrived, covers nothing; repeated edge or index rows count once, in
    whatever batch they come; an edge without ``loaded_at`` arrives when it was seen; an empty
    index makes every reference an orphan; no edges give no rows; further columns of either
    table, whatever their names, are not read.
    """
    return track(spark, nodes, edges, months, salts).current().select("edge_id", "side").distinct()


def orphan_report(spark: SparkSession, nodes: DataFrame, edges: DataFrame, months: int = 3, salts: int | None = None) -> DataFrame:
    """Per side and month of ``seen_at``: orphans found, and those still waiting at the end."""
    tracker = track(spark, nodes, edges, months, salts)
    per_key = tracker.current().groupBy("key", "side", F.date_format("seen_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    met = per_key.join(tracker.waiting().select("key", F.lit(True).alias("open")), "key", "left")
    return met.groupBy("side", "month").agg(F.sum("n").alias("found"), F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0)).cast("long").alias("waiting"))


_SNAPSHOT = "period_end timestamp_ntz, side string, found long, waiting long, resolved long, reopened long"


def orphan_snapshots(spark: SparkSession, nodes: DataFrame, edges: DataFrame, months: int = 1, salts: int | None = None, arrival: str | None = None) -> DataFrame:
    """One row per period end and side: found so far, waiting, resolved and reopened in it.

    Periods are those of ``seen_at``, or, with ``arrival``, of the time that references came in.
    """
    rows: list = []
    track(spark, nodes, edges, months, salts, rows, arrival)
    return spark.createDataFrame([x for part in rows for x in part], _SNAPSHOT)


def late_orphans(spark: SparkSession, nodes: DataFrame, edges: DataFrame, months: int = 1) -> DataFrame:
    """Orphans that came in after the period of their ``seen_at`` was closed: ``edge_id, side``."""
    return track(spark, nodes, edges, months).late().select("edge_id", "side").distinct()
