"""What many sources reach, without a row per pair of them.

In a graph of code most sources reach one large core, and thereby the same nodes. A hub of it is
taken, and the closure is split exactly: a source that reaches the hub reaches all that the hub
reaches; only what it reaches beyond is walked for it, on the few edges that do not end in that
part, and a source that does not reach the hub never meets an edge of those that do. Sums,
differences and lookups then work on the parts. Any hub is right; a central one leaves less to walk.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators import bitclosure
from ripplegraph.operators.bitclosure import bit_closure, held_walk, numbered, numbers, positions, rank_of
from ripplegraph.operators.hubs import around_hubs
from ripplegraph.session import Workspace, default_parallelism

#: Rows of a product that one task writes.
ROWS_A_TASK = 4_000_000
#: Sources, times hubs that they reach, that are sent to each executor.
MOST_SENT = 200_000
#: Edges, times batches of sources, that are sent to the tasks of one walk.
SENT_EDGES = 120_000_000


@dataclass
class Reach:
    """``pairs`` (``source_key, id``) and every pair of ``through`` (``source_key``) with ``core`` (``id``).

    No pair is in both, none is there twice.
    """

    pairs: DataFrame
    through: DataFrame
    core: DataFrame

    def rows(self) -> DataFrame:
        """All pairs: ``source_key, id``."""
        return self.pairs.select("source_key", "id").unionByName(product(self.through, self.core))

    def counts(self) -> DataFrame:
        """``id, n``: the sources that reach each node."""
        n_through = self.through.count()
        few = self.pairs.select("id", F.lit(1).cast("long").alias("n"))
        return few.unionByName(self.core.select("id", F.lit(n_through).cast("long").alias("n")).where("n > 0")).groupBy("id").agg(F.sum("n").alias("n"))

    def sizes(self, marked: DataFrame | None = None) -> DataFrame:
        """Per source the nodes it reaches, and how many of them are in ``marked`` (``id``): ``source_key, overlap, size``."""
        mark = lambda df: df.join(marked.select("id", F.lit(True).alias("marked")), "id", "left") if marked is not None else df.withColumn("marked", F.lit(None).cast("boolean"))
        n = [F.count("marked").alias("overlap"), F.count(F.lit(1)).alias("size")]
        whole = self.through.crossJoin(F.broadcast(mark(self.core).agg(*n)))
        parts = mark(self.pairs).groupBy("source_key").agg(*n).unionByName(whole.select("source_key", "overlap", "size"))
        return parts.groupBy("source_key").agg(F.sum("overlap").alias("overlap"), F.sum("size").alias("size")).where("size > 0")

    def without(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (``source_key, id``) that are not reached."""
        rest = pairs.join(self.pairs.select("source_key", "id"), ["source_key", "id"], "left_anti")
        rest = rest.join(self.through.select("source_key", F.lit(True).alias("goes")), "source_key", "left").join(self.core.select("id", F.lit(True).alias("held")), "id", "left")
        return rest.where("goes is null or held is null").select("source_key", "id")

    def lost_in(self, other: Reach) -> DataFrame:
        """Pairs that are no longer there in ``other``, made by the same hub on fewer edges: ``source_key, id``."""
        kept = self.through.join(other.through, "source_key", "left_semi")
        gone = self.through.join(other.through, "source_key", "left_anti")
        hub_lost = product(kept, self.core.join(other.core, "id", "left_anti")).unionByName(product(gone, self.core))
        return hub_lost.unionByName(self.pairs.select("source_key", "id")).join(other.pairs.select("source_key", "id"), ["source_key", "id"], "left_anti")


def product(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every source with every node: ``source_key, id``, the nodes spread so that tasks write alike."""
    n_tasks = max(default_parallelism(nodes.sparkSession), -(-sources.count() * nodes.count() // ROWS_A_TASK))
    return nodes.select("id").repartition(n_tasks, "id").crossJoin(F.broadcast(sources.select("source_key"))).select("source_key", "id")


def reaches(starts: DataFrame, relation: DataFrame, *others: DataFrame) -> list[Reach]:
    """The split closure of ``starts`` (``source_key, id``) over ``relation``, and over each of ``others``
    (``frm, nxt``, parts of ``relation``), all by one hub."""
    spark = starts.sparkSession
    work = Workspace(spark, "reach")
    starts = starts.where("id is not null and source_key is not null").select("source_key", "id").distinct()
    starts = work.save(starts, "starts")
    whole = relation.where("frm is not null and nxt is not null").select("frm", "nxt")
    named, salt = numbers(whole.select(F.col("frm").alias("id")).unionByName(whole.select(F.col("nxt").alias("id"))).unionByName(starts.select("id")), work)
    first = work.save(starts.select("source_key", numbered(F.col("id"), salt).alias("id")), "first")
    decode = lambda df, *columns: df.join(named.select(F.col("id").alias("name"), F.col("n").alias("id")), "id").select(*columns, F.col("name").alias("id"))
    found: list[Reach] = []
    hub = None
    for k, some in enumerate([whole, *others]):
        edges = some.where("frm is not null and nxt is not null").select(numbered(F.col("frm"), salt).alias("frm"), numbered(F.col("nxt"), salt).alias("nxt"), F.lit(None).cast("double").alias("ec"))
        edges = work.save(edges, f"edges_{k}")
        hub = hub if k else central(edges)
        parts = _split(work, k, first, edges, hub)
        found.append(Reach(work.save(decode(parts.pairs, "source_key"), f"pairs_{k}"), parts.through, work.save(decode(parts.core), f"core_{k}")))
        work.drop(f"edges_{k}")
    return found


def central(edges: DataFrame) -> int | None:
    """A node with many edges on either side."""
    ends = edges.select(F.col("frm").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("nxt").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    row = ends.groupBy("id").agg(F.least(F.sum("o"), F.sum("i")).alias("n")).orderBy(F.desc("n"), "id").limit(1).collect()
    return row[0]["id"] if row else None


def widest_rows(starts: DataFrame, relation: DataFrame, levels: list[float], shown: DataFrame) -> DataFrame:
    """``source_key, id, conf``: the widest confidence with which ``starts`` (``source_key, id``) reach the ``shown`` (``id``).

    The split holds at each level: a source that reaches a hub with one confidence reaches what the hub reaches
    with another at the lesser of the two, if not better. Only what is better is walked, and kept as bits that take
    these pairs out of the product. Work goes with the edges and the rows of the result, which may be sources times nodes.
    """
    spark = starts.sparkSession
    work, never = Workspace(spark, "widest"), len(levels)
    starts = starts.where("id is not null and source_key is not null").select("source_key", "id")
    whole = relation.where("frm is not null and nxt is not null").select("frm", "nxt", "ec")
    places = work.save(positions(starts.select("source_key").distinct(), "source_key"), "places")
    n_sources, n_edges = places.count(), whole.count()
    if not n_sources:
        return starts.withColumn("conf", F.lit(1.0))
    named, salt = numbers(whole.select(F.col("frm").alias("id")).unionByName(whole.select(F.col("nxt").alias("id"))).unionByName(starts.select("id")), work)
    all_walked = lambda: bit_closure(starts, whole, levels).join(shown.select("id"), "id", "left_semi").select("source_key", "id", "conf")
    if n_edges > bitclosure.HELD_EDGES:
        return all_walked()
    edges = whole.select(numbered(F.col("frm"), salt).alias("frm"), numbered(F.col("nxt"), salt).alias("nxt"), rank_of(F.col("ec"), levels).alias("rank")).where("rank is not null")
    around = work.save(around_hubs(edges, never), "around")
    nodes, left = around.where("nxt is null").select(F.col("frm").alias("id"), "rank", "hub", "core"), around.where("nxt is not null")
    words = _words(named.count(), n_sources, spark.sparkContext.defaultParallelism)
    if left.count() * -(-n_sources // (64 * words)) > SENT_EDGES:
        return all_walked()
    first = starts.select("source_key", numbered(F.col("id"), salt).alias("id")).join(F.broadcast(places), "source_key").join(nodes, "id", "left")
    first = work.save(first.select("position", "id", F.coalesce("rank", F.lit(never)).alias("rank"), F.coalesce("hub", F.lit(-1)).alias("hub"), F.coalesce("core", F.lit(never)).alias("core")), "first")
    better = held_walk(work, first, left, never, words, n_sources)
    conf = F.element_at(F.array(*map(F.lit, levels)), F.col("rank") + 1).alias("conf")
    names = work.save(named.join(shown.select("id"), "id", "left_semi").select(F.col("id").alias("name"), F.col("n").alias("id")), "names")
    # sources lie by the word of their bits, so that a row costs one look at it
    source = places.select("position", F.floor(F.col("position") / 64).cast("int").alias("cell"), (F.col("position") % 64).cast("int").alias("bit"), "source_key")
    listed = source.groupBy("cell").agg(F.collect_list(F.struct("bit", "source_key")).alias("sources"))
    bits = better.join(names, "id").select("name", "cell", "bits", conf)
    bits = bits.repartition(_tasks(spark, better.agg(F.sum(F.bit_count("bits")).alias("n")).collect()[0]["n"] or 0))
    pairs = bits.join(F.broadcast(listed), "cell").select("name", "bits", "conf", F.inline("sources")).where("shiftright(bits, bit) & 1L = 1L").select("source_key", F.col("name").alias("id"), "conf")
    through = work.save(first.where(F.col("rank") < never).groupBy("position", "hub").agg(F.min("rank").alias("rank")), "through")
    inner = nodes.where(F.col("core") < never).select("id", "hub", F.col("core").alias("rank")).join(names, "id")
    taken = better.repartition("id").groupBy("id", "cell").agg(F.expr("bit_or(bits)").alias("bits")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "bits"))).alias("taken"))
    inner = work.save(inner.join(taken, "id", "left").select("name", "hub", conf, "taken"), "inner")
    n_rows = inner.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).join(through.groupBy("hub").agg(F.count(F.lit(1)).alias("m")), "hub").agg(F.sum(F.col("n") * F.col("m")).alias("n")).collect()[0]["n"]
    met = through.join(F.broadcast(source), "position").groupBy("hub", "cell").agg(F.collect_list(F.struct("bit", "source_key", conf.alias("source_conf"))).alias("sources"))
    cells = inner.repartition(_tasks(spark, n_rows or 0), "name").select("name", "hub", "conf", "taken", F.explode(F.sequence(F.lit(0), F.lit((n_sources - 1) // 64))).alias("cell"))
    cells = cells.select("name", "hub", "conf", "cell", F.coalesce(F.try_element_at("taken", F.col("cell")), F.lit(0).cast("long")).alias("bits"))
    rest = cells.join(F.broadcast(met) if through.count() <= MOST_SENT else met, ["hub", "cell"]).select("name", "bits", "conf", F.inline("sources"))
    rest = rest.where("shiftright(bits, bit) & 1L = 0L").select("source_key", F.col("name").alias("id"), F.least("conf", "source_conf").alias("conf"))
    return pairs.unionByName(rest)


def _tasks(spark, n_rows: int) -> int:
    return max(default_parallelism(spark), -(-n_rows // ROWS_A_TASK))


def _words(n_nodes: int, n_sources: int, tasks: int) -> int:
    """Words of sources in a batch of a walk, so that its bits are held and all tasks have a batch."""
    return max(1, min(-(-n_sources // (64 * tasks)), bitclosure.HELD_BITS // (16 * max(1, n_nodes))))


def _split(work: Workspace, k: int, starts: DataFrame, edges: DataFrame, hub: int | None) -> Reach:
    """The parts in numbers."""
    spark = work.spark
    at = spark.createDataFrame([(0, hub)] if hub is not None else [], "source_key int, id long")
    back = edges.select(F.col("nxt").alias("frm"), F.col("frm").alias("nxt"), "ec")
    core, before = _both(spark, lambda: work.save(bit_closure(at, edges, [1.0]).select("id"), f"after_{k}"), lambda: work.save(bit_closure(at, back, [1.0]).select("id"), f"before_{k}"))
    through = work.save(starts.join(before, "id", "left_semi").select("source_key").distinct(), f"through_{k}")
    if through.isEmpty():
        core = core.limit(0)
    beyond = edges.join(core.select(F.col("id").alias("nxt")), "nxt", "left_anti")
    apart = edges.join(before.select(F.col("id").alias("frm")), "frm", "left_anti")
    more, rest = _both(
        spark,
        lambda: bit_closure(starts.join(through, "source_key", "left_semi").join(core, "id", "left_anti"), beyond, [1.0]),
        lambda: bit_closure(starts.join(through, "source_key", "left_anti"), apart, [1.0]),
    )
    return Reach(more.unionByName(rest).select("source_key", "id"), through, core)


def _both(spark, *makes):
    """Side by side."""
    with ThreadPoolExecutor(len(makes)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda make: make()), makes))
