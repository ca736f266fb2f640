"""Closures of many sources at once, with the sources as bits.

A node's state is a few machine words in which each bit stands for a source that reaches it.
The state lies in buckets by node and is never shuffled: a round sends only the bits that are
new along the edges, which lie in buckets too, and merges what arrives, combined by ``bit_or``
before the shuffle, with the state where it lies. Confidences are kept
by levels: the bits of level L are the sources that reach the node over edges of at least L,
hence a source's confidence is the highest level that holds its bit. Levels do not depend on
each other, so many of them are taken in groups; sources are taken in
batches of as many bits as keep the rows narrow. Groups and batches run side by side.

Rounds are for relations that no task can hold. One of at most ``HELD_EDGES`` edges, counted once
per batch of sources, goes to one task a batch as numbers, which walks it to its end in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.operators.skew import hot_keys, salt_of, salts_of
from ripplegraph.session import Workspace, default_parallelism, save_observed

#: Columns of words in a row; batches are cut so that levels times words stay within it.
MOST_WORDS = 32
#: Confidence levels in a row; more are walked in groups.
LEVELS_AT_ONCE = 8
#: Relations of more distinct confidences than that go through the general loop.
MOST_LEVELS = 64
#: Walks that run at the same time.
SIDE_BY_SIDE = 4
#: Edges, times batches of sources, that are walked in tasks that hold them; a task takes some 30 bytes an edge.
HELD_EDGES = 12_000_000
#: Bytes of a task's bits, and edges times words that it follows at once.
HELD_BITS, AT_ONCE = 64_000_000, 2_000_000


def positions(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``position``, dense from 0 in the order of the distinct ``key``, without one task's sort."""
    ordered = rows.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    ordered = Workspace(rows.sparkSession, "positions").save(ordered, "ordered")  # ranges are drawn anew each time
    within = ordered.withColumn("within", F.row_number().over(W.partitionBy("part").orderBy(key)) - 1)
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, before = [], 0
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offset = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return within.join(F.broadcast(offset), "part").select(key, (F.col("start") + F.col("within")).alias("position"))


def levels_of(relation: DataFrame) -> list[float] | None:
    """The distinct confidences of a relation, the highest first; None if they are too many."""
    rows = relation.where("ec is not null").select("ec").distinct().limit(MOST_LEVELS + 1).collect()
    found = sorted({r["ec"] for r in rows} | {1.0}, reverse=True)
    return found if len(found) <= MOST_LEVELS else None


def bit_closure(seeds: DataFrame, relation: DataFrame, levels: list[float], max_rounds: int | None = None) -> DataFrame:
    """``source_key, id, conf`` of everything ``seeds`` (``source_key, id``) reach.

    Defined cases: no seeds give no rows; seeds the relation does not know reach themselves;
    nulls are ignored; repeated seeds and edges count once. Rounds go on until nothing is
    fresh; a closure that needs more than ``max_rounds``, where given, is an error.
    """
    spark = seeds.sparkSession
    work, buckets = Workspace(spark, "bits"), default_parallelism(spark)
    clean = work.save(seeds.where("id is not null and source_key is not null").select("source_key", "id").distinct(), "seeds")
    keys = clean.select("source_key").distinct()
    total = keys.count()
    if not total:
        return clean.select("source_key", "id", F.lit(1.0).alias("conf"))
    # the relation may be long to make, and is read several times
    relation = work.save(relation.where("frm is not null and nxt is not null").select("frm", "nxt", "ec"), "given")
    if max_rounds is None and (words := held_words(relation.count(), total)):
        return _held(work, clean, relation, levels, words)
    if clean.schema["id"].dataType.typeName() == "long":  # buckets and salted names are of texts
        text = relation.select(F.col("frm").cast("string").alias("frm"), F.col("nxt").cast("string").alias("nxt"), "ec")
        return bit_closure(clean.select("source_key", F.col("id").cast("string").alias("id")), text, levels, max_rounds).withColumn("id", F.col("id").cast("long"))
    hot = hot_keys(relation.select("frm"))
    salt = salt_of(F.col("frm"), F.col("nxt"), hot, buckets)
    edges = relation.where("frm is not null and nxt is not null").select("frm", "nxt", "ec").distinct().select(slot_of(F.col("frm"), salt).alias("slot"), "nxt", "ec")
    edges = work.save_bucketed(edges, "relation", "slot", buckets)
    numbered = work.save(clean.join(positions(keys, "source_key"), "source_key"), "numbered")
    names = work.save(numbered.select("source_key", "position").distinct(), "names")
    walks = []
    for first in range(0, len(levels), LEVELS_AT_ONCE):
        some = levels[first : first + LEVELS_AT_ONCE]
        words = max(1, min(MOST_WORDS // len(some), -(-total // 64)))
        walks += [(some, words, batch) for batch in range(-(-total // (words * 64)))]

    def walk(k: int) -> DataFrame:
        some, words, batch = walks[k]
        mine = numbered.where(F.floor(F.col("position") / (words * 64)) == batch).withColumn("bit", (F.col("position") % (words * 64)).cast("int"))
        state = _walk(work, f"w{k}", mine, edges, hot, some, words, buckets, max_rounds)
        # packed, the state is small and lies in few files; unpacked, it is the size of the result
        return _unpack(state.repartition(buckets, "id"), some, words, batch * words * 64)

    try:
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            parts = list(pool.map(inheritable_thread_target(spark)(walk), range(len(walks))))
    finally:
        work.forget()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(levels) > LEVELS_AT_ONCE:
        found = found.groupBy("position", "id").agg(F.max("conf").alias("conf"))
    return found.join(names, "position").select("source_key", "id", "conf")


def held_words(n_edges: int, n_sources: int) -> int:
    """Words of sources in a batch with which a relation is walked in tasks that hold it; 0: it is too large."""
    words = max(1, min(-(-n_sources // 64), HELD_BITS // (8 * max(1, n_edges))))
    return words if n_edges * -(-n_sources // (words * 64)) <= HELD_EDGES else 0


def numbers(ids: DataFrame, work: Workspace) -> tuple[DataFrame, int]:
    """``id, n`` for the distinct ``id``, and the salt with which ``numbered`` gives each a number of its own."""
    known = work.save(ids.where("id is not null").distinct(), "ids")
    total = known.count()
    for salt in count():
        named = known.select("id", numbered(F.col("id"), salt).alias("n"))
        if named.select("n").distinct().count() == total:
            return named, salt


def numbered(key, salt: int):
    return F.xxhash64(key, F.lit(salt)) if salt else F.xxhash64(key)


def _held(work: Workspace, seeds: DataFrame, relation: DataFrame, levels: list[float], words: int) -> DataFrame:
    """The closure in one task a batch of sources; ids that are numbers already stay as they are."""
    edges, named = relation, None
    if seeds.schema["id"].dataType.typeName() != "long":
        both = edges.select(F.col("frm").alias("id")).unionByName(edges.select(F.col("nxt").alias("id"))).unionByName(seeds.select("id"))
        named, salt = numbers(both, work)
        edges = edges.select(numbered(F.col("frm"), salt).alias("frm"), numbered(F.col("nxt"), salt).alias("nxt"), "ec")
        seeds = seeds.select("source_key", numbered(F.col("id"), salt).alias("id"))
    placed = work.save(positions(seeds.select("source_key").distinct(), "source_key"), "places")
    none = [F.lit(-1).alias("hub"), F.lit(len(levels)).alias("core")]
    ahead = edges.select("frm", "nxt", rank_of(F.col("ec"), levels).alias("rank"), *none).where("rank is not null")
    starts = seeds.join(placed, "source_key").select("position", "id", F.lit(len(levels)).alias("rank"), *none)
    walked = held_walk(work, starts, ahead, len(levels), words, placed.count())
    work.drop("given")
    conf = F.element_at(F.array(*map(F.lit, levels)), F.col("rank") + 1)
    bits = walked.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b")).where("shiftright(bits, b) & 1L = 1L")
    found = bits.select((F.col("cell").cast("long") * 64 + F.col("b")).alias("position"), "id", conf.alias("conf"))
    found = found.join(placed, "position").select("source_key", "id", "conf")
    return found if named is None else found.join(named.withColumnsRenamed({"id": "name", "n": "id"}), "id").select("source_key", F.col("name").alias("id"), "conf")


def rank_of(ec, levels: list[float]):
    """The place of a confidence among the levels, 0 for null, which inherits."""
    rank = F.when(ec.isNull(), 0)
    for k, level in enumerate(levels):
        rank = rank.when(ec >= level, k)
    return rank


def held_walk(work: Workspace, starts: DataFrame, edges: DataFrame, n_levels: int, words: int, n_sources: int) -> DataFrame:
    """``id, rank, cell, bits``: sources ``64 * cell`` and on that reach a node first at the level ``rank``.

    ``starts`` are ``position, id, rank, hub, core`` and ``edges`` ``frm, nxt, rank, hub, core``, in numbers. Pairs are left
    out, and not walked on from, at levels from both the least ``rank`` of the source's starts at the node's ``hub`` and
    the ``core`` of the node (``id``, ``nxt``) on; ``n_levels`` is never, and -1 no hub.
    """
    width = words * 64
    n_batches = -(-n_sources // width)
    ahead = edges.select(F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))).alias("batch"), "frm", "nxt", "rank", F.col("hub").cast("short").alias("hub"), F.col("core").cast("byte").alias("core"), F.lit(None).cast("int").alias("bit"))
    first = starts.select(
        F.floor(F.col("position") / width).cast("int").alias("batch"),
        F.col("id").alias("frm"),
        F.lit(None).cast("long").alias("nxt"),
        "rank",
        F.col("hub").cast("short").alias("hub"),
        F.col("core").cast("byte").alias("core"),
        (F.col("position") % width).cast("int").alias("bit"),
    )
    rows = ahead.unionByName(first).repartitionById(n_batches, F.col("batch"))  # by hash, some tasks would get several
    walked = work.save(rows.mapInArrow(_walks(n_levels, words), "batch int, id long, rank int, word int, bits long"), "walked")
    return walked.select("id", "rank", (F.col("batch") * words + F.col("word")).alias("cell"), "bits")


def _walks(n_levels: int, words: int):
    """Walks the batches of a partition, one after the other: rows of edges, and of seeds with their bit."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        batch = None
        for part in parts:
            keys = part.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                if batch is not None and keys[a] != batch:
                    yield from _walk_held(batch, held, n_levels, words)
                    held = []
                batch = int(keys[a])
                held.append(part.slice(a, b - a))
        if batch is not None:
            yield from _walk_held(batch, held, n_levels, words)

    return run


def _strange(nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The distinct ``ids`` that are not among the sorted ``nodes``."""
    if not len(nodes):
        return np.unique(ids)
    return np.unique(ids[nodes[np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)] != ids])


def _place(nodes: np.ndarray, others: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where ``ids`` lie among ``nodes`` and, after them, ``others``; both are sorted."""
    at = np.searchsorted(nodes, ids)
    there = nodes[np.minimum(at, len(nodes) - 1)] == ids if len(nodes) else np.zeros(len(ids), bool)
    return np.where(there, at, len(nodes) + np.searchsorted(others, ids))


def _walk_held(batch: int, held: list[pa.RecordBatch], n_levels: int, words: int) -> Iterator[pa.RecordBatch]:
    """The bits that each node gains at each level, from the highest, but for those that are left out; ``held`` is emptied."""
    rows = pa.Table.from_batches(held)
    held.clear()
    is_seed = rows.column("nxt").is_null().to_numpy()
    seeds = rows.filter(pa.array(is_seed))
    edges = rows.filter(pa.array(~is_seed)).select(["frm", "nxt", "rank", "hub", "core"])
    del rows
    frm, rank = edges.column("frm").to_numpy(), edges.column("rank").to_numpy().astype(np.int8)
    order = np.argsort(frm)
    frm, rank = frm[order], rank[order]
    nxt, nxt_hub, nxt_core = (edges.column(name).to_numpy()[order] for name in ("nxt", "hub", "core"))
    del edges, order
    heads = np.flatnonzero(np.r_[True, frm[1:] != frm[:-1]]) if len(frm) else np.zeros(0, np.int64)
    nodes = frm[heads]
    first = np.r_[heads, len(frm)]
    del frm
    seed_ids = seeds.column("frm").to_numpy()
    others = np.unique(np.concatenate([np.zeros(0, np.int64), *(_strange(nodes, ids[a : a + AT_ONCE]) for ids in (nxt, seed_ids) for a in range(0, len(ids), AT_ONCE))]))
    target = np.empty(len(nxt), np.int32)
    for a in range(0, len(nxt), AT_ONCE):
        target[a : a + AT_ONCE] = _place(nodes, others, nxt[a : a + AT_ONCE])
    del nxt
    names = np.concatenate([nodes, others])
    state = np.zeros((len(names), words), np.uint64)
    bit, at_seed = seeds.column("bit").to_numpy().astype(np.uint64), _place(nodes, others, seed_ids)
    np.bitwise_or.at(state, (at_seed, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    hub, core = np.full(len(names), -1, np.int16), np.full(len(names), n_levels, np.int8)
    hub[target], core[target] = nxt_hub, nxt_core
    hub[at_seed], core[at_seed] = seeds.column("hub").to_numpy(), seeds.column("core").to_numpy()
    through = np.full((hub.max(initial=-1) + 2, words * 64), n_levels, np.int8)  # the last row is of no hub
    np.minimum.at(through, (hub[at_seed], bit.astype(np.int64)), seeds.column("rank").to_numpy().astype(np.int8))
    del nxt_hub, nxt_core, seeds, seed_ids, at_seed, bit
    before = np.zeros_like(state)
    for level in range(n_levels):
        walked, covered = ~np.packbits(through <= level, axis=1, bitorder="little").view(np.uint64), core <= level
        at = np.flatnonzero(covered)
        for a in range(0, len(at), AT_ONCE // words + 1):
            some = at[a : a + AT_ONCE // words + 1]
            state[some] &= walked[hub[some]]
        fresh, admitted = state, True  # what the higher levels reached takes the edges of this level first
        while True:
            after = np.zeros_like(state)
            at = np.flatnonzero(fresh[: len(nodes)].any(axis=1))
            many = first[at + 1] - first[at]
            upto = np.cumsum(many)
            cut = np.unique(np.searchsorted(upto, np.arange(0, upto[-1], max(1, AT_ONCE // words)), side="left")) if len(at) else []
            for a, b in zip(cut, [*cut[1:], len(at)], strict=False):
                n = many[a:b]
                ends = np.cumsum(n)
                edge = np.repeat(first[at[a:b]] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
                source = np.repeat(at[a:b], n)
                keep = rank[edge] == level if admitted else rank[edge] <= level
                edge, source = edge[keep], source[keep]
                if not len(edge):
                    continue
                to = target[edge]
                order = np.argsort(to, kind="stable")
                to = to[order]
                begin = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                came, to = np.bitwise_or.reduceat(fresh[source[order]], begin, axis=0), to[begin]
                some = covered[to]
                came[some] &= walked[hub[to[some]]]
                after[to] |= came & ~state[to]
                state[to] |= came
            fresh, admitted = after, False
            if not fresh.any():
                break
        del fresh, after
        np.bitwise_and(state, ~before, out=before)
        node, word = np.nonzero(before)
        gained = before[node, word].view(np.int64)
        np.copyto(before, state)
        for a in range(0, len(node), AT_ONCE):
            k = slice(a, a + AT_ONCE)
            n = len(node[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch, np.int32)), pa.array(names[node[k]]), pa.array(np.full(n, level, np.int32)), pa.array(word[k].astype(np.int32)), pa.array(gained[k])], ["batch", "id", "rank", "word", "bits"])


def slot_of(key, salt):
    """Where a node's edges lie: under its own name, or, for a hot node, under one name per salt."""
    return F.when(salt == 0, key).otherwise(F.concat(key, F.lit("\u0001"), salt.cast("string")))


def _walk(work: Workspace, name: str, seeds: DataFrame, edges: DataFrame, hot: list[str], levels: list[float], words: int, buckets: int, max_rounds: int | None) -> DataFrame:
    cells = [f"{k}_{w}" for k in range(len(levels)) for w in range(words)]
    level = {f"{k}_{w}": levels[k] for k in range(len(levels)) for w in range(words)}
    # whole expressions as text: rounds are many and short, and building columns one by one would rule them
    own = [F.expr(f"bit_or(case when floor(bit / 64) = {w} then shiftleft(1L, bit % 64) else 0L end) as s{w}") for w in range(words)]
    word = lambda c: f"s{c.split('_')[1]}"
    first = seeds.groupBy("id").agg(*own).selectExpr("id", *(f"{word(c)} as w{c}" for c in cells), *(f"{word(c)} as d{c}" for c in cells), "true as fresh")
    state = work.save_bucketed(first, f"{name}_0", "id", buckets)
    salts = salts_of(F.col("id"), hot, buckets)
    passed = [f"bit_or(case when ec is null or ec >= {level[c]!r}D then d{c} else 0L end) as c{c}" for c in cells]
    kept = [f"coalesce(w{c}, 0L) | coalesce(c{c}, 0L) as w{c}" for c in cells]
    new = [f"coalesce(c{c}, 0L) & ~coalesce(w{c}, 0L) as d{c}" for c in cells]
    fresh = " or ".join(f"coalesce(c{c}, 0L) & ~coalesce(w{c}, 0L) <> 0L" for c in cells)
    for k in count(1):
        if max_rounds is not None and k > max_rounds:
            raise RuntimeError(f"rows are still fresh after {max_rounds} rounds")
        ahead = state.where("fresh").select("id", *(f"d{c}" for c in cells))
        if hot:
            ahead = ahead.select("*", F.explode(salts).alias("salt")).withColumn("slot", slot_of(F.col("id"), F.col("salt")))
        else:  # the fresh rows lie as the edges do
            ahead = ahead.withColumnRenamed("id", "slot")
        found = ahead.join(edges, "slot").groupBy(F.col("nxt").alias("id")).agg(*map(F.expr, passed))
        after = state.select("id", *(f"w{c}" for c in cells)).join(found, "id", "full").selectExpr("id", *kept, *new, f"{fresh} as fresh")
        state, n_fresh = save_observed(work, after, f"{name}_{k}", "fresh", ("id", buckets))
        if k > 1:
            work.drop(f"{name}_{k - 2}")
        if not n_fresh:
            break
    return work.plain(f"{name}_{k}", state)


def _unpack(state: DataFrame, levels: list[float], words: int, base: int) -> DataFrame:
    """``position, id, conf`` of every set bit; the highest level that holds a bit counts."""
    rows = []
    for w in range(words):
        fields = [F.col(f"w{k}_{w}").alias(f"l{k}") for k in range(len(levels))]
        rows.append(F.struct(F.lit(w).alias("w"), *fields))
    wide = state.select("id", F.explode(F.array(*rows)).alias("r")).where(F.col(f"r.l{len(levels) - 1}") != 0)
    bits = wide.select("id", "r", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
    has = lambda k: F.call_function("shiftright", F.col(f"r.l{k}"), F.col("b")).bitwiseAND(F.lit(1).cast("long")) == 1
    conf = F.coalesce(*(F.when(has(k), F.lit(level)) for k, level in enumerate(levels)))
    return bits.select((F.lit(base) + F.col("r.w") * 64 + F.col("b")).cast("long").alias("position"), "id", conf.alias("conf")).where("conf is not null")
