"""Hubs of a relation that one task can hold: one for each part of it that hangs together.

Parts have no path between them, so one walk from all hubs finds what each of them reaches, and one
against the edges what reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.bitclosure import AT_ONCE

#: The largest parts that get a hub; the rest are walked.
MOST_HUBS = 1000

ROW = "frm long, nxt long, rank int, hub int, core int"


def around_hubs(edges: DataFrame, n_levels: int) -> DataFrame:
    """Of ``edges`` (``frm, nxt, rank``, in numbers) the nodes and the edges that hubs leave to be walked.

    A node is a row without ``nxt``: its part's ``hub`` (-1: none), the rank at which it reaches the hub (``rank``)
    and at which the hub reaches it (``core``); ``n_levels`` is never. An edge is left if its end is not reached
    at its rank, or its start does not reach the hub at it; ``hub`` and ``core`` are those of its end.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(parts)
        if sum(len(p) for p in held):
            yield from _around(held, n_levels)

    return edges.select("frm", "nxt", F.col("rank").cast("byte").alias("rank")).repartition(1).mapInArrow(run, ROW)


def _around(held: list[pa.RecordBatch], n_levels: int) -> Iterator[pa.RecordBatch]:
    """``held`` is emptied."""
    rows = pa.Table.from_batches(held)
    held.clear()
    a, b, rank = (rows.column(name).to_numpy() for name in ("frm", "nxt", "rank"))
    del rows
    names = np.union1d(np.unique(a), np.unique(b))
    a, b = (_among(names, ids) for ids in (a, b))
    n = len(names)
    hub, at = _hubs(a, b, n)
    core, before = _ranks(a, b, rank, at, n, n_levels), _ranks(b, a, rank, at, n, n_levels)
    for k in range(0, n, AT_ONCE):
        some = slice(k, k + AT_ONCE)
        yield _rows(names[some], None, before[some], hub[some], core[some])
    left = np.flatnonzero((core[b] > rank) | (before[a] > rank))
    for k in range(0, len(left), AT_ONCE):
        e = left[k : k + AT_ONCE]
        yield _rows(names[a[e]], names[b[e]], rank[e], hub[b[e]], core[b[e]])


def _rows(frm, nxt, rank, hub, core) -> pa.RecordBatch:
    ints = [pa.array(x.astype(np.int32)) for x in (rank, hub, core)]
    return pa.RecordBatch.from_arrays([pa.array(frm), pa.nulls(len(frm), pa.int64()) if nxt is None else pa.array(nxt), *ints], ["frm", "nxt", "rank", "hub", "core"])


def _among(names: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = np.empty(len(ids), np.int32)
    for k in range(0, len(ids), AT_ONCE):
        at[k : k + AT_ONCE] = np.searchsorted(names, ids[k : k + AT_ONCE])
    return at


def _hubs(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node the number of its hub, and the hubs: of each part the node with many edges on either side."""
    label = np.arange(n, dtype=np.int32)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    parts, part, size = np.unique(label, return_inverse=True, return_counts=True)
    number = np.full(len(parts), -1, np.int32)
    largest = np.argsort(-size, kind="stable")[:MOST_HUBS]
    number[largest] = np.arange(len(largest))
    order = np.lexsort((-np.minimum(np.bincount(a, minlength=n), np.bincount(b, minlength=n)), part))
    best = order[np.r_[0, np.cumsum(size)[:-1]]]
    return number[part], best[largest]


def _ranks(a: np.ndarray, b: np.ndarray, rank: np.ndarray, at: np.ndarray, n: int, n_levels: int) -> np.ndarray:
    """The rank at which each node is reached from ``at``."""
    order = np.argsort(a, kind="stable")
    to, rank = b[order], rank[order]
    first = np.r_[0, np.cumsum(np.bincount(a, minlength=n))]
    del order
    best = np.full(n, n_levels, np.int8)
    best[at] = 0
    for level in range(n_levels):
        fresh = np.flatnonzero(best <= level)  # what was reached before takes the edges of this level
        while len(fresh):
            many = first[fresh + 1] - first[fresh]
            ends = np.cumsum(many)
            edge = np.repeat((first[fresh] - (ends - many)).astype(np.int32), many) + np.arange(ends[-1], dtype=np.int32)
            met = to[edge[rank[edge] <= level]]
            fresh = np.unique(met[best[met] > level])
            best[fresh] = level
    return best
