"""Per-key counts in dense accumulator arrays, with the work spread evenly.

The rows are cut into equal splits by a hash of their identifier, so no split depends on
how often a key occurs. Each split dictionary-encodes the keys it meets and counts them with
``numpy.bincount`` into a dense array; the arrays are cut into blocks by key hash, and
equal blocks of all splits are added up by scatter-add in a second, distributed step. A key
that holds a third of all rows costs one array cell per split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegraph.session import default_parallelism

#: A split hands its arrays on when its dictionary has grown to this many keys.
FLUSH_KEYS = 500_000
#: Cells in one emitted block row, so that no Arrow value grows without bound.
CHUNK = 65_536
#: Keys that one task of the second step adds up, about.
BLOCK_KEYS = 500_000


class _Dense:
    """Growing dictionary of composite keys with one dense counter array."""

    def __init__(self) -> None:
        self.codes: dict[tuple, int] = {}
        self.counts = np.zeros(1024, dtype=np.int64)

    def add(self, columns: list[pa.Array], weights: np.ndarray | None) -> None:
        n, mixed, dictionaries = len(columns[0]), None, []
        for column in columns:
            encoded = column.dictionary_encode(null_encoding="encode")
            codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            dictionaries.append(encoded.dictionary.to_pylist())
            mixed = codes if mixed is None else mixed * len(dictionaries[-1]) + codes
        if not n:
            return
        distinct, inverse = np.unique(mixed, return_inverse=True)
        parts, rest = [], distinct
        for values in reversed(dictionaries):
            rest, code = np.divmod(rest, len(values))
            parts.append([values[i] for i in code])
        get = self.codes.setdefault
        local = np.fromiter((get(k, len(self.codes)) for k in zip(*reversed(parts))), dtype=np.int64, count=len(distinct))
        if len(self.codes) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(max(len(self.counts), len(self.codes)), dtype=np.int64)])
        if weights is None:
            self.counts[local] += np.bincount(inverse, minlength=len(distinct))
        else:
            np.add.at(self.counts, local[inverse], weights)


def _as_arrow(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "timestamp": pa.timestamp("us", "UTC")}[kind.simpleString()]


def dense_counts(df: DataFrame, keys: list[str], distinct: list[str], count: str = "n", blocks: int | None = None) -> DataFrame:
    """Number of distinct ``distinct`` combinations per combination of ``keys``.

    Defined cases: null is a key like any other; rows whose ``distinct`` columns are all
    null still count as one combination; an empty input gives no rows; other columns are
    not read. ``blocks`` follows the number of keys, at least ``spark.sql.shuffle.partitions``;
    every block is one task of the second step.
    """
    if blocks is None:
        held = df.select(F.approx_count_distinct(F.struct(*keys)).alias("n")).first()["n"]
        blocks = max(default_parallelism(df.sparkSession), -(-held // BLOCK_KEYS))
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *(F.col(d).alias(f"d{i}") for i, d in enumerate(distinct))).distinct()
    rows = rows.select(*names, F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int").alias("block"))
    arrow = [_as_arrow(rows.schema[n].dataType) for n in names]
    array_schema = T.StructType([T.StructField("block", T.IntegerType()), *(T.StructField(n, T.ArrayType(rows.schema[n].dataType)) for n in names), T.StructField("cells", T.ArrayType(T.LongType()))])

    def emit(dense: _Dense) -> Iterator[pa.RecordBatch]:
        items, size = list(dense.codes), len(dense.codes)
        block = np.fromiter((k[0] for k in items), dtype=np.int32, count=size)
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        out: list[tuple] = []
        for part in np.split(order, cuts):
            for at in range(0, len(part), CHUNK):
                out.append((int(block[part[0]]), part[at : at + CHUNK]))
        for at in range(0, len(out), 64):
            some = out[at : at + 64]
            columns = [pa.array([b for b, _ in some], pa.int32())]
            for i, kind in enumerate(arrow):
                columns.append(pa.array([[items[j][i + 1] for j in p] for _, p in some], pa.list_(kind)))
            columns.append(pa.array([dense.counts[p] for _, p in some], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["block", *names, "cells"])

    def count_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _Dense()
        for batch in batches:
            dense.add([batch.column("block"), *(batch.column(n) for n in names)], None)
            if len(dense.codes) >= FLUSH_KEYS:
                yield from emit(dense)
                dense = _Dense()
        if dense.codes:
            yield from emit(dense)

    def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _Dense()
        for batch in batches:
            cells = batch.column("cells").flatten().to_numpy(zero_copy_only=False)
            dense.add([batch.column(n).flatten() for n in names], cells)
        items = list(dense.codes)
        for at in range(0, len(items), CHUNK):
            some = items[at : at + CHUNK]
            columns = [pa.array([k[i] for k in some], kind) for i, kind in enumerate(arrow)]
            columns.append(pa.array(dense.counts[at : at + len(some)], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "cells"])

    arrays = rows.mapInArrow(count_split, array_schema)
    total_schema = T.StructType([*(T.StructField(n, rows.schema[n].dataType) for n in names), T.StructField("cells", T.LongType())])
    total = arrays.repartitionById(blocks, F.col("block")).mapInArrow(add_blocks, total_schema)
    return total.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), F.col("cells").alias(count))


#: Edge kinds that count as fan-in.
FAN_IN_KINDS = ["calls", "imports", "references", "instantiates"]


def fan_in(edges: DataFrame) -> DataFrame:
    """Distinct incoming edges per symbol and index run: ``index_run, target, fan_in``."""
    counted = edges.where(F.col("kind").isin(FAN_IN_KINDS) & F.col("target").isNotNull() & F.col("index_run").isNotNull())
    return dense_counts(counted, ["index_run", "target"], ["id"], "fan_in")


def wrong_fan_in(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose recorded ``fan_in`` differs from the counted one (0 if none).

    Defined cases: a null ``fan_in`` never comes out; a candidate with null ``index_run`` or
    ``node_id`` has a counted fan-in of 0; repeated candidate rows come out once.
    """
    counted = fan_in(edges).select(F.col("index_run").alias("run"), "target", F.col("fan_in").alias("counted"))
    recorded = candidates.where(F.col("fan_in").isNotNull()).select("candidate_id", "index_run", "node_id", "fan_in").distinct()
    on = (recorded["index_run"] == counted["run"]) & (recorded["node_id"] == counted["target"])
    return recorded.join(counted, on, "left").where(F.col("fan_in") != F.coalesce("counted", F.lit(0))).select("candidate_id").distinct()
