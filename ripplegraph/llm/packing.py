"""Filling fixed-capacity windows with documents: sum-of-squares online packing.

Every input split is packed where it lies, in one pass and without a shuffle. A level array
counts the partially filled windows per fill level; a document goes to the level that makes
the sum of squares of those counts smallest (of equal ones, the fullest), which keeps a
window of every useful fill at hand. A window leaves the task as soon as it is full. The
windows still open when the split ends are few; the documents in them are packed once more,
longest first into the fullest window that takes them, so a split ends with at most a
window or two of room.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizer's ranks lie on the driver, and the pattern that splits text before merging.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048

_PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("window", pa.string()), ("offset", pa.int32()), ("n_tokens", pa.int32())])
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per worker process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(text: str | None, path: str = TOKENIZER) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def ship(spark: SparkSession, path: str) -> str:
    """Send the rank file to all executors, once; returns the name it goes by there."""
    context, name = spark.sparkContext, os.path.basename(path)
    if name not in (sent := getattr(context, "_tokenizers_sent", set())):
        context.addFile(path)
        context._tokenizers_sent = sent | {name}
    return name


class SumOfSquares:
    """Open windows by fill level; ``place`` returns a window that has become full, if any.

    A window is ``[fill, (item, size), ...]``.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, item, size: int) -> list | None:
        if size >= self.capacity:
            return [size, (item, size)]
        top = self.capacity - size
        # change of the sum of squares, halved and less a constant, for a move from level h to h + size
        change = self.level[size:] - self.level[: top + 1]
        change[-1] = -self.level[top]  # a full window is no partially filled one
        change[1:][self.level[1 : top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = self.level[size]  # a new window
        at = top - int(np.argmin(change[::-1]))  # the fullest of equals
        if at:
            window = self.open[at].pop()
            self.level[at] -= 1
        else:
            window = [0]
        window[0] += size
        window.append((item, size))
        if window[0] == self.capacity:
            return window
        self.level[window[0]] += 1
        self.open.setdefault(window[0], []).append(window)
        return None

    def close(self) -> list[list]:
        """Pack the items of all open windows again, longest first, best fit."""
        items = sorted((x for windows in self.open.values() for w in windows for x in w[1:]), key=lambda x: -x[1])
        fills: list[int] = []
        windows: list[list] = []
        for item, size in items:
            at = bisect.bisect_right(fills, self.capacity - size) - 1
            if at < 0:
                window = [0]
            else:
                fills.pop(at)
                window = windows.pop(at)
            window[0] += size
            window.append((item, size))
            at = bisect.bisect_left(fills, window[0])
            fills.insert(at, window[0])
            windows.insert(at, window)
        self.__init__(self.capacity)
        return windows


def pieces(size: int, capacity: int) -> list[int]:
    """A document as it is, or, only if it is longer than a window, full windows and a rest."""
    if size <= capacity:
        return [size]
    full, rest = divmod(size, capacity)
    return [capacity] * full + ([rest] if rest else [])


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Put every document into a window of ``capacity`` tokens.

    One row per document, ``doc_id, piece, window, offset, n_tokens``; documents longer
    than a window give one row per piece, numbered from 0, all but the last filling a window.
    Defined cases: null and empty texts have 0 tokens and come out in a window of their
    split that takes no room for them; repeated ``key`` values are packed once per row; no
    document is ever split unless it exceeds the capacity; an empty table gives no rows. The rank
    file ``tokenizer`` need lie on the driver only.
    """
    shipped = ship(documents.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, count = TaskContext.get(), 0
        split = context.partitionId() if context else 0
        packer, rows, empty = SumOfSquares(capacity), [], []
        encode = encoder(SparkFiles.get(shipped)).encode_ordinary

        def put(window: list) -> None:
            nonlocal count
            at = 0
            for (doc, piece), size in window[1:]:
                rows.append((doc, piece, f"{split}-{count}", at, size))
                at += size
            count += 1

        def out() -> pa.RecordBatch:
            arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows), _PACKED.types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=_PACKED)

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(encode(body)) if body else 0
                if not size:
                    empty.append(doc)
                    continue
                for piece, part in enumerate(pieces(size, capacity)):
                    if full := packer.place((doc, piece), part):
                        put(full)
            if len(rows) >= 5_000:
                yield out()
            if len(empty) >= 5_000:
                rows.extend((doc, 0, f"{split}-0", 0, 0) for doc in empty)
                empty.clear()
        for window in packer.close():
            put(window)
        rows.extend((doc, 0, f"{split}-0", 0, 0) for doc in empty)
        if rows:
            yield out()

    return documents.select(documents[key].cast("long").alias("doc_id"), documents[text].alias("text")).mapInArrow(run, "doc_id long, piece int, window string, offset int, n_tokens int")


def packing_faults(packed: DataFrame, capacity: int = CAPACITY, least: float = 0.98) -> DataFrame:
    """One row of what must hold of any packing, counted where it does not.

    ``placed`` documents; windows ``over_capacity``; documents ``split_needlessly`` (in several pieces
    although they fit); pieces ``not_full`` before a document's last; windows with ``gaps`` or
    overlaps between their documents; and whether windows are ``well_filled`` on the whole.
    """
    windows = packed.where("n_tokens > 0").groupBy("window").agg(F.sum("n_tokens").alias("used"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"), F.count_distinct("offset").alias("starts"), F.count(F.lit(1)).alias("items"))
    over = windows.agg(F.count_if(F.col("used") > capacity).alias("over_capacity"), F.count_if((F.col("used") != F.col("end")) | (F.col("starts") != F.col("items"))).alias("gaps"), (F.coalesce(F.avg("used"), F.lit(capacity)) >= least * capacity).alias("well_filled"))
    documents = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") < capacity).alias("short"))
    split = documents.agg(F.count(F.lit(1)).alias("placed"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).alias("split_needlessly"), F.coalesce(F.sum(F.when(F.col("pieces") > 1, F.greatest(F.col("short") - 1, F.lit(0)))), F.lit(0)).cast("long").alias("not_full"))
    return split.withColumn("one", F.lit(1)).join(F.broadcast(over.withColumn("one", F.lit(1))), "one").drop("one")
