"""Frequency of every distinct term: occurrences, records, and a mark on useless terms.

Tokens are hash-partitioned and ordered by record. Each task walks its tokens once and
keeps, per term, three counters in dense arrays: occurrences, records, and the last record
that held the term. A record is counted when it differs from the last one seen, so no term
needs a set of its records. Tokens are partitioned by term *and* record: a term that occurs
everywhere is spread over all tasks like any other rows, and as a record's tokens of one
term stay together, the tasks' counters simply add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A task hands its counters on when it has met this many terms.
FLUSH_TERMS = 1_000_000
_COUNTS = pa.schema([("token", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


class LastSeen:
    """Occurrences, records and last record per term; records must come in order."""

    def __init__(self) -> None:
        self.terms: dict[str, int] = {}
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)
        self.last = np.full(1024, -1, np.int64)
        self.ordinal, self.record = -1, None

    def _grow(self) -> None:
        if len(self.terms) > len(self.last):
            more = max(len(self.last), len(self.terms))
            self.occurrences = np.concatenate([self.occurrences, np.zeros(more, np.int64)])
            self.records = np.concatenate([self.records, np.zeros(more, np.int64)])
            self.last = np.concatenate([self.last, np.full(more, -1, np.int64)])

    def add(self, terms: pa.Array, records: pa.Array, times: np.ndarray) -> None:
        if not len(terms):
            return
        encoded = records.dictionary_encode()
        ordinal = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = encoded.dictionary[0].as_py()
        ordinal += self.ordinal if first == self.record and self.ordinal >= 0 else self.ordinal + 1
        self.ordinal, self.record = int(ordinal[-1]), encoded.dictionary[-1].as_py()
        encoded = terms.dictionary_encode()
        get = self.terms.setdefault
        codes = np.fromiter((get(t, len(self.terms)) for t in encoded.dictionary.to_pylist()), np.int64, len(encoded.dictionary))
        self._grow()
        code = codes[encoded.indices.to_numpy(zero_copy_only=False)]
        np.add.at(self.occurrences, code, times)
        order = np.lexsort((ordinal, code))
        code, ordinal = code[order], ordinal[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (ordinal[1:] != ordinal[:-1])
        code, ordinal = code[new], ordinal[new]
        np.add.at(self.records, code[self.last[code] != ordinal], 1)
        np.maximum.at(self.last, code, ordinal)

    def take(self) -> Iterator[pa.RecordBatch]:
        """The counters so far; what is left only remembers the terms of the last record."""
        terms = list(self.terms)
        for at in range(0, len(terms), 100_000):
            end = min(at + 100_000, len(terms))
            yield pa.RecordBatch.from_arrays([pa.array(terms[at:end], pa.string()), pa.array(self.occurrences[at:end]), pa.array(self.records[at:end])], schema=_COUNTS)
        kept = [t for t, i in self.terms.items() if self.last[i] == self.ordinal]
        ordinal, record = self.ordinal, self.record
        self.__init__()
        self.ordinal, self.record = ordinal, record
        self.terms = {t: i for i, t in enumerate(kept)}
        self._grow()
        self.last[: len(kept)] = ordinal


def count_tokens(tokens: DataFrame) -> DataFrame:
    """``token, occurrences, records`` of a table ``token, record, times``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = LastSeen()
        for batch in batches:
            seen.add(batch.column("token"), batch.column("record"), batch.column("times").to_numpy(zero_copy_only=False))
            if len(seen.terms) >= FLUSH_TERMS:
                yield from seen.take()
        yield from seen.take()

    spread = tokens.select("token", "record", "times").repartition(F.col("token"), F.col("record")).sortWithinPartitions("record")
    parts = spread.mapInArrow(walk, "token string, occurrences long, records long")
    return parts.groupBy("token").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("records > 0")


def words_of(text: Column) -> Column:
    """Longest runs of a-z and digits in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def value_of(text: Column) -> Column:
    """The lower-cased value without outer blanks, as a list of at most one."""
    trimmed = F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(trimmed) > 0, F.array(trimmed)).otherwise(F.array().cast("array<string>"))


def term_statistics(rows: DataFrame, key: str, fields: dict[str, Column], rare: int = 2, common: float = 0.05) -> DataFrame:
    """Per field and term: ``occurrences``, ``records`` and ``mark``.

    ``fields`` maps a field's name to the array of terms a row holds in it. A record is a
    distinct, non-null ``key``; equal values of a field that a record holds in several rows
    are one delivery of the same value and count once. ``mark`` is 'rare' for terms in at
    most ``rare`` records, 'common' for those in more than ``common`` of all records, null
    otherwise; where both hold (tiny inputs), 'rare' wins. Null and blank values have no
    terms; an empty table gives no rows.
    """
    total = rows.select(key).where(F.col(key).isNotNull()).distinct().count()
    parts = None
    for name, terms in fields.items():
        values = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("record"), terms.alias("terms")).distinct()
        tokens = values.select(F.explode("terms").alias("term"), "record").select(F.concat(F.lit(f"{name}:"), "term").alias("token"), "record", F.lit(1).cast("long").alias("times"))
        parts = tokens if parts is None else parts.unionByName(tokens)
    counted = count_tokens(parts)
    field = F.substring_index("token", ":", 1)
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common * total), "common")
    return counted.select(field.alias("field"), F.expr("substring(token, instr(token, ':') + 1)").alias("term"), "occurrences", "records", mark.alias("mark"))


def symbol_terms(nodes: DataFrame) -> DataFrame:
    """Statistics of the words in ``name`` and the values of ``kind``."""
    return term_statistics(nodes, "id", {"name": words_of(F.col("name")), "kind": value_of(F.col("kind"))})
