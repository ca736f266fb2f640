"""Evaluation passages in training text: pigeonhole edit matching.

Text is compared as words: compatibility form, accents, letter case and invisible format
characters are folded away first. Every test item is cut into adjacent pieces of
``min_words // (budget + 2)`` words, so that any passage of ``min_words`` words of the item
holds at least ``budget + 1`` whole pieces: with up to ``budget`` edits, one piece is still
intact. An Aho-Corasick automaton over all pieces finds the exact piece hits in one pass
over a document; around each hit, Myers' bit-parallel distance (over words) verifies the
passage; of the passages it lets through, the longest run of equal words is measured.

The test items are a stated, bounded set. Their pieces go to the executors in blocks of about
``BLOCK_BYTES`` of text. A larger set is searched block by block, each against all documents; the
driver holds one block at a time, as a block's findings are written before the next is read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.session import Workspace

BLOCK_BYTES = 16_000_000
_MARKS = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
_BREAKS = regex.compile(r"[^\p{L}\p{N}]+")
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("run", pa.int32()), ("distance", pa.int32())])


def words(text: str) -> list[str]:
    """Folded words of a text: its longest runs of letters and digits."""
    if text.isascii():
        return text.encode("ascii").translate(_ASCII).decode("ascii").split()
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _BREAKS.sub(" ", text).split()


def myers(pattern: list, text: list) -> int:
    """Least edit distance between ``pattern`` and any part of ``text``, bit-parallel."""
    m = len(pattern)
    peq: dict = {}
    for i, symbol in enumerate(pattern):
        peq[symbol] = peq.get(symbol, 0) | (1 << i)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best = m
    for symbol in text:
        eq = peq.get(symbol, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (~(xh | plus) & mask), plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        best = min(best, score)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        plus, minus = mh | (~(xv | ph) & mask), ph & xv
    return best


class PieceIndex:
    """All pieces of a block of items, and what is needed to verify their hits."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, budget: int):
        import ahocorasick

        self.min_words, self.budget = min_words, budget
        self.length = length = min_words // (budget + 2)
        # Shorter runs can be passed over. With one edit, either one of the two runs beside it
        # has 2 * length - 1 words and so a whole piece, or both have min_words + 1 - 2 * length.
        self.least = {0: min_words, 1: min(2 * length - 1, min_words + 1 - 2 * length)}.get(budget, length)
        self.items: list[tuple[int, list[str]]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            body = words(text or "")
            if len(body) < min_words:
                continue
            self.items.append((item_id, body))
            for at in range(0, len(body) - self.length + 1, self.length):
                piece = " " + " ".join(body[at : at + self.length]) + " "
                places.setdefault(piece, []).append((len(self.items) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.size = len(places)

    def search(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item id, longest run of equal words, distance of the best passage) of a document."""
        body = words(text)
        if len(body) < self.min_words - self.budget or not self.size:
            return
        joined = " " + " ".join(body) + " "
        seen, at = 0, 0
        done: dict[tuple[int, int], int] = {}  # per item and diagonal, the end of the last run
        best: dict[int, tuple[int, int]] = {}
        for end, (size, where) in self.automaton.iter(joined):
            start = end - size + 1
            at += joined.count(" ", seen, start)
            seen = start
            for item, offset in where:
                diagonal = (item, at - offset)
                if at < done.get(diagonal, 0):
                    continue
                right, found = self._verify(self.items[item][1], body, offset, at)
                done[diagonal] = right
                if found and (item not in best or (-found[0], found[1]) < (-best[item][0], best[item][1])):
                    best[item] = found
        for item, (run, distance) in best.items():
            yield self.items[item][0], run, distance

    def _verify(self, item: list[str], body: list[str], offset: int, place: int) -> tuple[int, tuple[int, int] | None]:
        """Where the run of equal words through a piece hit ends in the document; and its length
        with the distance of the passage around it, if that is within the budget."""
        left = 0
        while offset - left > 0 and place - left > 0 and item[offset - left - 1] == body[place - left - 1]:
            left += 1
        right, n, m = self.length, len(item), len(body)
        while offset + right < n and place + right < m and item[offset + right] == body[place + right]:
            right += 1
        run = left + right
        if run < self.least:
            return place + right, None
        # A passage that cuts the run is no closer than the one moved along to hold all of it, or to lie in
        # it; and as the words on both sides of the run differ, one edit allows to go on to one side only.
        distance, size = self.budget + 1, self.min_words
        first, last = max(0, offset + right - size), min(offset - left, n - size)
        for start in {last} if run >= size else {first, last} if self.budget == 1 else range(first, last + 1):
            if run >= size or (start <= offset - left and start + size >= offset + right):
                at = place - (offset - start)
                region = body[max(0, at - self.budget) : at + size + self.budget]
                distance = min(distance, myers(item[start : start + size], region))
        return place + right, (run, distance) if distance <= self.budget else None


_INDEXES: dict[str, PieceIndex] = {}


def _blocks(items: DataFrame, limit: int) -> tuple[int, Callable[[int], list[tuple[int, str]]]]:
    """The number of blocks of about ``limit`` bytes of text, and how to read one of them."""
    rows = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = max(1, -(-int(total) // limit))
    return count, lambda block: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect()]


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, budget: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that hold a passage of ``min_words`` words of an item, up to ``budget`` edits.

    Result: ``doc_id, item_id, run, distance`` -- one row per document and item; ``run`` is
    the longest run of consecutive words they share through a piece hit, ``distance`` the
    edits (whole words) of the closest passage. Null texts hold nothing; items shorter than
    ``min_words`` cannot leak; repeated rows of an item count once; rows of ``documents``
    with one id are searched each and come out once per item; other columns are not read.
    """
    spark, parts = documents.sparkSession, []
    bodies = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    count, read = _blocks(items, block_bytes)
    work = Workspace(spark, "leaks") if count > 1 else None
    for block in range(count):
        shared = spark.sparkContext.broadcast(read(block))
        name = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}-{min_words}-{budget}"

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _INDEXES:
                _INDEXES.clear()
                _INDEXES[name] = PieceIndex(shared.value, min_words, budget)
            index = _INDEXES[name]
            for batch in batches:
                rows = [(doc, *found) for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if body for found in index.search(body)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _FOUND.types)], schema=_FOUND)

        part = bodies.mapInArrow(run, "doc_id long, item_id long, run int, distance int")
        if work is not None:
            part = work.save(part, f"block-{block}")
            shared.unpersist()
        parts.append(part)
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.min("distance").alias("distance"))


def exact_leaks(documents: DataFrame, items: DataFrame, min_words: int = 12) -> DataFrame:
    """Documents that hold at least ``min_words`` consecutive words of an item, letter for letter after folding.

    The passages are those that the distance lets through; the exact check of their runs comes last.
    """
    return find_leaks(documents, items, min_words).where(F.col("run") >= min_words).select("doc_id", "item_id")
