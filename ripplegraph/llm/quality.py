"""Per-document text quality, and a Gaussian mixture that tells prose from lists, tables and junk.

Documents are read once. Each gives its own statistics and, as many mix several kinds of
text, the form of every passage (a run of lines of one make between blank lines) with its words
as numbers. What the collection itself says about words comes from these: words of many
documents that keep to running clauses are *common words*, and two frequent words that stand
side by side again and again are a *known pair*. So there is no word list, and no language is
preferred. The share of common words, and of pairs nobody else writes, complete a passage's
statistics.

A Gaussian mixture with diagonal covariances is fitted to the standardized passage
statistics of *all* documents by expectation-maximization: one distributed pass per
iteration, of which only the sums of the sufficient statistics (a few hundred numbers,
whatever the input) reach the driver, until the likelihood stands still. Its components start from inspected example passages
and are named, after fitting, by the examples they hold. A document's share of prose is the
mean probability of prose over its passages, weighted by their characters.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.quality_examples import EXAMPLES
from ripplegraph.session import Workspace

#: What a passage's form alone says, and what the collection's words add to it.
FORM = ("words_per_line", "symbols", "digits", "stops", "clause", "marked", "columns", "code", "variety", "word_length")
STATS = (*FORM, "common", "disorder")
#: A word is frequent if it stands in this share of the documents, and in three at least ...
FREQUENT, FREQUENT_LEAST = 0.01, 3
#: ... and common if that share of its occurrences stands in running clauses.
RUNNING = 0.8
#: A pair of frequent words is known if it stands in that many passages, as a share of the documents.
KNOWN, KNOWN_LEAST = 0.0004, 4
_MARKED = re.compile(r"\s*(?:[-*•+–]\s|\d{1,4}[.)]\s|[A-Za-z][.)]\s|\[[ xX]\]\s)")
_CELLS = re.compile(r"[|│┃\t]|\S {3,}\S|</?t[dhr]>")
_CODE = re.compile(
    r"[{}]\s*$|[)\]}'\"];\s*$|^\s*(?:def |class |return\b.*[\w\])}]$|for .*:$|if .*:$|else:|export (?:const|function|default)|const |let |var |import .* from |@\w+|Traceback \(|File \")|=> |[\w\])]\(.*=.*\)$|\w\[\w+\] = |"
    r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d|</\w+>|\w=function\("
)
_CODE_HINT = re.compile(r'[{}()=\[\]<>@"]|^\s*(?:return\b|else:|\d{4}-)', re.M)
_HIDDEN = regex.compile(r"\p{Cf}+")
_GAP = re.compile(r" {3,}")
_SYMBOL, _DIGIT = re.compile(r"[^\w\s]"), re.compile(r"\d")
_STOP = re.compile(r"[.!?…][\"'»”)]*(?=\s|$)")
_QUOTED = re.compile(r"^\s*(?:>+|//|#+(?=\s))[ \t]?")
_EDGE = "\"'`.,;:!?()[]…«»“”>*_"


def may_hold_cells(text: str) -> bool:
    """Whether any line of a text can be one of cells; spares the pattern in most texts."""
    return "|" in text or "\t" in text or "   " in text or "│" in text or "┃" in text or "</" in text or "<t" in text


def passages(text: str) -> Iterator[list[str]]:
    """Runs of lines of one make; a blank line ends a run. The whole text is covered.

    Signs of quoting and commenting at the start of a line say nothing about what it holds
    and are taken off.
    """
    run: list[str] = []
    make, cells = None, may_hold_cells(text)
    for line in text.splitlines():
        if line and (line[0] in ">/#" or line[0].isspace()):
            line = _QUOTED.sub("", line)
        if not line.strip():
            if run:
                yield run
            run, make = [], None
            continue
        own = "item" if _MARKED.match(line) else "cells" if cells and _CELLS.search(line) else "text"
        if run and own != make:
            yield run
            run = []
        run.append(line)
        make = own
    if run:
        yield run


_MARKS = frozenset(",.;:!?")


def word_number(word: str) -> int:
    """A word of letters as an even number, 0 for any other; rare words may share theirs with others."""
    return zlib.crc32(word.encode("utf-8", "replace")) & 0x7FFFFFFE if word.isalpha() else 0


class _Numbers(dict):
    """The number of every token met: that of its word, odd where a mark follows."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        number = self[token] = word_number(token.strip(_EDGE)) | (token[-1] in _MARKS)
        return number


_numbers = _Numbers()
_SYMBOLS = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c) in "_ \t\n\r\f\v\x1c\x1d\x1e\x1f"))


def signs_of(body: str) -> tuple[int, int]:
    """Numbers of symbols (neither of words nor blank) and of digits."""
    if body.isascii():
        raw = body.encode("ascii")
        return len(raw) - len(raw.translate(None, _SYMBOLS)), len(raw) - len(raw.translate(None, b"0123456789"))
    return len(_SYMBOL.findall(body)), len(_DIGIT.findall(body))


def statistics(lines: list[str]) -> tuple[tuple[int, int, int], list[float], list[int]]:
    """Raw counts of a passage (words, visible characters, symbols), its statistics in the order of
    ``FORM``, and its words as numbers, odd where a mark follows.

    Costly patterns are tried only where the passage holds a character that they need.
    """
    body = "\n".join(lines)
    tokens = body.lower().split()
    n, rows = len(tokens), len(lines)
    visible = sum(map(len, tokens))
    numbers = list(map(_numbers.__getitem__, tokens))
    symbols, digits = signs_of(body)
    stops = len(_STOP.findall(body))
    count = body.count
    marks = count(",") + count(";")
    gaps = len(_GAP.findall(body)) if "   " in body else 0
    breaks = marks + rows - 1 + stops + count(": ") + count("|") + count("│") + count("\t") + count("</td>") + gaps
    cells = len(_CELLS.findall(body)) if may_hold_cells(body) else 0
    if marks:
        cells += marks - sum(map(count, (", ", ",\n", "; ", ";\n"))) - (body[-1] in ",;")
    code = sum(1 for line in lines if _CODE_HINT.search(line) and _CODE.search(line)) if _CODE_HINT.search(body) else 0
    marked = sum(1 for line in lines if _MARKED.match(line))
    return (n, visible, symbols), [
        math.log1p(min(n / rows, 60.0)),
        symbols / visible,
        digits / visible,
        min(stops / rows, 1.5),
        math.log1p(min(n / (breaks + 1), 25.0)),
        marked / rows,
        min(cells / n, 1.0),
        code / rows,
        math.log1p(len(set(tokens))) / math.log1p(n),
        math.log(min(visible / n, 200.0)),
    ], numbers


def read_text(text: str) -> tuple[int, float, float, float, list[int], list[int], list[float], list[int]]:
    """A document's words, mean word length, symbol ratio and share of lines ending in punctuation;
    and of its passages the visible characters, the words, the form statistics and the words as numbers, flat.

    Signs of quoting at the start of lines are no words.
    """
    if not text.isascii():  # wide letters, odd blanks and invisible signs say nothing about the kind of text
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    words = visible = symbols = ended = rows = 0
    chars: list[int] = []
    sizes: list[int] = []
    flat: list[float] = []
    said: list[int] = []
    for lines in passages(text):
        (n, seen, marks), stats, numbers = statistics(lines)
        words, visible, symbols = words + n, visible + seen, symbols + marks
        rows += len(lines)
        ended += sum(1 for line in lines if line.rstrip()[-1] in ".!?…")
        chars.append(seen)
        sizes.append(n)
        flat += stats
        said += numbers
    return words, visible / max(words, 1), symbols / max(visible, 1), ended / max(rows, 1), chars, sizes, flat, said


_READ = "doc_id long, words long, word_length double, symbol_ratio double, ended_lines double, chars array<int>, sizes array<int>, form array<float>, said array<int>, shown boolean"
_READ_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("words", pa.int64()), ("word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("ended_lines", pa.float64())]
    + [("chars", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("form", pa.list_(pa.float32())), ("said", pa.list_(pa.int32())), ("shown", pa.bool_())]
)


def read_documents(documents: DataFrame, signs: bool = False) -> DataFrame:
    """Statistics of every document that is not null or blank, and of its passages (flat).

    Texts of nothing but signs of quoting or invisible signs have no passages; they are given
    only with ``signs``. The examples come along as ``shown`` rows: their words count like any others'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, shown in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not text or not text.strip():
                    continue
                read = read_text(text)
                if read[0] or signs:
                    rows.append((doc, *read, shown))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ_ARROW.types)], schema=_READ_ARROW)

    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("shown")).where("text is not null")
    shown = documents.sparkSession.createDataFrame([(None, text, True) for texts in EXAMPLES.values() for text in texts], given.schema)
    return given.unionByName(shown.coalesce(1)).mapInArrow(run, _READ)


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


class Passages:
    """A batch of documents as flat arrays: which word is of which passage, which passage of which document."""

    def __init__(self, batch: pa.RecordBatch):
        self.size = _values(batch.column("sizes")).astype(np.int64)
        self.document = np.repeat(np.arange(batch.num_rows), _lengths(batch.column("sizes")))
        self.form = _values(batch.column("form")).astype(np.float64).reshape(-1, len(FORM))
        said = _values(batch.column("said"))
        self.passage = np.repeat(np.arange(len(self.size)), self.size)
        self.word, self.marked = said & ~1, (said & 1).astype(bool)

    def running(self) -> np.ndarray:
        """Passages of running clauses, by their form alone."""
        at = {name: self.form[:, i] for i, name in enumerate(FORM)}
        return (at["clause"] >= math.log1p(4)) & (at["words_per_line"] >= math.log1p(6)) & (at["marked"] == 0) & (at["columns"] == 0) & (at["code"] == 0)

    def places(self, frequent: np.ndarray) -> np.ndarray:
        """Place of every word among the frequent ones, -1 for all others."""
        if not len(frequent):
            return np.full(len(self.word), -1)
        place = np.minimum(np.searchsorted(frequent, self.word), len(frequent) - 1)
        return np.where((frequent[place] == self.word) & (self.word > 0), place, -1)

    def pairs(self, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Passage and number of every two frequent words (of ``size``) side by side with no mark between."""
        both = (place[:-1] >= 0) & (place[1:] >= 0) & ~self.marked[:-1] & (self.passage[:-1] == self.passage[1:])
        return self.passage[:-1][both], place[:-1][both].astype(np.int64) * size + place[1:][both]


def _totals(rows: DataFrame, keys: str, counts: int, of) -> DataFrame:
    """Sums of ``of(batch)``, (keys, counts ...) arrays, added up in the task first: ``key, n0, n1 ...``"""
    names = ["key", *(f"n{i}" for i in range(counts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> list[np.ndarray]:
            key, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return [key, *(np.bincount(inverse, np.concatenate([h[i + 1] for h in held]), len(key)) for i in range(counts))]

        for batch in batches:
            if batch.num_rows:
                held.append(of(batch))
            if sum(len(h[0]) for h in held) > 2_000_000:
                held = [tuple(merged())]
                if len(held[0][0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in held.pop()], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in merged()], names=names)

    parts = rows.select("sizes", "form", "said").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return parts.groupBy("key").agg(*(F.sum(n).alias(n) for n in names[1:]))


def _count_words(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Words of a batch with the documents that hold them, their occurrences, and those in running clauses."""
    p = Passages(batch)
    words = p.word > 0
    place, key = pd.factorize(p.word[words])
    size, passage = len(key), p.passage[words]
    held = pd.unique(p.document[passage] * max(size, 1) + place) % max(size, 1)
    running = p.running()[passage]
    return key.astype(np.int64), np.bincount(held, minlength=size), np.bincount(place, minlength=size), np.bincount(place[running], minlength=size)


class Words:
    """What the collection says about words: the frequent ones, which of them are common, and the known pairs.

    A document of ``w`` distinct words adds at most ``w`` to the counts that ``FREQUENT`` of the
    documents must reach, so there are at most ``w / FREQUENT`` frequent words, and as many pairs
    known as ``w / KNOWN``, however large the collection.
    """

    def __init__(self, frequent: np.ndarray, common: np.ndarray, known: np.ndarray):
        self.frequent, self.common, self.known = frequent, common, known

    def statistics(self, p: Passages) -> np.ndarray:
        """Share of common words and of unknown pairs of every passage."""
        n = len(p.size)
        place = p.places(self.frequent)
        common = np.append(np.isin(self.frequent, self.common), False)[place]  # the last for all other words
        passage, pair = p.pairs(place, len(self.frequent))
        unknown = np.ones(len(pair), bool)
        if len(self.known):
            unknown = self.known[np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)] != pair
        disorder = np.bincount(passage, unknown, n) / (np.bincount(passage, minlength=n) + 2)
        return np.column_stack([np.bincount(p.passage, common, n) / np.maximum(p.size, 1), disorder])


def learn_words(rows: DataFrame) -> Words:
    """Count words, then pairs of frequent words, over all documents."""
    documents = rows.count()
    counted = _totals(rows, "said", 3, _count_words).where(F.col("n0") >= max(FREQUENT_LEAST, FREQUENT * documents)).collect()
    counted = sorted((r["key"], r["n1"], r["n2"]) for r in counted)
    frequent = np.array([c[0] for c in counted], np.int64)
    common = np.array([c[0] for c in counted if c[2] >= RUNNING * c[1]], np.int64)

    def count_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        p = Passages(batch)
        passage, pair = p.pairs(p.places(frequent), len(frequent))
        number, key = pd.factorize(pair)
        once = pd.unique(passage * max(len(key), 1) + number) % max(len(key), 1)
        return key, np.bincount(once, minlength=len(key))

    known = _totals(rows, "said", 1, count_pairs).where(F.col("n0") >= max(KNOWN_LEAST, KNOWN * documents)).select("key").collect()
    return Words(frequent, common, np.array(sorted(r["key"] for r in known), np.int64))


_FULL = "doc_id long, words long, word_length double, symbol_ratio double, ended_lines double, common_words double, chars array<int>, stats array<float>, shown boolean"


def complete(rows: DataFrame, words: Words) -> DataFrame:
    """The read documents with all statistics of their passages (flat, in the order of ``STATS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = Passages(batch)
            more = words.statistics(p)
            flat = np.column_stack([p.form, more]).astype(np.float32)
            share = np.bincount(p.document, more[:, 0] * p.size, batch.num_rows) / np.maximum(np.bincount(p.document, p.size, batch.num_rows), 1)
            lengths = np.concatenate([[0], np.cumsum(np.bincount(p.document, minlength=batch.num_rows))]).astype(np.int32)
            stats = pa.ListArray.from_arrays(pa.array(lengths * len(STATS), pa.int32()), pa.array(flat.ravel()))
            given = [batch.column(c) for c in ("doc_id", "words", "word_length", "symbol_ratio", "ended_lines")]
            yield pa.RecordBatch.from_arrays([*given, pa.array(share), batch.column("chars"), stats, batch.column("shown")], names=[c.split()[0] for c in _FULL.split(", ")])

    return rows.mapInArrow(run, _FULL)


class Mixture:
    """Gaussian mixture with diagonal covariances over standardized statistics."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, var: np.ndarray):
        self.weight, self.mean, self.var = weight, mean, var

    def log_density(self, x: np.ndarray) -> np.ndarray:
        inverse = 1.0 / self.var
        square = (x * x) @ inverse.T - 2.0 * (x @ (self.mean * inverse).T) + (self.mean**2 * inverse).sum(1)
        return np.log(self.weight) - 0.5 * (square + np.log(2 * np.pi * self.var).sum(1))

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Probability of each component for each row, and the sum of log likelihoods."""
        log = self.log_density(x)
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        total = p.sum(1, keepdims=True)
        return p / total, float((np.log(total) + top).sum())

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sufficient statistics of some rows, flat: per component count, sums and square sums, then the likelihood."""
        p, likelihood = self.posterior(x)
        return np.concatenate([p.sum(0), (p.T @ x).ravel(), (p.T @ (x * x)).ravel(), [likelihood]])

    def updated(self, sums: np.ndarray, prior: float, start: "Mixture", floor: float) -> "Mixture":
        """The M step. ``prior`` rows' worth of belief in the start keep small components in place."""
        k, d = self.mean.shape
        count, first, second = sums[:k], sums[k : k + k * d].reshape(k, d), sums[k + k * d : k + 2 * k * d].reshape(k, d)
        n = (count + prior)[:, None]
        mean = (first + prior * start.mean) / n
        var = (second + prior * (start.var + start.mean**2)) / n - mean**2
        return Mixture((count + prior) / (count.sum() + prior * k), mean, np.maximum(var, floor))


def example_rows(words: Words) -> tuple[list[str], np.ndarray]:
    """Component of each example passage, and its raw statistics."""
    names, rows = [], []
    for name, texts in EXAMPLES.items():
        read = [read_text(text) for text in texts]
        columns = [pa.array([r[i] for r in read], kind) for i, kind in ((5, pa.list_(pa.int32())), (6, pa.list_(pa.float32())), (7, pa.list_(pa.int32())))]
        p = Passages(pa.RecordBatch.from_arrays(columns, names=["sizes", "form", "said"]))
        names += [name] * len(p.size)
        rows.append(np.column_stack([p.form, words.statistics(p)]))
    return names, np.concatenate(rows)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(STATS))


def _summed(rows: DataFrame, of) -> np.ndarray:
    """Sum over all rows of the vector that ``of`` makes of a matrix, added up on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                total = of(x) if total is None else total + of(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["i", "v"])

    parts = rows.select("stats").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in sorted(parts.collect(), key=lambda r: r["i"])])


class PassageModel:
    """A fitted mixture with its standardization and the class of every component."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, mixture: Mixture, classes: list[str]):
        self.center, self.scale, self.mixture, self.classes = center, scale, mixture, classes

    def prose(self, x: np.ndarray) -> np.ndarray:
        return self.by_class(x)["prose"]

    def by_class(self, x: np.ndarray) -> dict[str, np.ndarray]:
        p, _ = self.mixture.posterior((x - self.center) / self.scale)
        classes = np.array(self.classes)
        return {c: p[:, classes == c].sum(1) for c in ("prose", "list", "table", "junk")}


def fit(rows: DataFrame, words: Words, iterations: int = 300, tolerance: float = 5e-3, floor: float = 0.02) -> PassageModel | None:
    """Fit the mixture to the ``stats`` of all rows; None if there are none.

    Iterations go on until the mean log likelihood of a passage grows by less than ``tolerance``;
    ``iterations`` without that are an error.
    """
    moments = _summed(rows, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if not len(moments):
        return None
    d = len(STATS)
    n, center = moments[0], moments[1 : d + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[d + 1 :] / n - center**2, 1e-4))
    names, raw = example_rows(words)
    examples, keys = (raw - center) / scale, list(EXAMPLES)
    which = np.array([keys.index(name) for name in names])
    mean = np.array([examples[which == k].mean(0) for k in range(len(keys))])
    spread = np.array([examples[which == k].var(0) for k in range(len(keys))])
    start = Mixture(np.full(len(keys), 1 / len(keys)), mean, np.maximum(spread, 0.15))
    mixture, before = start, -math.inf
    for _ in range(iterations):
        sums = _summed(rows, lambda x, m=mixture: m.sums((x - center) / scale))
        mixture = mixture.updated(sums, 0.003 * n + 5.0, start, floor)
        if sums[-1] - before < tolerance * n:
            break
        before = sums[-1]
    else:
        raise RuntimeError(f"the likelihood still grows after {iterations} iterations")
    # name the components by the examples they hold; one that holds none keeps the name it started with
    held = mixture.posterior(examples)[0]
    classes = []
    for k, key in enumerate(keys):
        by_class: dict[str, float] = {}
        for i, name in enumerate(names):
            by_class[name.split(":")[0]] = by_class.get(name.split(":")[0], 0.0) + held[i, k]
        best = max(by_class, key=by_class.get)
        classes.append(best if by_class[best] > 0.5 else key.split(":")[0])
    return PassageModel(center, scale, mixture, classes)


def judge(spark: SparkSession, documents: DataFrame, iterations: int = 300, signs: bool = False) -> DataFrame:
    """Every document that is not null or blank with its statistics and shares of each class.

    ``doc_id, words, word_length, symbol_ratio, ended_lines, common_words, prose, lists,
    tables, junk`` -- the last four add up to 1. Defined cases: null and blank texts give no
    row; repeated ids give a row each; texts of one passage are judged by it; very long texts
    are read whole; an empty table gives no rows; texts of nothing but signs of quoting or
    invisible signs give a row, of 0 words and junk, only with ``signs``.
    """
    work = Workspace(spark, "quality")
    read = work.save(read_documents(documents, signs), "read")
    words = learn_words(read)
    rows = work.save(complete(read, words), "passages").where("not shown")
    work.drop("read")
    model = fit(rows, words, iterations)
    schema = "doc_id long, words long, word_length double, symbol_ratio double, ended_lines double, common_words double, prose double, lists double, tables double, junk double"
    if model is None and rows.isEmpty():
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = batch.column("chars")
            sizes = chars.value_lengths().to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            weight = chars.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            total = np.bincount(doc, weight, len(sizes))
            shares = model.by_class(_matrix(batch.column("stats"))) if len(weight) else dict.fromkeys(("prose", "list", "table", "junk"), weight)
            bare = total == 0
            columns = [pa.array(np.bincount(doc, weight * shares[c], len(sizes)) / np.where(bare, 1, total) + (bare if c == "junk" else 0)) for c in ("prose", "list", "table", "junk")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return rows.drop("shown").mapInArrow(run, schema)


def not_prose(spark: SparkSession, documents: DataFrame, share: float = 0.5) -> DataFrame:
    """Documents of whose characters less than ``share`` stand in running sentences."""
    return judge(spark, documents, signs=True).where(F.col("prose") < share).select("doc_id").distinct()


def plain_statistics(documents: DataFrame) -> DataFrame:
    """``doc_id, words, word_length, symbol_ratio, ended_lines`` of the text as it stands, by built-in expressions.

    Words are what blanks part, symbols what is neither letter, digit, ``_`` nor blank; lines that are blank
    do not count. Null and blank texts give no row.
    """
    blank = r"[ \t\n\r\f\x0B]"
    words = F.filter(F.split("text", blank + "+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t\n\r\f\x0B]"))
    rows = documents.where(F.col("text").rlike(r"[^ \t\n\r\f\x0B]")).select("doc_id", "text", words.alias("w"), lines.alias("l"))
    visible = F.length(F.regexp_replace("text", blank, ""))
    symbols = F.length(F.regexp_replace("text", r"[\p{L}\p{N}_ \t\n\r\f\x0B]", ""))
    ended = F.size(F.filter("l", lambda line: line.rlike(r"[.!?…][ \t\r\f\x0B]*\z")))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), (visible / F.size("w")).alias("word_length"), (symbols / visible).alias("symbol_ratio"), (ended / F.size("l")).alias("ended_lines"))
