"""Flattening deeply nested records into related tables in a single pass.

A depth-first visitor walks every record once and emits tagged rows, parents before their
children: the table tag, the row's place (record, position of the parent, position of the
child), the parent's key and a typed payload. The tagged rows of a source are written once,
partitioned by tag; each flat table is then read from its partition only, with its own schema
put on the payload. A row's key is its place, so a child's key begins with its parent's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.session import Workspace

_ARROW = pa.schema(
    [("tag", pa.string()), ("record_id", pa.int64()), ("at", pa.int32()), ("parent_key", pa.string()), ("child_no", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("list", pa.list_(pa.string())), ("number", pa.int64())]
)
_TAGGED = "tag string, record_id long, at int, parent_key string, child_no long, a string, b string, list array<string>, number long"
_BATCH = 20_000

#: Columns of each flat table and the typed payload they come from; parents have ``number`` children.
PARENTS = {
    "test": {"test_id": "parent_key", "n_symbols": "number"},
    "declaring_test": {"test_id": "parent_key", "n_journeys": "number"},
    "journey": {"journey_id": "parent_key", "name": "a", "route": "list", "n_entries": "number"},
}
CHILDREN = {
    "traced_symbol": {"relpath": "a", "qualname": "b"},
    "declaration": {"journey_id": "a"},
    "entry": {"name": "a", "file": "b"},
}


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


class Repeating(dict):
    """A JSON object that repeats names: by name it has the first value, ``items`` has all."""

    def __init__(self, pairs: list[tuple]):
        super().__init__(reversed(pairs))
        self.pairs = pairs

    def items(self):
        return self.pairs


def _object(pairs: list[tuple]) -> dict:
    made = dict(pairs)
    return made if len(made) == len(pairs) else Repeating(pairs)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, object_pairs_hook=_object)
_CLOSING = {"[": "]", "{": "}"}


def parse_deep(text: str):
    """The value of a JSON text without recursion, for nesting beyond the parser's limit."""
    past = lambda at: json.decoder.WHITESPACE.match(text, at).end()

    def due(mark: str, names: list, at: int) -> int:
        """Place of the next value; in an object its name is read first."""
        at = past(at)
        if mark == "{":
            if text[at : at + 1] != '"':
                raise ValueError(f"no name at {at}")
            name, at = _DECODER.scan_once(text, at)
            names.append(name)
            at = past(at)
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = past(at + 1)
        return at

    at, open_ = past(0), []
    while True:
        mark = text[at : at + 1]
        if mark in _CLOSING:
            end = past(at + 1)
            if text[end : end + 1] != _CLOSING[mark]:
                open_.append((mark, [], []))
                at = due(mark, open_[-1][1], end)
                continue
            value, at = {} if mark == "{" else [], end + 1
        else:
            try:
                value, at = _DECODER.scan_once(text, at)
            except StopIteration:
                raise ValueError(f"no value at {at}") from None
        while open_:
            mark, names, values = open_[-1]
            values.append(value)
            at = past(at)
            if text[at : at + 1] == ",":
                at = due(mark, names, at + 1)
                break
            if text[at : at + 1] != _CLOSING[mark]:
                raise ValueError(f"not closed at {at}")
            open_.pop()
            value, at = _object(list(zip(names, values))) if mark == "{" else values, at + 1
        else:
            if past(at) != len(text):
                raise ValueError(f"more text at {at}")
            return value


def parse_json(text: str | None):
    """The value of a JSON text and True, or None and False for null, blank or invalid text."""
    if text is None or not text.strip():
        return None, False
    try:
        try:
            return _DECODER.decode(text), True
        except RecursionError:
            return parse_deep(text), True
    except ValueError:
        return None, False


def _clean(text):
    """Lone surrogates, which JSON escapes can make, have no UTF-8 form."""
    return text.encode("utf-8", "replace").decode("utf-8") if isinstance(text, str) and not text.isascii() else text


@dataclass
class Rows:
    """Tagged rows as columns, taken as Arrow batches."""

    columns: list[list] = field(default_factory=lambda: [[] for _ in _ARROW])

    def parent(self, tag: str, record: int, at: int, key: str, children: int, a=None, texts=None) -> None:
        for column, value in zip(self.columns, (tag, record, at, key, None, a, None, texts, children)):
            column.append(value)

    def children(self, tag: str, record: int, at: int, key: str, a: list, b: list | None = None) -> None:
        n = len(a)
        none = [None] * n
        for column, values in zip(self.columns, ([tag] * n, [record] * n, [at] * n, [key] * n, range(n), a, b or none, none, none)):
            column.extend(values)

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(self.columns, _ARROW.types)], schema=_ARROW)
        self.__init__()
        return batch


@dataclass(frozen=True)
class ListField:
    """A map from parent key to a list of children, in one column of the records."""

    name: str
    column: str
    parent_tag: str
    child_tag: str
    key: str  # the payload that names a child

    def visit(self, record: int, value, rows: Rows) -> None:
        raise NotImplementedError


class TracedField(ListField):
    """Test id to ``[relpath, qualname]`` pairs; short and null pairs keep their place."""

    def visit(self, record: int, value, rows: Rows) -> None:
        for at, (key, pairs) in enumerate(value or ()):
            rows.parent(self.parent_tag, record, at, key or "", len(pairs or ()))
            if pairs:
                rows.children(self.child_tag, record, at, key or "", [p[0] if p else None for p in pairs], [p[1] if p and len(p) > 1 else None for p in pairs])


class DeclaredField(ListField):
    def visit(self, record: int, value, rows: Rows) -> None:
        for at, (key, items) in enumerate(value or ()):
            rows.parent(self.parent_tag, record, at, key or "", len(items or ()))
            if items:
                rows.children(self.child_tag, record, at, key or "", items)


class JourneyField(ListField):
    """JSON text: an object of journeys by id, or an array of journeys with their id inside."""

    def visit(self, record: int, value, rows: Rows) -> None:
        document, valid = parse_json(value)
        if isinstance(document, dict):
            journeys = document.items()
        elif valid and isinstance(document, list):
            journeys = [(j.get("id") if isinstance(j, dict) else None, j) for j in document]
        else:
            return
        for at, (key, journey) in enumerate(journeys):
            key = _clean(key if isinstance(key, str) else "" if key is None else json.dumps(key))
            body = journey if isinstance(journey, dict) else {}
            entries = body.get("entries")
            if entries is None:
                entries = []
            elif not isinstance(entries, list):
                entries = [entries]
            route = body.get("route")
            route = [route] if isinstance(route, str) else [r for r in route if isinstance(r, str)] if isinstance(route, list) else None
            rows.parent(self.parent_tag, record, at, key, len(entries), _clean(_text(body.get("name"))), route and [_clean(r) for r in route])
            if entries:
                names = [_clean(_text(e.get("name") if isinstance(e, dict) else e)) for e in entries]
                files = [_clean(_text(e.get("file"))) if isinstance(e, dict) else None for e in entries]
                rows.children(self.child_tag, record, at, key, names, files)


TRACE_FIELDS = (TracedField("tgtrace.tests", "tests", "test", "traced_symbol", "b"), DeclaredField("tgtrace.declared", "declared", "declaring_test", "declaration", "a"))
REGISTRY_FIELDS = (JourneyField("signedintake.journeys", "journeys", "journey", "entry", "a"),)


def plain_values(array: pa.Array) -> list:
    """An Arrow array as Python values, maps as lists of pairs; nested lists are cut by their offsets."""
    kind = array.type
    if pa.types.is_map(kind) or pa.types.is_list(kind):
        offsets = array.offsets.to_numpy()
        first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        if pa.types.is_map(kind):
            inner = list(zip(plain_values(array.keys.slice(first, size)), plain_values(array.items.slice(first, size))))
        else:
            inner = plain_values(array.values.slice(first, size))
        cuts = (offsets - first).tolist()
        out = [inner[i:j] for i, j in zip(cuts, cuts[1:])]
        if array.null_count:
            out = [v if ok else None for v, ok in zip(out, array.is_valid().to_pylist())]
        return out
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return array.to_numpy(zero_copy_only=False).tolist()
    return array.to_pylist()


def emit_tagged(records: DataFrame, key: str, fields: tuple[ListField, ...]) -> DataFrame:
    """Tagged rows of all records; a record delivered twice (same ``key``) counts once.

    The copies of a record are equal in the nested fields; should they differ, one of them
    is taken whole, never a mixture. A record whose key is null is skipped: nothing could
    refer to it.
    """
    columns = [f.column for f in fields]
    once = records.select(F.col(key).alias("record_id"), *columns).where("record_id is not null").groupBy("record_id").agg(F.first(F.struct(*columns)).alias("r")).select("record_id", *(F.col("r")[c].alias(c) for c in columns))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows()
        for part in batches:
            for record, *values in zip(*map(plain_values, part.columns)):
                for one, value in zip(fields, values):
                    one.visit(record, value, rows)
                if len(rows) >= _BATCH:
                    yield rows.take()
        if len(rows):
            yield rows.take()

    return once.mapInArrow(walk, _TAGGED)


class FlatTables:
    """The tagged rows of several record tables: each source is walked and written once, when it is
    first asked for, and read table by table."""

    def __init__(self, spark: SparkSession, traces: DataFrame, registries: DataFrame):
        self.spark, self.work = spark, Workspace(spark, "nested")
        self.sources = {"traces": (traces, "trace_id", TRACE_FIELDS), "registries": (registries, "registry_id", REGISTRY_FIELDS)}
        self._written: dict[str, DataFrame] = {}

    def _tagged(self, source: str) -> DataFrame:
        if source not in self._written:
            emit_tagged(*self.sources[source]).write.mode("overwrite").partitionBy("tag").parquet(self.work.at(source))
            self._written[source] = self.spark.read.schema(_TAGGED).parquet(self.work.at(source))
        return self._written[source]

    def table(self, tag: str) -> DataFrame:
        """One flat table: ``record_id, key``, for children ``parent`` (its parent's key), ``parent_key`` and
        ``child_no``, and the columns of its payload."""
        source = next(name for name, (_, _, fields) in self.sources.items() if any(tag in (f.parent_tag, f.child_tag) for f in fields))
        rows, parent = self._tagged(source).where(F.col("tag") == tag), F.concat_ws("/", "record_id", "at")
        if tag in PARENTS:
            return rows.select("record_id", parent.alias("key"), *(F.col(c).alias(name) for name, c in PARENTS[tag].items()))
        own = F.concat_ws("/", parent, "child_no").alias("key")
        return rows.select("record_id", own, parent.alias("parent"), "parent_key", "child_no", *(F.col(c).alias(name) for name, c in CHILDREN[tag].items()))

    def children(self) -> DataFrame:
        """One row per child of all tables, and one per parent without any (``child_no`` -1)."""
        out = None
        for source, (_, _, fields) in self.sources.items():
            names, keys, bare = F.lit(None).cast("string"), F.lit(""), F.lit(False)
            for f in fields:
                of = F.col("tag").isin(f.parent_tag, f.child_tag)
                names, keys = F.when(of, F.lit(f.name)).otherwise(names), F.when(F.col("tag") == f.child_tag, F.coalesce(f.key, F.lit(""))).otherwise(keys)
                bare = bare | (F.col("tag") == f.parent_tag)
            rows = self._tagged(source).where(~bare | (F.col("number") == 0))
            part = rows.select(names.alias("field"), "record_id", "parent_key", F.coalesce("child_no", F.lit(-1)).cast("long").alias("child_no"), keys.alias("child_key"))
            out = part if out is None else out.unionByName(part)
        return out


def nested_children(spark: SparkSession, traces: DataFrame, registries: DataFrame) -> DataFrame:
    """Every list element of ``tests``, ``declared`` and ``journeys`` with its parent.

    Defined cases: a null map or text, and text that is empty or not strict JSON, give no
    rows; a parent with a null, missing or empty list gives one row with ``child_no`` -1;
    null elements keep their position and have the key ''; an object or string that stands
    without a list is a list of one; JSON that is neither object nor array has no journeys;
    an array element without an id belongs to the parent ''; an id that an object repeats
    is a parent each time, of other repeated names the first counts; nesting may be of any
    depth.
    """
    return FlatTables(spark, traces, registries).children()
