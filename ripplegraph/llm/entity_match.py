"""Matching traced symbols to index nodes without a common id.

Two sides describe the same code: a trace names a symbol by a path as its machine saw it and
a runtime name, the index by its own path, name and qualified name. The match is made in
three steps, each over distinct spellings only:

1. *Candidates.* Both sides are cut into blocks by the letters of the name (or, as names may be
   cut off, its beginning), the letters of the file's name, and one directory. Paths may differ
   in what leads them, in the spelling of directories, and by one directory that only one side
   has; then one of the last two directories of either side meets one of the other's, so the
   blocks lose no pair. A pair of a block gets log-odds from path, language, name, owner and kind.
2. *Belief propagation.* A mention takes one node or none, a node is taken by one mention; as
   a mention may be a second spelling of one that has the node already, the node lets a
   further one in at ``SHARED`` of its odds. Mentions and nodes exchange messages through joins until
   the beliefs stand still: each side's sum is aggregated by key and joined to the pairs again. Where a
   mention has one candidate that no other mention wants, the fixed point is written down
   directly; only the contested rest is iterated.
3. The marginal probability is reported with the best node of each mention.

Only numbers are joined while pairs are searched: a block is a hash of its key, and the key itself
is compared once the pair's parts are at hand.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ripplegraph.operators.skew import hot_keys, salt_of, salts_of
from ripplegraph.session import Workspace, default_parallelism

#: Log-odds of a candidate against "no node"; inspected on the smallest tables, see README.
WEIGHTS = {
    "path": {0.0: 3.0, 0.5: 2.5, 1.0: 1.5, 1.5: 0.5},
    "family": {True: 0.5, False: -2.5},
    "name": {"raw": 2.0, "folded": 1.5, "base": 1.0, "letters": 0.5, "start": 0.0},
    "owner": {"same": 2.0, "letters": 1.5, "none": 1.0, "unknown": 0.0, "bare": -1.0, "extra": -1.5, "other": -6.0},
    "kind": {"callable": 0.5, "unknown": 0.0, "other": -4.0},
}
MAX_PATH_COST = 1.5
#: Part of its odds that a mention keeps for a node that another mention holds.
SHARED = 0.15
#: Part of a message that is kept from the round before, so that contests do not swing.
DAMPING = 0.2
#: Kinds of symbols that can be a runtime frame, by their letters (spelling is uneven).
CALLABLE = ["function", "method", "component"]

_NOISE = re.compile(r"[^a-z0-9]")
_VERSION = re.compile(r"[._-]?v\d+$")
_CACHE = re.compile(r"\.cpython-\d+|\.pypy\d+")
_FAMILIES = {"py": "py", "pyc": "py", "pyi": "py", "ts": "js", "tsx": "js", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "vue": "js"}


@lru_cache(200_000)
def letters(text: str) -> str:
    """The letters in order: equal for words that differ by swapped letters."""
    return "".join(sorted(text))


@lru_cache(200_000)
def _directory(part: str) -> tuple[str, str]:
    """A directory's letters and digits, and the key that other spellings of it share."""
    return _NOISE.sub("", part), letters(_NOISE.sub("", _VERSION.sub("", part)))


@lru_cache(20_000)
def read_path(path: str | None) -> tuple[list[str], list[str], str, str, str]:
    """(directories, their keys, file stem, its key, language family) of a path."""
    parts = [p for p in (path or "").replace("\\", "/").lower().split("/") if p not in ("", ".", "__pycache__")]
    if not parts:
        return [], [], "", "", ""
    stem, family = _CACHE.sub("", parts[-1]), ""
    while "." in stem and stem.rsplit(".", 1)[1] in _FAMILIES:
        stem, extension = stem.rsplit(".", 1)
        family = family or _FAMILIES[extension]
    read = [_directory(p) for p in parts[:-1]]
    stem = _NOISE.sub("", stem)
    return [plain for plain, _ in read], [key for _, key in read], stem, letters(stem), family


_LEAD = re.compile(r"^(async|static|get|set|new)\s+")
_TAIL = re.compile(r"(\(\)|…)$")
_PARTS_OF_NAME = re.compile(r"\.|::")
_MANGLED = re.compile(r"_+([A-Za-z0-9]\w*?)__(\w+)$")
_NUMBER = re.compile(r"(\$\d+|_?\d+)$")


@lru_cache(50_000)
def read_qualname(qualname: str, stem: str) -> tuple[str, str, str, str, str] | None:
    """(name, folded name, name without a build's suffix, owner, sign of privacy); None if anonymous."""
    text = qualname.replace("<locals>", "").strip()
    text = _TAIL.sub("", _LEAD.sub("", text))
    parts = [p for p in _PARTS_OF_NAME.split(text) if p]
    if not parts or "<" in parts[-1] or ">" in parts[-1]:
        return None
    name = parts[-1]
    if len(parts) > 1 and _NOISE.sub("", parts[0].lower()) == stem:  # the module's own name
        parts = parts[1:]
    owner = _NOISE.sub("", "".join(parts[:-1]).lower())
    if len(parts) > 1:
        mangled = _MANGLED.match(name)
        if mangled and _NOISE.sub("", parts[-2].lower()) == _NOISE.sub("", mangled[1].lower()):
            name = "__" + mangled[2]
    folded = _NOISE.sub("", name.lower())
    if not folded:
        return None
    base = _NOISE.sub("", _NUMBER.sub("", name).lower()) or folded
    return name, folded, base, owner, "_" if name.startswith("_") else ""


def path_cost(mention: list[str], mention_keys: list[str], node: list[str], node_keys: list[str]) -> float:
    """Cost of aligning two directory lists at their ends; what leads either is free.

    A directory that differs by swapped letters or a version costs 0.5, one that is missing on
    one side 1. When the start of one list has met its partner, what leads the other costs
    nothing: machines and builds put files below other roots.
    """
    n, m = len(mention), len(node)
    table = [[9.0] * (m + 1) for _ in range(n + 1)]
    table[n][m] = 0.0
    best = 9.0
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            cost = table[i][j]
            if i < n:
                cost = min(cost, table[i + 1][j] + 1.0)
            if j < m:
                cost = min(cost, table[i][j + 1] + 1.0)
            if i < n and j < m and mention_keys[i] == node_keys[j]:
                pair = table[i + 1][j + 1] + (0.0 if mention[i] == node[j] else 0.5)
                cost = min(cost, pair)
                if i == 0 or j == 0:  # one side is used up, what leads the other is free
                    best = min(best, pair)
            table[i][j] = cost
    return best


def _map(df: DataFrame, columns: list[str], read, schema: str) -> DataFrame:
    """Rows of ``columns`` through a Python function that returns a tuple or None, batch by batch."""
    empty = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for out in map(read, *(batch.column(c).to_pylist() for c in columns)) if out is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    out = df.select(*columns).mapInArrow(run, schema)
    return out.withColumn("blocks", F.transform("blocks", lambda b: F.xxhash64(b))) if "blocks" in out.columns else out


def traced_pairs(traces: DataFrame) -> DataFrame:
    """Distinct ``trace_id, relpath, qualname`` of all tests; pairs without a name are left out."""
    lists = traces.select("trace_id", F.explode(F.map_values("tests")).alias("pairs"))
    pairs = lists.select("trace_id", F.explode("pairs").alias("p")).where("p is not null and size(p) > 1")
    named = pairs.select("trace_id", F.col("p")[0].alias("relpath"), F.col("p")[1].alias("qualname"))
    return named.where("trace_id is not null and relpath <> '' and qualname <> ''").distinct()


def _starts(owner: str | None, folded: str) -> list[str]:
    """Keys of a name's beginning: with its owner, and, if long enough, without."""
    return ([f"{owner}.{folded[:2]}"] if owner else []) + ([f"?{folded[:6]}"] if len(folded) >= 6 else [])


def mention_blocks(names: set[str], starts: list[str], stem_key: str, keys: list[str]) -> list[str]:
    """Blocks of a mention: its last two directories may be a node's last, its last a node's second last."""
    near = {*keys[-2:], keys[-1] + "|"}
    return [f"{kind}{name}|{stem_key}|{key}" for kind, some in (("=", names), ("^", starts)) for name in some for key in near]


def node_blocks(name: str, start: list[str], stem_key: str, keys: list[str]) -> list[str]:
    """Blocks of a node, as ``mention_blocks`` meets them."""
    return [f"{kind}{n}|{stem_key}|{key}" for kind, some in (("=", [name]), ("^", start)) for n in some for key in (keys[-1], *(k + "|" for k in keys[-2:-1]))]


_PARTS = "dirs string, keys string, stem_key string, family string, blocks array<string>"


def _symbols(forms: DataFrame) -> DataFrame:
    """Distinct spellings with the parts of their path and name; anonymous frames, and paths without
    a directory, drop out here."""

    def read(relpath, qualname):
        dirs, keys, stem, stem_key, family = read_path(relpath)
        parts = read_qualname(qualname, stem) if keys and stem else None
        if parts is None:
            return None
        name, folded, base, owner, private = parts
        blocks = mention_blocks({letters(folded), letters(base)}, _starts(owner, folded), stem_key, keys)
        return relpath, qualname, name, folded, base, letters(folded), letters(base), owner, letters(owner), private, "/".join(dirs), "/".join(keys), stem_key, family, blocks

    schema = f"relpath string, qualname string, name string, folded string, base string, folded_key string, base_key string, owner string, owner_key string, private string, {_PARTS}"
    return _map(forms, ["relpath", "qualname"], read, schema)


def _spellings(nodes: DataFrame) -> DataFrame:
    """Every way a node is written in the index, once: ``id, kind, name, qualified_name, file_path``.

    A row with nulls is another delivery of the node: it takes what it lacks from the node's
    last row that has it. File nodes drop out.
    """
    columns = ["kind", "name", "qualified_name", "file_path"]
    at = F.col("indexed_at") if "indexed_at" in nodes.columns else F.lit(None).cast("timestamp")
    rows = nodes.where(F.col("id").isNotNull() & ~F.col("id").startswith("file:")).select("id", *columns, at.alias("indexed_at"))
    lacks = " or ".join(f"{c} is null" for c in columns)
    torn = rows.where(lacks)
    given = rows.join(torn.select("id").distinct(), "id", "left_semi")
    last = given.groupBy("id").agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct("indexed_at", c)))[c].alias(f"last_{c}") for c in columns))
    mended = torn.join(last, "id").select("id", *(F.coalesce(c, f"last_{c}").alias(c) for c in columns))
    whole = rows.where(f"not ({lacks})").select("id", *columns).unionByName(mended)
    return whole.where("file_path is not null and (name is not null or qualified_name is not null)").repartition("file_path").dropDuplicates()


def _nodes(nodes: DataFrame) -> DataFrame:
    """The spellings of all nodes with the parts of their path and name; what has no path or name drops out."""
    kinds = {letters(k) for k in CALLABLE}
    method = letters("method")

    def read(node_id, kind, name, qualified, file_path):
        dirs, keys, stem, stem_key, family = read_path(file_path)
        parts = [p for p in re.split(r"\.|::", (qualified or "").strip()) if p]
        name = (name or (parts[-1] if parts else "")).strip()
        folded = _NOISE.sub("", name.lower())
        if not folded or not keys or not stem:
            return None
        kind = re.split(r"[^a-z]", (kind or "").strip().lower())[0]
        role = "unknown" if not kind else "callable" if letters(kind) in kinds else "other"
        if len(parts) > 1:
            owner = _NOISE.sub("", "".join(parts[:-1]).lower())
        else:
            owner = "" if parts and letters(kind) != method else None
        blocks = node_blocks(letters(folded), _starts(owner, folded)[:1], stem_key, keys)
        return node_id, name, folded, letters(folded), owner, letters(owner or ""), role, "/".join(dirs), "/".join(keys), stem_key, family, blocks

    schema = f"node_id string, node_name string, node_folded string, node_key string, node_owner string, node_owner_key string, role string, {_PARTS}"
    return _map(_spellings(nodes), ["id", "kind", "name", "qualified_name", "file_path"], read, schema)


#: Added to the cost of an alignment that leaves a directory out.
LEFT_OUT = 100.0


@lru_cache(50_000)
def _alignment(dirs: str, keys: str, node_dirs: str, node_keys: str) -> float:
    """``path_cost`` of two paths, marked where not all directories of the shorter one end the other."""
    mention, node = keys.split("/"), node_keys.split("/")
    size = min(len(mention), len(node))
    plain, other = dirs.split("/"), node_dirs.split("/")
    if mention[-size:] == node[-size:]:
        odd = sum(a != b for a, b in zip(plain[-size:], other[-size:]))
        return 0.5 * odd if odd < 3 else path_cost(plain, mention, other, node)
    return LEFT_OUT + path_cost(plain, mention, other, node)


@F.pandas_udf(DoubleType())
def _aligned(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in parts:
        yield pd.Series([_alignment(*row) for row in zip(*columns)], dtype="float64")


def _weigh(pairs: DataFrame) -> DataFrame:
    """Log-odds of every candidate pair, by built-in expressions."""
    w = WEIGHTS

    def choose(table: dict, *cases: tuple[str, Column], last: str) -> Column:
        out = F.lit(float(table[last]))
        for name, condition in reversed(cases):
            out = F.when(condition, F.lit(float(table[name]))).otherwise(out)
        return out

    path = F.lit(-9.0)
    for cost, weight in w["path"].items():
        path = F.when(F.col("cost") == cost, F.lit(weight)).otherwise(path)
    family = F.when(F.col("same_family"), w["family"][True]).otherwise(w["family"][False])
    name = choose(
        w["name"],
        ("raw", F.col("name") == F.col("node_name")),
        ("folded", (F.col("folded") == F.col("node_folded")) & ~F.col("name").rlike(r"\$\d+$")),  # a build's number is none of the name's
        ("base", F.col("base") == F.col("node_folded")),
        ("letters", F.col("node_key").isin(F.col("folded_key"), F.col("base_key"))),
        last="start",
    )
    owner = choose(
        w["owner"],
        ("unknown", F.col("node_owner").isNull()),
        ("none", (F.col("owner") == "") & (F.col("node_owner") == "")),
        ("same", F.col("owner") == F.col("node_owner")),
        ("bare", F.col("node_owner") == ""),
        ("extra", F.col("owner") == ""),
        ("letters", F.col("owner_key") == F.col("node_owner_key")),
        last="other",
    )
    kind = choose(w["kind"], ("callable", F.col("role") == "callable"), ("unknown", F.col("role") == "unknown"), last="other")
    return pairs.withColumn("weight", path + family + name + owner + kind)


def _candidates(symbols: DataFrame, index: DataFrame) -> DataFrame:
    """Weighted pairs of spellings: ``form, node_id, weight, whole`` and the mention's own keys.

    ``whole`` tells that all directories of the shorter path end the other.
    """
    said = symbols.select("form", F.explode("blocks").alias("block"))
    known = index.select("spelling", F.explode("blocks").alias("block"))
    pairs = said.join(known, "block").select("form", "spelling").repartition("form").dropDuplicates()
    left = symbols.drop("relpath", "qualname", "blocks").withColumnsRenamed({c: f"mention_{c}" for c in ("dirs", "keys", "family")})
    right = index.drop("blocks").withColumnsRenamed({"stem_key": "node_stem_key"})
    # both are looked up by a number of their own, so that no hash table can be lopsided
    met = pairs.join(left.hint("shuffle_hash"), "form").join(right.hint("shuffle_hash"), "spelling").where(F.col("stem_key") == F.col("node_stem_key"))
    # a name that was cut off: its owner is whole, or, where the index has no owner, its beginning is long enough
    owned = (F.col("owner") != "") & (F.col("owner") == F.col("node_owner"))
    begun = F.col("node_folded").startswith(F.col("folded")) & (F.length("node_folded") > F.length("folded")) & (owned | ((F.length("folded") >= 6) & (F.coalesce("node_owner", F.lit("")) == "")))
    met = met.where(F.col("node_key").isin(F.col("folded_key"), F.col("base_key")) | begun)
    cost = met.withColumn("marked", _aligned("mention_dirs", "mention_keys", "dirs", "keys")).withColumn("whole", F.col("marked") < LEFT_OUT)
    near = cost.withColumn("cost", F.when(F.col("whole"), F.col("marked")).otherwise(F.col("marked") - LEFT_OUT)).where(F.col("cost") <= MAX_PATH_COST)
    weighed = _weigh(near.withColumn("same_family", F.col("mention_family") == F.col("family")))
    return weighed.where("weight > -2").select("form", "node_id", "weight", "whole", "owner_key", "base_key", "private")


def _mentions(candidates: DataFrame) -> DataFrame:
    """``form, entity, node_id, weight``: spellings of one symbol are one mention.

    They have the same best nodes and the same letters of owner and name. Where a good candidate
    has the whole path, those with a directory left out are none. All by ``form``, in one shuffle.
    """
    form = W.partitionBy("form")
    rows = candidates.repartition("form").withColumn("good", F.coalesce(F.max(F.when(F.col("whole"), F.col("weight"))).over(form) > 2, F.lit(False)))
    found = rows.where("whole or not good").groupBy("form", "node_id", "owner_key", "base_key", "private").agg(F.max("weight").alias("weight"))
    top = F.when(F.col("weight") == F.max("weight").over(form), F.col("node_id"))
    best = [F.min(top_node := F.col("top")).over(form), F.count(top_node).over(form).cast("string"), F.bit_xor(F.when(top_node.isNotNull(), F.xxhash64("node_id"))).over(form).cast("string")]
    entity = F.md5(F.concat_ws("|", *best, "owner_key", "base_key", "private"))
    return found.withColumn("top", top).select("form", entity.alias("entity"), "node_id", "weight")


def _propagate(work: Workspace, pairs: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    """Marginals of ``entity, node_id, odds`` under one-to-one factors, by loopy propagation.

    ``say`` is what an entity tells a node (how far it wants it), ``free`` what a node answers
    (how far it is free of the others). A message needs the sum of all others' messages: the sums
    are aggregated by key, partly before the shuffle, and joined to the pairs, so that a node that
    very many mentions want is split like any skewed key of a join.
    Rounds go on until no message moves by ``tolerance``; after ``rounds`` it is an error.
    """
    count = F.count(F.lit(1))
    wanted = pairs.groupBy("node_id").agg(count.alias("of_node"))
    per_entity = pairs.join(wanted, "node_id").groupBy("entity").agg(F.max("of_node").alias("most"), F.sum("odds").alias("total"))
    counted = work.save(pairs.join(per_entity, "entity"), "pairs")
    settled = counted.where("most = 1").select("entity", "node_id", (F.col("odds") / (1 + F.col("total"))).alias("belief"))
    state, change = work.save(counted.where("most > 1").select("entity", "node_id", "odds", F.lit(1.0).alias("free")), "state-0"), math.inf
    held = F.col("odds") * F.col("free")
    for k in range(1, rounds + 1):
        said = state.join(state.groupBy("entity").agg(F.sum(held).alias("total")), "entity").withColumn("say", F.col("odds") / (1 + F.greatest(F.col("total") - held, F.lit(0.0))))
        heard = said.groupBy("node_id").agg(F.sum("say").alias("all"))
        answer = SHARED + (1 - SHARED) / (1 + F.greatest(F.col("all") - F.col("say"), F.lit(0.0)))
        damped = DAMPING * F.col("free") + (1 - DAMPING) * answer
        state = work.save(said.join(heard, "node_id").select("entity", "node_id", "odds", damped.alias("free"), F.abs(damped - F.col("free")).alias("moved")), f"state-{k}")
        if k > 1:
            work.drop(f"state-{k - 2}")
        change = state.agg(F.max("moved")).first()[0]
        if change is None or change < tolerance:
            break
    else:
        raise RuntimeError(f"beliefs still move by {change} after {rounds} rounds")
    beliefs = state.join(state.groupBy("entity").agg(F.sum(held).alias("total")), "entity").select("entity", "node_id", (held / (1 + F.col("total"))).alias("belief"))
    return settled.unionByName(beliefs)


def match_symbols(spark: SparkSession, traces: DataFrame, nodes: DataFrame, rounds: int = 500, tolerance: float = 0.005, least: float = 0.5) -> DataFrame:
    """Each traced symbol with the node it denotes: ``trace_id, relpath, qualname, node_id, confidence``.

    One row per distinct pair as spelled in ``tests``; pairs without a node, with a marginal
    probability under ``least``, or with an anonymous frame, give none. Defined cases: null or
    empty maps, lists, pairs and names denote nothing; a node's repeated rows count once, each of
    its spellings can be matched, and nulls in a row are filled from the node's last row that has
    a value; nodes without path or name cannot be found, nor paths without a directory; ties in
    probability go to the smaller node id; empty tables give no rows.
    """
    work = Workspace(spark, "match")
    pairs = work.save(traced_pairs(traces), "traced")
    # once written, spellings go by their numbers
    forms = pairs.select("relpath", "qualname").repartition("relpath").dropDuplicates()
    symbols = work.save(_symbols(forms).withColumn("form", F.monotonically_increasing_id()), "symbols")
    index = work.save(_nodes(nodes).withColumn("spelling", F.monotonically_increasing_id()), "index")
    found = work.save(_mentions(_candidates(symbols, index)), "mentions")
    odds = work.save(found.groupBy("entity", "node_id").agg(F.exp(F.max("weight")).alias("odds")), "odds")
    beliefs = _propagate(work, odds, rounds, tolerance)
    order = F.struct("belief", F.expr("-hash(node_id)"), "node_id")
    pick = beliefs.groupBy("entity").agg(F.max_by(F.struct("node_id", "belief"), order).alias("m")).where(F.col("m.belief") >= least)
    told = found.select("form", "entity").distinct().join(pick, "entity").select("form", F.col("m.node_id").alias("node_id"), F.col("m.belief").alias("confidence"))
    matched = work.save(symbols.select("form", "relpath", "qualname").join(told, "form").drop("form"), "matched")

    key = F.concat_ws("\u0001", "relpath", "qualname")
    hot = hot_keys(pairs.select(key.alias("key")))
    salts = default_parallelism(spark)
    left = pairs.withColumn("salt", salt_of(key, F.col("trace_id"), hot, salts))
    right = matched.withColumn("salt", F.explode(salts_of(key, hot, salts)))
    return left.join(right, ["relpath", "qualname", "salt"]).select("trace_id", "relpath", "qualname", "node_id", "confidence")
