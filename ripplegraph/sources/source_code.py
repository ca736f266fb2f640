"""Facts from source files: entry points, imports, definitions, references.

Python sources need a parser and go through ``mapInPandas`` with the standard library's one,
a batch of files at a time; the conventions of the other language are line patterns and are
read with built-in expressions.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.paths import is_test_path

# Decorators that mark a handler, exports that name one, directories passed over.
ROUTE_DECORATORS = ["get", "post", "put", "patch", "delete", "head", "options", "route", "websocket"]
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
SKIPPED_DIRECTORIES = [
    ".git", ".venv", "venv", "node_modules", "__pycache__", ".codegraph", ".mypy_cache", ".pytest_cache",
    "dist", "build", ".svelte-kit", ".next", ".nuxt", ".output", "site-packages",
]


def read_sources(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """``path, content`` of the source files below ``root``; directories that hold a
    ``pyvenv.cfg`` and the usual ones beside the code are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/") + "/", "")
    rows = files.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"))
    environments = [r["d"] for r in rows.where(F.substring_index("path", "/", -1) == "pyvenv.cfg").select(F.regexp_replace("path", "pyvenv.cfg$", "").alias("d")).collect()]
    parts = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    kept = rows.where(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_DIRECTORIES)))).where(F.col("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"))
    for directory in environments:
        kept = kept.where(~F.col("path").startswith(directory))
    return kept


def _per_file(sources: DataFrame, read, schema: str) -> DataFrame:
    """Rows that ``read(path, tree)`` yields for each parseable file; None for the tree otherwise."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError):
                    tree = None
                rows.extend(read(path, tree))
            yield pd.DataFrame(rows, columns=names)

    return sources.select("path", "content").mapInPandas(run, schema)


def decorations(sources: DataFrame) -> DataFrame:
    """``path, name, decorator, literal``: the decorators of functions at a module's top.

    ``decorator`` is the last name of it, null for one without a receiver; ``literal`` is a text
    it is called with first. A function without decorators gives no row, a file that does not
    parse one row without a name.
    """

    def first_text(decorator) -> str | None:
        given = getattr(decorator, "args", None) or [None]
        value = getattr(given[0], "value", None)
        return value if isinstance(value, str) else None

    def read(path, tree):
        if tree is None:
            return [(path, None, None, None)]
        tops = (n for n in tree.body if hasattr(n, "decorator_list") and hasattr(n, "args"))
        return [(path, f.name, getattr(getattr(d, "func", d), "attr", None), first_text(d)) for f in tops for d in f.decorator_list]

    return _per_file(sources, read, "path string, name string, decorator string, literal string")


def route_handlers(sources: DataFrame) -> DataFrame:
    """``path, name, method, route`` of decorated module-level functions outside tests; a route
    that is not a literal is null, a file that does not parse gives one row without a name."""
    facts = decorations(sources.where(~is_test_path(F.col("path"))))
    routed = facts.where(F.col("name").isNull() | F.col("decorator").isin(ROUTE_DECORATORS))
    return routed.select("path", "name", F.upper("decorator").alias("method"), F.col("literal").alias("route"))


def definitions(sources: DataFrame) -> DataFrame:
    """``path, name, how`` of what a module defines or imports at its top: a name that only a
    function's body binds is not there."""

    def read(path, tree):
        for node in tree.body if tree else ():
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield path, node.name, "def"
                if isinstance(node, ast.ClassDef):
                    yield from ((path, m.name, "method") for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)))
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                yield from ((path, a.asname or a.name.split(".")[0], "import") for a in node.names)
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                yield from ((path, t.id, "assign") for t in targets if isinstance(t, ast.Name))

    return _per_file(sources, read, "path string, name string, how string")


def import_bindings(sources: DataFrame) -> DataFrame:
    """``path, local, module, symbol``: what each imported name may stand for; a star import
    has the local name '*'. ``from m import n`` may bind a module or a symbol: both come out."""

    def read(path, tree):
        for node in ast.walk(tree) if tree else ():
            if isinstance(node, ast.Import):
                yield from ((path, a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], None) for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                base = node.module or ""
                for a in node.names:
                    if a.name == "*":
                        yield path, "*", base, None
                        continue
                    yield path, a.asname or a.name, ".".join(p for p in (base, a.name) if p), None
                    yield path, a.asname or a.name, base, a.name

    return _per_file(sources, read, "path string, local string, module string, symbol string")


def references(sources: DataFrame) -> DataFrame:
    """``path, function, line, end_line, root, name, bound, nested``: every name that a
    function's body refers to.

    ``root`` is the first name of a dotted receiver, null for a bare name and '' for a receiver
    that no reading resolves (a call, a subscript, a literal); ``bound`` tells that the root
    or bare name is a parameter or local of the function; ``nested`` marks functions that are
    defined inside it. A function that refers to nothing gives one row without a name.
    """

    def read(path, tree):
        for function in ast.walk(tree) if tree else ():
            if not isinstance(function, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            arguments = function.args
            local = {a.arg for a in [*arguments.posonlyargs, *arguments.args, *arguments.kwonlyargs, *filter(None, (arguments.vararg, arguments.kwarg))]}
            inside = [n for n in ast.walk(function) if n is not function]
            local |= {n.id for n in inside if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
            nested = {n.name for n in inside if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
            where = (path, function.name, function.lineno, function.end_lineno)
            seen = set()
            for node in inside:
                if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
                    seen.add((None, node.id, node.id in local, False))
                elif isinstance(node, ast.Attribute):
                    receiver = node.value
                    while isinstance(receiver, ast.Attribute):
                        receiver = receiver.value
                    root = receiver.id if isinstance(receiver, ast.Name) else ""
                    seen.add((root, node.attr, root in local, False))
            seen |= {(None, name, False, True) for name in nested}
            seen = seen or {(None, None, False, False)}
            yield from ((*where, *s) for s in seen)

    return _per_file(sources, read, "path string, function string, line int, end_line int, root string, name string, bound boolean, nested boolean")


def module_matches(module: Column, path: Column) -> Column:
    """Whether a dotted module can be the file: its last part is the file's stem or any
    directory or stem on the path."""
    last = F.substring_index(module, ".", -1)
    return F.array_contains(F.split(F.regexp_replace(path, r"\.py\z", ""), "/"), last)


def source_support(edges: DataFrame, refs: DataFrame, bindings: DataFrame, defs: DataFrame) -> DataFrame:
    """``id, support`` of call edges (``id, caller_path, caller, caller_kind, callee_path, callee,
    callee_kind``): 'supported', 'unsupported' or 'unknown'.

    Rule joins over the facts: a reference supports an edge if it is a method's name on any
    receiver, a name on ``self`` or ``cls``, a name on a receiver that an import may bind to the
    callee's module, a bare or aliased name imported from it, or a bare name defined in the
    same file. Names that a parameter or local shadows support nothing. Callers in other
    languages, of other kinds, in files that do not parse, that define no such function or
    that have a star import are unknown.
    """
    star = bindings.where("local = '*'").select(F.col("path").alias("caller_path"), F.lit(True).alias("star")).distinct()
    known = refs.select(F.col("path").alias("caller_path"), F.col("function").alias("caller"), F.lit(True).alias("parsed")).distinct()
    base = edges.join(star, "caller_path", "left").join(known, ["caller_path", "caller"], "left")
    judged = F.col("caller_path").endswith(".py") & F.col("callee_path").endswith(".py") & F.col("caller_kind").isin("function", "method") & F.col("parsed").isNotNull() & F.col("star").isNull()
    marked = base.withColumn("judged", F.coalesce(judged, F.lit(False)))
    r = refs.select(F.col("path").alias("caller_path"), F.col("function").alias("caller"), "root", "name", "bound", "nested")
    asked = marked.where("judged").join(r, ["caller_path", "caller"])
    same_file = F.col("caller_path") == F.col("callee_path")
    named = F.col("name") == F.col("callee")
    bare = F.col("root").isNull()
    direct = named & (
        (~bare & (F.col("callee_kind") == "method"))
        | F.col("root").isin("self", "cls")
        | (same_file & F.col("nested"))
    )
    local = asked.where(named & bare & ~F.col("bound") & same_file).join(defs.where("how <> 'import'").select(F.col("path").alias("caller_path"), "name").distinct(), ["caller_path", "name"], "left_semi").select("id")
    b = bindings.select(F.col("path").alias("caller_path"), "local", "module", "symbol")
    through = asked.withColumn("local", F.coalesce("root", "name")).join(b, ["caller_path", "local"])
    by_module = through.where(named & ~bare & module_matches(F.col("module"), F.col("callee_path"))).select("id")
    by_symbol = through.where(bare & ~F.col("bound") & (F.col("symbol") == F.col("callee")) & ((F.col("module") == "") | module_matches(F.col("module"), F.col("callee_path")))).select("id")
    supported = asked.where(direct).select("id").unionByName(local).unionByName(by_module).unionByName(by_symbol).distinct().withColumn("supported", F.lit(True))
    state = F.when(~F.col("judged"), "unknown").when(F.col("supported"), "supported").otherwise("unsupported")
    return marked.join(supported, "id", "left").select("id", state.alias("support"))


def call_graph(sources: DataFrame) -> DataFrame:
    """``frm, nxt``: names that functions refer to, only those that some file defines."""
    defined = references(sources).select(F.col("function").alias("name")).distinct()
    refs = references(sources).where("not nested").select(F.col("function").alias("frm"), F.col("name").alias("nxt")).distinct()
    return refs.join(defined.select(F.col("name").alias("nxt")), "nxt", "left_semi").select("frm", "nxt")


def app_route(path: Column) -> Column:
    """The address of a file below the last ``app`` directory, groups and slots left out."""
    parts = F.split(path, "/")
    at = F.size(parts) - F.array_position(F.reverse(parts), F.lit("app")).cast("int") + 1
    after = F.slice(parts, at + 1, F.greatest(F.size(parts) - at - 1, F.lit(0)))
    kept = F.filter(after, lambda p: ~p.startswith("(") & ~p.startswith("@"))
    return F.when(F.array_contains(parts, F.lit("app")), F.concat(F.lit("/"), F.array_join(kept, "/")))


def app_entries(sources: DataFrame) -> DataFrame:
    """``path, name, method, route`` of route files, pages and server actions outside tests."""
    rows = sources.where(~is_test_path(F.col("path"))).select("path", "content", app_route(F.col("path")).alias("route"), F.regexp_extract(F.substring_index("path", "/", -1), r"\A(.+)\.[^.]*\z", 1).alias("stem"))
    found = lambda pattern: F.regexp_extract_all("content", F.lit("(?m)" + pattern), 1)
    http = rows.where("stem = 'route' and route is not null").select("path", F.explode(found(r"^export\s+(?:async\s+)?(?:function\s+|const\s+|let\s+|var\s+)?(" + "|".join(HTTP_METHODS) + r")\b")).alias("name"), F.lit(None).cast("string").alias("method"), "route")
    http = http.withColumn("method", F.col("name"))
    defaults = F.array_compact(F.array(F.get(found(r"^export\s+default\s+(?:async\s+)?function\s+(\w+)"), F.lit(0)), F.get(found(r"^export\s+default\s+(?!async\b|function\b)(\w+)\s*;?\s*$"), F.lit(0))))
    pages = rows.where("stem = 'page' and route is not null").select("path", F.get(defaults, F.lit(0)).alias("name"), F.lit("PAGE").alias("method"), "route").where("name is not null")
    directive = r"\A(?:\s*(?://[^\n]*|/\*[\s\S]*?\*/))*\s*['\"]use server['\"]\s*;?\s*(?:\n|\z)"
    acted = rows.where(F.col("content").rlike(directive))
    names = F.concat(found(r"^export\s+(?:async\s+)?function\s+(\w+)"), found(r"^export\s+(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*async\b"))
    actions = acted.select("path", F.explode(names).alias("name"), F.lit("ACTION").alias("method"), "route")
    return http.unionByName(pages).unionByName(actions).distinct()


def last_substantive_line(text: Column) -> Column:
    """The last line that is neither blank nor a comment nor a lone bracket: where a seeded
    change of a body goes."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"\S") & ~line.rlike(r"^\s*(#|//|[)\]}]+\s*$)"))
    return F.when(F.size(lines) > 0, F.element_at(lines, -1))
