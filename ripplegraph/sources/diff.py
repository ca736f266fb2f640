"""Unified diffs as tables: changed line ranges, wholly changed files, all paths.

A diff is split into its blocks, and every block's header is read by built-in expressions;
only paths in git's C quoting go through a Python function, as no built-in undoes it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ripplegraph.functions.paths import is_product_path

# git's one-letter escapes.
_ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, '"': 34}
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)


def unquote(path: str | None) -> str | None:
    """A path as git writes it in C quoting, undone; a path without quotes as it is."""
    if path is None or len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path

    def byte(match: re.Match) -> bytes:
        code = match[1]
        if b"0" <= code[:1] <= b"7":
            return bytes([int(code, 8) & 255])
        text = code.decode("latin-1")
        return bytes([_ESCAPES[text]]) if text in _ESCAPES else code

    raw = _ESCAPE.sub(byte, path[1:-1].encode("utf-8", "surrogateescape"))
    return raw.decode("utf-8", "surrogateescape")


@F.pandas_udf(StringType())
def _unquoted(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in paths:  # bytes that are no UTF-8 have no place in a column: they show as their codes
        yield part.map(lambda p: p and unquote(p).encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace"))


def _plain(path: Column) -> Column:
    cut = F.regexp_replace(path, r"\t\z", "")
    return F.when(cut.startswith('"'), _unquoted(cut)).otherwise(cut)


def _line(head: Column, start: str) -> Column:
    """The rest of the first header line that begins with ``start``, or null."""
    pattern = r"(?m)^" + re.escape(start) + r"([^\n\r]*)"
    return F.when(head.rlike(pattern), F.regexp_extract(head, pattern, 1))


def blocks(diffs: DataFrame) -> DataFrame:
    """One row per ``diff --git`` block of ``diff_id, text`` with what its header says."""
    cut = diffs.where("text is not null").select("diff_id", F.posexplode(F.split("text", r"(?m)^(?=diff --git )")).alias("no", "block")).where(F.col("block").startswith("diff --git "))
    head = F.split(F.col("block"), r"(?m)^@@ ", 2)[0]
    rows = cut.select("diff_id", "no", "block", head.alias("head"))
    named = rows.select(
        "diff_id", "no", "block",
        _line(F.col("head"), "diff --git ").alias("git"),
        _plain(_line(F.col("head"), "--- ")).alias("old"),
        _plain(_line(F.col("head"), "+++ ")).alias("new"),
        _plain(_line(F.col("head"), "rename from ")).alias("renamed_from"),
        _plain(_line(F.col("head"), "rename to ")).alias("renamed_to"),
        F.col("head").rlike(r"(?m)^(new|deleted) file mode ").alias("empty"),
        F.col("head").rlike(r"(?m)^(old|new) mode ").alias("mode"),
    )
    half = F.floor((F.length("git") - 1) / 2).cast("int")
    left, right = F.left(F.col("git"), half), F.expr("substring(git, cast(floor((length(git) - 1) / 2) as int) + 2)")
    quoted = F.regexp_extract("git", r'\s("(?:[^"\\]|\\.)*"|\S+)\z', 1)
    tail = F.when(F.col("git").contains('"'), _plain(quoted)).when((F.length("git") % 2 == 1) & left.startswith("a/"), right)
    body = lambda c, p: F.when(F.col(c).startswith(p), F.expr(f"substring({c}, 3)"))
    readable = F.coalesce(F.col("new").startswith("b/") | (F.col("new") == "/dev/null"), F.lit(False))
    return named.withColumn("tail", tail).select(
        "diff_id", "no", "block", "renamed_from", "renamed_to", "empty", "mode",
        F.when(F.col("tail").startswith("b/"), F.expr("substring(tail, 3)")).alias("header_path"),
        body("old", "a/").alias("old_path"), body("new", "b/").alias("new_path"),
        readable.alias("readable"), (readable & (F.col("new") == "/dev/null")).alias("deleted"),
    )


def changed_ranges(parsed: DataFrame) -> DataFrame:
    """``diff_id, file_path, lo, hi`` of product files. A hunk without new lines stands for the
    line it follows and the next one, so that what encloses the deletion is still found."""
    files = parsed.where(F.col("new_path").isNotNull() & is_product_path(F.col("new_path")))
    hunk = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"
    spans = files.select("diff_id", F.col("new_path").alias("file_path"), F.explode(F.regexp_extract_all("block", F.lit(hunk), 1)).alias("span"))
    start = F.substring_index("span", ",", 1).cast("int")
    count = F.when(F.col("span").contains(","), F.substring_index("span", ",", -1).cast("int")).otherwise(1)
    lo = F.when(count > 0, start).otherwise(F.greatest(F.lit(1), start))
    return spans.select("diff_id", "file_path", lo.alias("lo"), F.when(count > 0, start + count - 1).otherwise(lo + 1).alias("hi"))


def whole_files(parsed: DataFrame) -> DataFrame:
    """``diff_id, file_path, reason``: deleted, renamed from, renamed to, or a product file whose
    header cannot be read (empty new files and pure mode changes are none)."""
    product = lambda c: is_product_path(F.col(c))
    odd = ~F.col("readable") & F.col("renamed_from").isNull() & F.col("renamed_to").isNull() & ~F.col("empty") & ~F.col("mode")
    entries = F.array_compact(
        F.array(
            F.when(F.col("deleted") & product("old_path"), F.struct(F.col("old_path").alias("p"), F.lit("deleted").alias("r"))),
            F.when(product("renamed_from"), F.struct(F.col("renamed_from").alias("p"), F.lit("renamed from").alias("r"))),
            F.when(product("renamed_to"), F.struct(F.col("renamed_to").alias("p"), F.lit("renamed to").alias("r"))),
            F.when(odd & product("header_path"), F.struct(F.col("header_path").alias("p"), F.lit("unparseable diff header").alias("r"))),
        )
    )
    return parsed.select("diff_id", F.explode(entries).alias("e")).select("diff_id", F.col("e.p").alias("file_path"), F.col("e.r").alias("reason")).distinct()


def all_paths(parsed: DataFrame) -> DataFrame:
    """Every path a diff names, product or not: ``diff_id, path``."""
    named = F.array("header_path", "new_path", F.when(F.col("deleted"), F.col("old_path")), "renamed_from", "renamed_to")
    return parsed.select("diff_id", F.explode(F.array_compact(named)).alias("path")).distinct()
