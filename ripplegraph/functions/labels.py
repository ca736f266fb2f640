"""Ids and labels of flows, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# File stems that name a role, and the extensions they count for.
ROLE_STEMS = ["route", "page", "layout", "index", "actions"]
ROLE_EXTENSIONS = r"\.(ts|tsx)\z"


def slug(text: Column) -> Column:
    """Letters and digits kept, all else '_', outer '_' cut; 'x' if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}]", "_"), F.lit("_")), F.lit("")), F.lit("x"))


def without_extension(path: Column) -> Column:
    return F.when(path.rlike(r"\A.+\.[^./]*\z"), F.regexp_replace(path, r"\.[^./]*\z", "")).otherwise(path)


def flow_ids(entries: DataFrame) -> DataFrame:
    """Unique ids of ``file, name``: by file stem and name; groups that collide take the whole
    path; what still collides is numbered."""
    bare = without_extension(F.col("file"))
    base = F.substring_index(bare, "/", -1)
    parent = F.substring_index(F.substring_index(bare, "/", -2), "/", 1)
    stem = F.when(F.col("file").rlike(ROLE_EXTENSIONS) & base.isin(ROLE_STEMS) & bare.contains("/"), parent).otherwise(base)
    rows = entries.select("file", "name", F.concat_ws("_", F.lit("J"), slug(stem), slug(F.col("name"))).alias("short"), F.concat_ws("_", F.lit("J"), slug(bare), slug(F.col("name"))).alias("long"))
    alone = rows.groupBy("short").agg(F.count(F.lit(1)).alias("sharing"))
    named = rows.join(alone, "short").select("file", "name", F.when(F.col("sharing") == 1, F.col("short")).otherwise(F.col("long")).alias("candidate"))
    k = F.row_number().over(W.partitionBy("candidate").orderBy("file", "name"))
    numbered = named.withColumn("k", k)
    return numbered.select("file", "name", F.when(F.col("k") == 1, F.col("candidate")).otherwise(F.concat_ws("_", "candidate", F.col("k").cast("string"))).alias("journey_id"))


def tag(journey_id: Column, template: str = "@tg:{}") -> Column:
    return F.format_string(template.replace("{}", "%s"), journey_id)


def tagged(title: Column, template: str = "@tg:{}") -> Column:
    """All ids tagged in a title; ``@tg:J1`` is not found in ``@tg:J10``."""
    head, _, tail = template.partition("{}")
    import re

    return F.regexp_extract_all(title, F.lit(r"(?<![\w@])" + re.escape(head) + r"([A-Za-z0-9_]+)" + re.escape(tail) + r"(?![\w])"), 1)


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-#&~\s])", r"\\$1")


def _tags(ids: Column, template: str) -> Column:
    return F.array_join(F.transform(ids, lambda j: _escaped(tag(j, template))), "|")


def marker_expression(ids: Column, template: str = "tg_{}") -> Column:
    """``tg_J1 or tg_J2``: what a marker filter takes; any of the flows is in scope."""
    return F.array_join(F.transform(ids, lambda j: tag(j, template)), " or ")


def grep_expression(ids: Column, template: str = "@tg:{}") -> Column:
    """A title filter for exactly these flows: what follows a tag must not go on with it."""
    return F.concat(F.lit("("), _tags(ids, template), F.lit(r")(\s|$)"))


def name_pattern(ids: Column, template: str = "@tg:{}") -> Column:
    """A full-name filter for exactly these flows: tags are whole words on both sides."""
    return F.concat(F.lit(r"(^|\s)("), _tags(ids, template), F.lit(r")(\s|$)"))


#: What counts as white space to the runner whose names are read: not quite what Java's \s is.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def declares(name: Column, journey_id: Column, template: str = "@tg:{}") -> Column:
    """Whether a test's full name holds the flow's tag as a whole word."""
    return F.regexp_like(name, F.concat(F.lit(rf"(?:^|{SPACE})"), _escaped(tag(journey_id, template)), F.lit(rf"(?={SPACE}|\z)")))


def date_text(epoch_seconds: Column) -> Column:
    """Seconds since the epoch as a date, 'never' for none."""
    return F.coalesce(F.date_format(F.timestamp_seconds(F.nullif(epoch_seconds, F.lit(0))), "yyyy-MM-dd"), F.lit("never"))


def joined_name(handler: Column, routes: Column) -> Column:
    """Display name: the labelled routes joined by ' + ', else the handler."""
    labelled = F.filter(routes, lambda r: r["path"].isNotNull() & (r["path"] != ""))
    text = F.array_join(F.transform(labelled, lambda r: F.concat_ws(" ", r["method"], r["path"])), " + ")
    return F.when(F.size(labelled) > 0, text).otherwise(handler)


def short_rev(rev: Column) -> Column:
    return F.when(rev.rlike(r"\A[0-9a-f]{40}\z"), F.left(rev, F.lit(9))).otherwise(rev)


# What a cap token says in words.
REASONS = {"name-collision": "resolved by name only and the name is shared", "heuristic": "a heuristic edge", "metadata": "low recorded confidence"}


def weak_reason(cap: Column) -> Column:
    out = F.lit(None).cast("string")
    for token, text in REASONS.items():
        out = F.when(cap == token, text).otherwise(out)
    return out
