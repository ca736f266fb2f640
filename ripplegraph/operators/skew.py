"""Finding keys that hold a large share of the rows, and salting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def hot_keys(keys: DataFrame, share: float = 0.01, fraction: float = 0.02, seed: int = 7) -> list[str]:
    """Values of the single column of ``keys`` that hold about ``share`` of its rows or more.

    At most ``2 / share`` values can pass, whatever the size of the data, so the list may
    go to the driver. A ``fraction`` of the rows is looked at: the list only decides how
    rows are spread over tasks, never which rows are kept, and a key that is missed here is
    still computed in full, just without salt.
    """
    column, total = keys.columns[0], Observation()
    seen = keys.where(F.col(column).isNotNull()).sample(fraction=fraction, seed=seed).observe(total, F.count(F.lit(1)).alias("n"))
    counts = seen.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 20)
    rows = counts.orderBy(F.desc("n"), column).limit(int(2 / share)).collect()
    if not rows:  # also where the plan of an empty table has nothing left to observe
        return []
    least = total.get["n"] * share / 2
    return [r[column] for r in rows if r["n"] >= least]


def is_hot(key: Column, hot: list[str]) -> Column:
    return key.isin(hot) if hot else F.lit(False)


def salt_of(key: Column, by: Column, hot: list[str], salts: int) -> Column:
    """Salt of a row on the many side: spread by ``by`` for hot keys, 0 for all others."""
    return F.when(is_hot(key, hot), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(F.lit(0))


def salts_of(key: Column, hot: list[str], salts: int) -> Column:
    """Array of all salts a row on the one side must be repeated for."""
    return F.when(is_hot(key, hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
