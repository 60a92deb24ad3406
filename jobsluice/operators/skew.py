"""Joins whose key may be held by a large share of the rows.

Groups of copies, sources and links can be very uneven: one key may hold a
third of a table. Aggregates cope, because they combine before the shuffle;
joining their result back to the rows does not, unless hot keys are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsluice.settings import DEFAULT, Settings

# Only the largest keys are ever split; a key below the list's reach holds at
# most 1/10,000 of the rows, so the list is small whatever the data.
MAX_HOT_KEYS = 10_000
# Rows without a key have no partner to repeat, so they can be dealt as finely as one likes.
KEYLESS_SPLITS = 1 << 20
# A side is broadcast only when counting shows it has no more rows than this.
BROADCAST_ROWS = 100_000


def hot_keys(counts: DataFrame, on: list[str], cfg: Settings = DEFAULT) -> DataFrame:
    """The largest keys of ``counts(on..., n)`` and how many ways to split each."""
    splits = (F.ceil(F.col("n") / cfg.hot_rows) + 1).cast("int")
    top = counts.where(F.col("n") >= cfg.hot_rows).orderBy(F.desc("n")).limit(MAX_HOT_KEYS)
    return top.select(*on, splits.alias("_splits"))


def split_lookup(left: DataFrame, right: DataFrame, on: list[str], spread: list[str],
                 counts: DataFrame | None = None, how: str = "left",
                 cfg: Settings = DEFAULT, total: int | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has one row per key.

    ``total`` is the number of left rows where the caller knows it; below the
    hot limit no key can be hot, and the join is a plain one.

    A hot key's left rows go to several tasks and its right row is repeated
    for each of them. Which task is decided by a hash of ``spread``, so a
    rerun task sends its rows the same way.
    """
    if total is not None and total < cfg.hot_rows:
        return left.join(right, on, how)
    if counts is None:
        counts = left.groupBy(*on).agg(F.count("*").alias("n"))
    hot = F.broadcast(hot_keys(counts, on, cfg))
    ways = F.coalesce(F.col("_splits"), F.lit(1))
    # Rows with no key match nothing, but would all hash to one task.
    keyless = F.lit(False)
    for column in on:
        keyless = keyless | F.col(column).isNull()
    own_ways = F.when(keyless, F.lit(KEYLESS_SPLITS)).otherwise(ways)
    rows = left.join(hot, on, "left").withColumn(
        "_split", F.pmod(F.xxhash64(*spread), own_ways).cast("int")).drop("_splits")
    keyed = right.join(hot, on, "left").withColumn(
        "_split", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_splits")
    return rows.join(keyed, [*on, "_split"], how).drop("_split")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def dimension_lookup(left: DataFrame, dimension: DataFrame, on: list[str], spread: list[str],
                     how: str = "left", cfg: Settings = DEFAULT) -> DataFrame:
    """Join a configuration table: broadcast when it is counted small, else split."""
    if is_small(dimension):
        return left.join(F.broadcast(dimension), on, how)
    return split_lookup(left, dimension, on, spread, how=how, cfg=cfg)


def first_by(df: DataFrame, keys: list[str], order: list[str] | Column) -> DataFrame:
    """The first row of each key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    by = order if isinstance(order, Column) else F.struct(*order)
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def last_by(df: DataFrame, keys: list[str], order: list[str] | Column) -> DataFrame:
    """The last row of each key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    by = order if isinstance(order, Column) else F.struct(*order)
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)
