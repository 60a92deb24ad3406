"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash. A document's virtual finish
time is the source's tokens up to and with it, divided by the source's target;
sources whose target exceeds their size queue again, up to three times over.
All are sorted by finish time and taken while the total budget lasts.

Running sums are taken in two steps, over blocks of the shuffle's order and
inside a block, so no task holds a source; the budget's end is found by counting
ever finer spans of virtual time, so only the last span is sorted in one place.

Results in special cases: a null source is a source of its own, last in order.
A null text has no words; documents without words are not taken. Rows equal in
id and text share one place in the shuffle and are taken together. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsluice.llm.common import WORD, store
from jobsluice.operators.skew import is_small

MAX_COPIES = 3
SPANS = 4096


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[int, ...] = (5, 2, 1)
    seed: int = 42
    # Rows of a block of a source's shuffle order, about.
    block_rows: int = 1_000
    # The budget's last span is sorted in one task once it holds no more rows.
    last_rows: int = 5_000


def n_words(text: str = "text") -> Column:
    """Words of a text, without building them."""
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(marked, "[^x]+", "")).cast("long")


def shuffle_key(id_col: str, text_col: str, seed: int) -> Column:
    """A hash of the document, as text, alike in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                          F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, cfg: MixSettings = MixSettings()) -> DataFrame:
    """``(source, source_size, target, copies)`` from ``(source, source_size)``.

    Shares of the whole by weight, none above three times its source; the excess
    goes to the others by weight. A source stops at its limit exactly if its limit
    over its weight is below the common level, so sorting by that ratio finds all.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(ordered) - 1) % len(cfg.weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in cfg.weights]), (number + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn(
        "limit", F.col("source_size") * MAX_COPIES)
    ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.withColumns({
        "limits": F.coalesce(F.sum("limit").over(upto), F.lit(0)),
        "weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
        "total": F.sum("source_size").over(whole)})
    rows = rows.withColumn("level", (F.col("total") - F.col("limits")) / F.col("weights"))
    # The level holds from the first source on that does not reach its limit.
    level = F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"),
                         F.struct(F.col("limit") / F.col("weight"), F.col("level")))) \
        .over(whole)["level"]
    rows = rows.withColumn("target", F.coalesce(
        F.least(F.col("limit").cast("double"), level * F.col("weight")),
        F.col("limit").cast("double")))
    copies = F.when(F.col("source_size") > 0, F.least(
        F.lit(MAX_COPIES), F.greatest(F.lit(1), F.ceil(
            F.col("target") / F.col("source_size")) + 1))).otherwise(0).cast("int")
    return rows.select("source", "source_size", "target", copies.alias("copies"))


@dataclass(frozen=True)
class Mix:
    rows: DataFrame         # id, source, size, key of every document
    cuts: DataFrame         # source, source_size, target, full, last: see ``copies``


def same_source(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", cfg: MixSettings = MixSettings()) -> Mix:
    rows = store(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        n_words(text_col).alias("size"), shuffle_key(id_col, text_col, cfg.seed).alias("key")),
        "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = store(source_targets(sizes, cfg), "mix-targets")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    digits = max(0, math.ceil(math.log(max(1.0, n / cfg.block_rows), 16)))
    blocked = rows.where("size > 0").withColumn("block", F.substring("key", 1, digits))
    blocks = blocked.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    before = F.sum("block_size").over(Window.partitionBy("source").orderBy("block")) \
        - F.col("block_size")
    starts = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"),
                           before.alias("before"))
    inside = F.sum("size").over(Window.partitionBy("source", "block").orderBy(
        "key", "id").rowsBetween(Window.unboundedPreceding, 0))
    summed = blocked.withColumn("inside", inside).join(
        starts, same_source("source", "s") & (F.col("block") == F.col("b"))) \
        .select("source", "size", "key", (F.col("before") + F.col("inside")).alias("upto"))
    aims = targets.withColumnRenamed("source", "t")
    if is_small(aims):
        aims = F.broadcast(aims)
    queued = summed.join(aims, same_source("source", "t")) \
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))) \
        .withColumn("finish", (F.col("upto") + F.col("turn") * F.col("source_size"))
                    / F.col("target"))
    queue = store(queued.select("source", "size", "key", "turn", "finish"), "mix-queue")
    taken = _within_budget(queue, total, cfg)
    last = taken.groupBy("source").agg(F.max(F.struct("turn", "key")).alias("last"))
    cuts = targets.join(last.withColumnRenamed("source", "l"), same_source("source", "l"), "left") \
        .select("source", "source_size", "target", F.col("last.turn").alias("full"),
                F.col("last.key").alias("last"))
    return Mix(rows, store(cuts, "mix-cuts"))


def _within_budget(queue: DataFrame, total: int, cfg: MixSettings) -> DataFrame:
    """The longest beginning of the queue, by finish time, that the budget pays for."""
    low, high, spent = 0.0, None, 0
    while True:
        span = queue.where(F.col("finish") > low) if high is None else \
            queue.where((F.col("finish") > low) & (F.col("finish") <= high))
        size, count, least, most = span.agg(
            F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.min("finish"),
            F.max("finish")).first()
        if spent + size <= total:
            return queue if high is None else queue.where(F.col("finish") <= high)
        width = (most - low) / SPANS
        if count <= cfg.last_rows or least == most or low + width <= low:
            break
        part = F.least(F.greatest(F.ceil((F.col("finish") - low) / width), F.lit(1)),
                       F.lit(SPANS)).cast("int")
        spans = span.groupBy(part.alias("part")).agg(
            F.sum("size").alias("size"), F.min("finish").alias("least"),
            F.max("finish").alias("most")).orderBy("part").collect()
        for row in spans:
            if spent + row["size"] > total:
                high = row["most"]
                break
            spent, low = spent + row["size"], row["most"]
    order = Window.partitionBy().orderBy(
        "finish", F.col("source").asc_nulls_last(), "turn", "key")
    within = span.withColumn("sum", F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= total - spent)
    return queue.where(F.col("finish") <= low).unionByName(within.drop("sum"))


def copies(key: Column) -> Column:
    """How often a document is taken, given its source's cut."""
    return F.when(F.col("full").isNull(), 0).otherwise(
        F.col("full") + F.when(key <= F.col("last"), 1).otherwise(0)).cast("int")


def taken_words(mixed: Mix) -> DataFrame:
    """``(id, size, source_size, target, taken)`` of every document."""
    cuts = mixed.cuts.withColumnRenamed("source", "c")
    if is_small(cuts):
        cuts = F.broadcast(cuts)
    return mixed.rows.join(cuts, same_source("source", "c"), "left").select(
        "id", "size", "source_size", "target", (F.col("size") * copies(F.col("key")))
        .cast("long").alias("taken"))


def apply_mix(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source", cfg: MixSettings = MixSettings()) -> DataFrame:
    """The mixture: every taken document with its columns, as often as it is taken."""
    cuts = mixed.cuts.select(F.col("source").alias("_cut_source"), "full", "last")
    if is_small(cuts):
        cuts = F.broadcast(cuts)
    rows = docs.select(F.struct(*docs.columns).alias("_row"),
                       F.col(source_col).alias("_source"),
                       shuffle_key(id_col, text_col, cfg.seed).alias("_key"),
                       (n_words(text_col) > 0).alias("_some"))
    times = F.when(F.col("_some"), copies(F.col("_key"))).otherwise(0)
    return rows.join(cuts, same_source("_source", "_cut_source")).withColumn("_n", times) \
        .where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))) \
        .select("_row.*")
