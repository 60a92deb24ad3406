"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input task sends to each shard is drawn exactly as a uniform
shuffle would have it: task by task, without replacement from the room left in
the shards. A task permutes its rows and deals them out by its line of the
matrix; a shard permutes what it got. Every permutation is the order of a hash
of (seed, row number), so a task that runs again does the same.

The second permutation is cut into blocks of the hash's range, whose counts
give each block its first slot: no task holds a shard.

Results in special cases: a null text has size 8 and checksum 0. Repeated rows
and null ids are rows like any other. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsluice.llm.common import store

# Above this many rows the library's sampler is not defined.
NUMPY_LIMIT = 500_000_000


@dataclass(frozen=True)
class ShardSettings:
    shards: int = 24
    seed: int = 42
    # A block of the second permutation holds about this many rows.
    block_rows: int = 1_000


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` out of ``good + bad``, exact for any size.

    For large numbers by rejection from a table mountain hat over the
    distribution's log density (ratio of uniforms).
    """
    total = good + bad
    if not draws or not good:
        return 0
    if not bad:
        return draws
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    share = good / total
    mean = draws * share
    spread = math.sqrt(max(draws * share * (1 - share) * (total - draws) / max(total - 1, 1), 0.0)
                       + 0.5)

    def density(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(draws - k + 1)
                 + math.lgamma(bad - draws + k + 1))

    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    peak = density(mode)
    centre, width = mean + 0.5, 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e))
    while True:
        u, v = rng.random(), rng.random()
        if u <= 0:
            continue
        k = math.floor(centre + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= density(k) - peak:
            return k


def communication_matrix(sizes: list[int], room: list[int], seed: int) -> np.ndarray:
    """``[task, shard]`` counts: rows of sums ``sizes``, columns of sums ``room``."""
    rng = np.random.default_rng(seed)
    left = [int(r) for r in room]
    out = np.zeros((len(sizes), len(room)), dtype=np.int64)
    for task, size in enumerate(sizes):
        need, others = int(size), sum(left)
        for shard, free in enumerate(left):
            others -= free
            out[task, shard] = draw_hypergeometric(rng, free, others, need)
            need -= int(out[task, shard])
        left = [a - int(b) for a, b in zip(left, out[task])]
    return out


def shuffle_into_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        cfg: ShardSettings = ShardSettings()) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = store(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.spark_partition_id().alias("task"),
        F.monotonically_increasing_id().alias("rid")), "shard-rows")
    # One count for each input task, and the matrix has one line for each.
    counts = rows.groupBy("task").count().orderBy("task").collect()
    total = sum(c["count"] for c in counts)
    room = [total // cfg.shards + (s < total % cfg.shards) for s in range(cfg.shards)]
    matrix = communication_matrix([c["count"] for c in counts], room, cfg.seed)
    lines = spark.createDataFrame(
        [(c["task"], np.cumsum(line).tolist()) for c, line in zip(counts, matrix)],
        "task int, upto array<long>")
    local = F.row_number().over(Window.partitionBy("task").orderBy(
        F.xxhash64(F.lit(cfg.seed), "rid"), "rid")) - 1
    sent = rows.withColumn("place", local).join(lines, "task").select(
        "id", "size", "text_crc32", "rid",
        F.size(F.filter("upto", lambda x: x <= F.col("place"))).alias("shard"))
    bits = max(0, math.ceil(math.log2(max(1.0, total / cfg.shards / cfg.block_rows))))
    order = F.xxhash64(F.lit(cfg.seed + 1), "rid")
    block = F.shiftrightunsigned(order, 64 - bits) if bits else F.lit(0).cast("long")
    held = store(sent.withColumn("block", block), "shard-exchange")
    sizes = held.groupBy("shard", "block").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")
    starts = sizes.select("shard", "block", before.alias("before"))
    inside = F.row_number().over(
        Window.partitionBy("shard", "block").orderBy(F.xxhash64(F.lit(cfg.seed + 1), "rid"), "rid"))
    return held.withColumn("inside", inside).join(starts, ["shard", "block"]).select(
        "id", "size", "text_crc32", "shard",
        (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"))
